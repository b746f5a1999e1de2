import unicodedata

import pytest
from pyspark.sql import functions as F

from themeloom.functions import scoring, text as T
from themeloom.operators import columns as C, records as R


def run(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t")).alias("x")).collect()]


def test_normalize_matches_unicode_rules(spark):
    values = [
        "ＡＢＣ 商品", " nan ", "ｎａｎ", "　あ い\x1cう\r\nx", "NaN", "", None, "¨a", "½ ﬁ Å 한",
        "a b c  d", "x\u0085\u0085y", "a \t b", "  \n\n ", "nano", "a　　b ",
    ]

    def expected(v):
        stripped = (v or "").strip()
        return "" if stripped.lower() in ("", "nan") else " ".join(unicodedata.normalize("NFKC", stripped).split())

    assert run(spark, values, T.normalize_text) == [expected(v) for v in values]


def test_normalize_every_space_and_width_form(spark):
    values = [f"a{chr(c)}b{chr(c)}" for c in (*range(1, 0x100), *range(0x2000, 0x2070), *range(0xFF00, 0xFFF0), 0x1680, 0x3000)]
    expected = [" ".join(unicodedata.normalize("NFKC", v.strip()).split()) for v in values]
    assert run(spark, values, T.normalize_text) == expected


def test_multi_column_skips_empty_sides(spark):
    df = spark.createDataFrame([("配達", "遅れた"), ("", "only body"), ("nan", " NaN ")], "subj string, body string")
    got = R.with_text(df, text_cols=["subj", "body"], labels={"subj": "subject"}).select(R.TEXT).collect()
    assert [r[0] for r in got] == ["subject: 配達 body: 遅れた", "body: only body", ""]


def test_sanitizers(spark):
    assert run(spark, ['「Late」\nsecond', '""', "x" * 40, "  ", "\n\n`a`", '" "'], T.sanitize_label) == [
        "Late", "Untitled", "x" * 30, "Untitled", "a", " ",
    ]
    assert run(spark, ['"a"', " l1 \n\n l2 ", "y" * 401, '"', ""], T.sanitize_summary) == [
        "a", "l1 l2", "y" * 400 + "…", "(no summary)", "(no summary)",
    ]


def test_parse_annotation(spark):
    values = ['{"label": "A", "summary": "\\"B\\""}', "{}", "not json " * 40, '```json\n{"label": "L", "summary": "s"}\n```', '{"label": "only"}']
    got = [(a["label"], a["summary"]) for a in run(spark, values, T.parse_annotation)]
    assert got == [("A", "B"), ("Untitled", "(no summary)"), ("Parse failure", ("not json " * 40)[:200]), ("L", "s"), ("only", "(no summary)")]


def test_unfence_markdown(spark):
    values = ["```markdown\n# T\n```", "```md\nx\n```", "```\nx\n```", "plain", "```python\nx\n```"]
    assert run(spark, values, T.unfence_markdown) == ["# T", "x", "x", "plain", "python\nx"]


def test_duplicates_are_collapsed_before_the_cut(spark):
    long = "あ" * 4500
    rows = [(0, long), (1, long + "x"), (2, "ＡＢＣ 商品"), (3, "ABC 商品"), (4, "  "), (5, long)]
    got = R.load_records(spark.createDataFrame(rows, "row_id long, t string"), text_col="t").orderBy("row_id").collect()
    assert [(r.row_id, len(r[R.TEXT]), r[R.COUNT]) for r in got] == [(0, 4000, 2), (1, 4000, 1), (2, 6, 2)]
    assert got[0].text_hash == got[1].text_hash and got[0].full_hash != got[1].full_hash


def test_column_choice_errors(spark):
    df = spark.createDataFrame([("a",)], "t string")
    for kwargs in ({}, {"text_col": "t", "text_cols": ["t"]}, {"text_col": "missing"}):
        with pytest.raises(ValueError):
            R.with_text(df, **kwargs)
    with pytest.raises(ValueError):
        R.require_rows(df.where("false"))
    assert R.parse_column_specs(None, "a, b", "a=A") == (["a", "b"], {"a": "A"})
    with pytest.raises(ValueError):
        R.parse_column_specs("a", "b")


def test_column_ranking(spark):
    rows = [(i, str(i), f"cat{i % 2}", f"this is a much longer comment number {i % 3}", ["100", "200", "N/A", "300"][i % 4], "") for i in range(8)]
    df = spark.createDataFrame(rows, "row_id long, id string, category string, comment string, mixed string, empty string")
    got = C.suggest_text_columns(df).collect()
    assert [r.name for r in got][0] == "comment" and {r.name for r in got} == {"category", "comment", "mixed"}
    first = got[0]
    assert first.sample_values == [rows[0][3], rows[1][3], rows[2][3]]
    assert first.unique_ratio == pytest.approx(3 / 8) and first.non_empty_ratio == 1.0


def test_numeric_pattern(spark):
    yes = ["1", " -2.5 ", "+.5", "1e-3", "inf", "-Infinity", "3."]
    no = ["1d", "nan", "", "1,000", "N/A", "٣", "."]
    assert run(spark, yes + no, scoring.looks_numeric) == [True] * len(yes) + [False] * len(no)


def test_granularity_and_share(spark):
    n = spark.createDataFrame([(v,) for v in (50, 30, 80, 10, 1, 120)], "n int")
    got = [r[0] for r in n.select(scoring.granularity_fit(F.col("n"), "faq")).collect()]
    assert got[:3] == [1, 1, 1] and got[3] < 0.5 and got[4] == 0.1 and 0.3 <= got[5] < 1
    s = spark.createDataFrame([(v,) for v in (0.05, 0.10, 0.15, 1.0)], "s double")
    got = [r[0] for r in s.select(scoring.share_penalty(F.col("s"), "faq")).collect()]
    assert got[:2] == [1, 1] and got[2] < 1 and got[3] >= 0.2
    assert s.select(scoring.share_penalty(F.lit(0.5), "insight")).first()[0] == 1.0
