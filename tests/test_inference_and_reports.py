import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.inference import annotate as A, embed as E, providers as P
from themeloom.inference.advise import advice
from themeloom.operators.records import TEXT
from themeloom.plans import job, report
from themeloom.runtime import scratch_path
from themeloom.sinks import tables
from themeloom.sources import caches

REPS = "array<struct<rank:int,row_id:bigint,similarity:double,text:string>>"


def summaries(spark, rows):
    table = [(c, n, [(i + 1, i, 1.0, t) for i, t in enumerate(reps)]) for c, n, reps in rows]
    return spark.createDataFrame(table, f"cluster_id int, size long, reps {REPS}")


def records(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), f"row_id long, {TEXT} string")
    return df.withColumn("text_hash", F.sha2(TEXT, 256))


def failing(texts):
    raise AssertionError("nothing should be asked for")


def test_vectors_keep_their_rows_over_batches(spark):
    texts = [f"text number {i}" for i in range(350)]
    got = E.embed(records(spark, texts), P.charcode(8), "m").orderBy("row_id").collect()
    assert np.allclose([r.embedding for r in got], P.charcode(8)(texts))


def test_only_misses_are_embedded(spark):
    path = scratch_path(spark, "vectors")
    E.embed(records(spark, ["a", "b"]), P.charcode(4), "m", path).collect()
    assert E.embed(records(spark, ["a", "b", "a"]), failing, "m", path).count() == 3
    assert E.embed(records(spark, ["a", "b", "c"]), P.charcode(4), "m", path).count() == 3
    assert caches.cached_vectors(spark, path, "m").count() == 3
    with pytest.raises(ValueError):
        E.embed(records(spark, ["a"]).where("false"), P.charcode(4), "m")
    with pytest.raises(ValueError):
        E.embed(records(spark, ["a"]), P.charcode(4), "")


def test_a_failed_run_keeps_what_it_has_paid_for(spark):
    path = scratch_path(spark, "vectors")
    table = records(spark, [f"text {i}" for i in range(300)] + ["text that breaks"]).cache()

    def breaking(texts):
        if "text that breaks" in texts:
            raise ValueError("provider is gone")
        return P.charcode(4)(texts)

    with pytest.raises(Exception, match="provider is gone"):
        E.embed(table, breaking, "m", path, commit_texts=20)
    kept = {r["text_hash"] for r in caches.cached_vectors(spark, path, "m").collect()}
    assert 20 < len(kept) < 301
    paid = {r[TEXT] for r in table.collect() if r["text_hash"] in kept}

    def the_rest(texts):
        assert not paid & set(texts), "paid for twice"
        return P.charcode(4)(texts)

    assert E.embed(table, the_rest, "m", path, commit_texts=20).count() == 301
    assert caches.cached_vectors(spark, path, "m").count() == 301


def test_backoff():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise P.TransientError
        return "ok"

    assert P.call_with_backoff(flaky, 5, 2.0, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(RuntimeError):
        P.call_with_backoff(lambda: (_ for _ in ()).throw(P.TransientError()), 2, sleep=lambda s: None)
    with pytest.raises(KeyError):
        P.call_with_backoff(lambda: {}["x"], 5, sleep=lambda s: None)


def fake_chat(request):
    if "boom" in request["representatives"][0]:
        raise ValueError
    return json.dumps({"label": f"L {request['representatives'][0]}", "summary": "S"})


def test_annotations_and_their_fallbacks(spark):
    path = scratch_path(spark, "annotations")
    table = summaries(spark, [(0, 5, ["a"]), (1, 4, []), (2, 3, ["boom"]), (-1, 9, [])])
    got = {r.cluster_id: (r.label, r.summary) for r in A.annotate(table, fake_chat, "m", path).collect()}
    assert got[0] == ("L a", "S") and got[1] == ("Cluster #1", "(no representative text available)")
    assert got[2] == ("Cluster #2", "(generation failed)") and got[-1][0] == "Unassigned"
    assert caches.cached_annotations(spark, path, "m").count() == 1  # the failure was not kept
    again = A.annotate(table.where("cluster_id = 0"), failing, "m", path).first()
    assert again.label == "L a"


def new_name(request):
    return json.dumps({"label": "new " + request["representatives"][0]})


def test_larger_cluster_keeps_a_shared_label(spark):
    table = summaries(spark, [(1, 100, ["x"]), (2, 10, ["y"]), (3, 100, ["z"]), (4, 1, [])])
    notes = spark.createDataFrame([(1, "same", "s1"), (2, "same", "s2"), (3, "same", "s3"), (4, "same", "s4"), (-1, "same", "")], "cluster_id int, label string, summary string")
    got = {r.cluster_id: (r.label, r.summary) for r in A.resolve_duplicates(notes, table, new_name).collect()}
    assert got[1] == ("same", "s1") and got[2] == ("new y", "s2") and got[3] == ("new z", "s3") and got[4] == ("same", "s4")
    assert A.duplicate_total(notes) == 5 and A.duplicate_labels(notes).first().n == 4
    unique = notes.where("cluster_id < 2 and cluster_id > 0")
    assert A.resolve_duplicates(unique, table, failing).count() == 1


def test_context_fallback(spark):
    def broken(request):
        raise ValueError

    got = A.infer_context(records(spark, [f"t{i % 7}" for i in range(30)]), broken).first()
    assert got.domain == "unknown" and len(set(got.sample_texts)) == 5


def sizes(spark, pairs):
    return spark.createDataFrame(pairs, "cluster_id int, size long")


def best_row(spark):
    return spark.createDataFrame(
        [("kmeans", {"k": 3.0}, 0.1, 4, 600, 2000, 1500, 1536, 30, "faq", 0.5)],
        "algorithm string, params map<string,double>, silhouette double, n_clusters long, n_noise long, n_rows long,"
        " sweep_sample_size long, dim_before int, dim_after int, target string, max_noise_ratio double",
    )


def test_digest(spark):
    table = sizes(spark, [(0, 600), (1, 400), (2, 300), (3, 100), (-1, 600)])
    got = report.run_digest(best_row(spark), table)
    row = got.first()
    assert (row.noise_ratio_pct, row.max_share_pct) == (30.0, 30.0)
    assert row.coverage_top_n[0].pct == pytest.approx(30.0) and row.coverage_top_n_ex_noise[0].pct == pytest.approx(42.857142857)
    assert [t.label for t in row.top_cluster_labels] == ["Cluster #0", "Cluster #1", "Cluster #2", "Cluster #3"]
    block = report.digest_text(got).first().block
    assert "clusters: 4 by kmeans (k=3)" in block and "rows: 2000, in clusters: 1400" in block and "noise 30.0" in block
    assert "1 -> 30.0 / 42.9" in block and "Cluster #0 [600]" in block
    assert advice(got, P.lead_words).first().advice.startswith("4 groups")


def test_faq_tables(spark):
    table = sizes(spark, [(i, 60 - i) for i in range(12)] + [(-1, 8)])
    total = sum(60 - i for i in range(12)) + 8
    got = {r.top_n: (r.rows_covered, r.pct_of_total) for r in report.faq_coverage(table).collect()}
    assert set(got) == {3, 5, 10, 12} and got[3] == (177, pytest.approx(177 * 100 / total))
    row = report.faq_thresholds(table).first()
    assert (row.n_large, row.n_medium, row.noise_rows) == (11, 12, 8)
    assert report.faq_thresholds(sizes(spark, [(-1, 5)])).count() == 0
    marks = [r["rank"] for r in report.pareto(table).where("highlight").orderBy("rank").collect()]
    assert marks == [1, 5, 10, 12]


def test_run_tables(spark):
    items = {r.item: r.value for r in report.run_summary(best_row(spark), "in.csv", "text").collect()}
    assert items["Dimensionality reduction"] == "PCA 1536 → 30 dims" and items["Review recommended"] == "yes"
    assert items["Silhouette score"] == "0.1000 (Needs review)" and items["Parameters"] == "k=3"
    trials = spark.createDataFrame(
        [(0, "kmeans", {"k": 3.0}, float("nan"), 3, 0, 0.4)],
        "trial_ord int, algorithm string, params map<string,double>, silhouette double, n_clusters long, n_noise long, max_cluster_share double",
    )
    meta = report.run_metadata(best_row(spark), trials, "in.csv", "text").first()
    assert meta.quality == "poor" and meta.trials[0].silhouette is None and meta.trials[0].max_cluster_share == 0.4


def test_cluster_list_columns(spark):
    table = summaries(spark, [(0, 2, ["a", "b"]), (1, 9, ["c"]), (-1, 20, [])])
    plain = tables.cluster_list(table, top=2)
    assert plain.columns == ["cluster_id", "cluster_name", "size", "rep_1", "rep_2"]
    rows = plain.collect()
    assert [r.cluster_id for r in rows] == [1, 0, -1] and rows[-1].cluster_name == "Unassigned" and rows[0].rep_2 == ""
    notes = spark.createDataFrame([(0, "zero", "s0")], "cluster_id int, label string, summary string")
    assert "summary" in tables.cluster_list(table, notes).columns
    detail = report.cluster_detail(table, notes).collect()
    assert [d.heading for d in detail] == ["Cluster #1 (9 rows)", "Cluster #0: zero (2 rows)", "Unassigned (noise · 20 rows)"]


def test_csv_to_tables(spark, tmp_path):
    source = tmp_path / "tickets.csv"
    topics = ["parcel arrived late again", "refund was not paid out", "password reset mail missing"]
    lines = [f"{i},{topics[i % 3]} case {i // 3}" for i in range(60)]
    source.write_text("id,note\n" + "\n".join(lines + lines[:5]) + "\n")
    out = job.classify_csv(
        spark, str(source), str(tmp_path / "out"), text_col="note", target="insight", methods=("kmeans", "leiden"),
        chat=P.lead_words, want_advice=True,
    )
    expected = {"classified", "clusters", "run", "cluster_names", "run_summary", "faq_coverage", "pareto", "accepted", "search_chart", "advice"}
    assert expected <= set(os.listdir(out))
    rows = spark.read.options(header="true", escape='"').csv(f"{out}/classified")
    assert rows.count() == 60 and {"id", "note", "cluster_id", "cluster_name", "_duplicate_count"} <= set(rows.columns)
    clusters = spark.read.options(header="true", escape='"').csv(f"{out}/clusters")
    assert clusters.agg(F.sum(F.col("size").cast("int"))).first()[0] == 60


def test_default_column_every_row_and_counts(spark, tmp_path):
    topics = ["parcel arrived late again", "refund was not paid out", "password reset mail missing"]
    lines = [f"{i},{topics[i % 3]} case {i // 3}" for i in range(30)]
    source = tmp_path / "tickets.csv"
    source.write_text("id,note\n" + "\n".join([*lines, *lines[:4], "99,", "=1+1," + "long " * 900]) + "\n")
    out = job.classify_csv(spark, str(source), str(tmp_path / "out"), every_row=True, escape_formulas=True, target="insight", methods=("kmeans",))
    rows = spark.read.options(header="true", escape='"').csv(f"{out}/classified")
    assert rows.count() == 35 and rows.where("id = \"'=1+1\"").count() == 1
    counts = spark.read.parquet(f"{out}/load_counts").first()
    assert (counts.n_rows, counts.n_empty, counts.n_truncated, counts.n_collapsed) == (36, 1, 1, 4)


def test_arguments_of_the_shell_entry():
    from themeloom.__main__ import arguments

    given = arguments(["in.csv", "out", "--text-cols", "a,b", "--column-labels", "a=A", "--every-row", "--max-length", "0"])
    assert (given.input, given.output, given.text_cols, given.every_row, given.max_length) == ("in.csv", "out", "a,b", True, 0)
