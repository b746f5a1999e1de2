"""Text and score expressions over whole tables."""

from pyspark.sql import functions as F

from themeloom import settings as S
from themeloom.catalog.inputs import NORMALIZED, RECORDS, TRIALS, documents, records, trials
from themeloom.catalog.registry import query, r6, table
from themeloom.functions import scoring, text as T
from themeloom.operators import records as R

# DuckDB's trim takes the characters to strip; the texts hold spaces and line feeds only.
STRIP = "trim({0}, ' ' || chr(10))"
LINES = "list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query("b1_normalize_text", f"SELECT doc_id AS row_id, CASE WHEN lower(trim(text)) = 'nan' THEN '' ELSE {NORMALIZED} END AS normalized FROM documents")
def normalize(spark, sf):
    return documents(spark, sf).select("row_id", T.normalize_text(F.col("text")).alias("normalized"))


@query(
    "b2_multi_column_text",
    r"SELECT conv_id, turn, 'speaker: ' || role || ' text: ' || trim(regexp_replace(text, '\s+', ' ', 'g')) AS normalized FROM conversations",
)
def multi_column(spark, sf):
    return R.with_text(table(spark, sf, "conversations"), text_cols=["role", "text"], labels={"role": "speaker"}).select(
        "conv_id", "turn", F.col(R.TEXT).alias("normalized")
    )


@query(
    "b3_column_spec_text",
    "SELECT p_partkey, 'Name: ' || p_name || ' Maker: ' || p_brand || ' p_type: ' || p_type AS normalized FROM part",
)
def column_spec(spark, sf):
    names, labels = R.parse_column_specs(None, "p_name, p_brand, p_type", "p_name=Name,p_brand=Maker")
    return R.with_text(table(spark, sf, "part"), text_cols=names, labels=labels).select("p_partkey", F.col(R.TEXT).alias("normalized"))


@query("b4_truncate", "SELECT doc_id AS row_id, substr(text, 1, 4000) AS cut, CAST(length(text) > 4000 AS BOOLEAN) AS was_longer FROM documents")
def truncate(spark, sf):
    return documents(spark, sf).select(
        "row_id", T.truncate(F.col("text")).alias("cut"), (F.length("text") > S.MAX_TEXT_LENGTH).alias("was_longer")
    )


@query("b5_content_hash", "SELECT doc_id AS row_id, sha256(text) AS text_hash FROM documents")
def content_hash(spark, sf):
    return documents(spark, sf).select("row_id", T.content_hash(F.col("text")).alias("text_hash"))


@query(
    "b6_annotation_key",
    "SELECT p_partkey, sha256(p_name || chr(10) || p_brand || chr(10) || p_type || '||' || 'parts') AS cache_key FROM part",
)
def annotation_key(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", T.annotation_key(F.array("p_name", "p_brand", "p_type"), F.lit("parts")).alias("cache_key")
    )


def _short(expression, n):
    return f"CASE WHEN length({expression}) > {n} THEN substr({expression}, 1, {n}) || '…' ELSE {expression} END"


_FLAT = "replace(text, chr(10), ' ')"


@query(
    "b7_shorten_texts",
    f"SELECT doc_id AS row_id, {_short(f'trim({_FLAT})', 500)} AS prompt, {_short(_FLAT, 200)} AS report, {_short('text', 40)} AS preview FROM documents",
)
def shorten(spark, sf):
    return documents(spark, sf).select(
        "row_id", T.prompt_line(F.col("text")).alias("prompt"), T.report_line(F.col("text")).alias("report"),
        T.shorten(F.col("text"), 40).alias("preview"),
    )


_LABEL_BARE = "translate(trim('「' || text || '\"', ' ' || chr(10)), '\"''「」『』`', '')"
_LABEL_FIRST = f"coalesce({LINES.format(_LABEL_BARE)}[1], {_LABEL_BARE})"


@query(
    "b8_sanitize_label",
    f"SELECT doc_id AS row_id, CASE WHEN substr({_LABEL_FIRST}, 1, 30) = '' THEN 'Untitled' ELSE substr({_LABEL_FIRST}, 1, 30) END AS label FROM documents",
)
def sanitize_label(spark, sf):
    wrapped = F.concat(F.lit("「"), "text", F.lit('"'))
    return documents(spark, sf).select("row_id", T.sanitize_label(wrapped).alias("label"))


_SUMMARY = f"array_to_string({LINES.format(STRIP.format('text'))}, ' ')"


@query(
    "b9_sanitize_summary",
    f"SELECT doc_id AS row_id, CASE WHEN {_SUMMARY} = '' THEN '(no summary)' ELSE {_short(_SUMMARY, 400)} END AS summary FROM documents",
)
def sanitize_summary(spark, sf):
    wrapped = F.concat(F.lit('"'), "text", F.lit(' "'))
    return documents(spark, sf).select("row_id", T.sanitize_summary(wrapped).alias("summary"))


_JSON_TEXT = STRIP.format("text")
_JSON_BARE = f"translate({_JSON_TEXT}, '\"''「」『』`', '')"
_JSON_LABEL = f"substr(coalesce({LINES.format(_JSON_BARE)}[1], {_JSON_BARE}), 1, 30)"


@query(
    "b10_parse_annotation",
    f"""SELECT conv_id, turn,
      CASE WHEN turn = 0 THEN 'Parse failure' WHEN {_JSON_LABEL} = '' THEN 'Untitled' ELSE {_JSON_LABEL} END AS label,
      CASE WHEN turn = 0 THEN substr({_JSON_TEXT}, 1, 200) ELSE role END AS summary FROM conversations""",
)
def parse_annotation(spark, sf):
    """First turns are left as prose, which is no JSON; the others are JSON, half of them fenced."""
    reply = F.to_json(F.struct(F.col("text").alias("label"), F.col("role").alias("summary")))
    fenced = F.concat(F.lit("```json\n"), reply, F.lit("\n```"))
    raw = F.when(F.col("turn") == 0, F.col("text")).when(F.col("role") == "user", reply).otherwise(fenced)
    return table(spark, sf, "conversations").select("conv_id", "turn", T.parse_annotation(raw)).select(
        "conv_id", "turn", "annotation.label", "annotation.summary"
    )


@query("b11_unfence_markdown", f"SELECT doc_id AS row_id, {STRIP.format('text')} AS body FROM documents")
def unfence(spark, sf):
    """Each language's texts come in another kind of fence; all of them come off again."""
    opening = (
        F.when(F.col("lang") == "en", "```markdown\n").when(F.col("lang") == "fr", "```md\n").when(F.col("lang") == "de", "```\n").otherwise("")
    )
    closing = F.when(opening == "", "").otherwise("\n```")
    return documents(spark, sf).select("row_id", T.unfence_markdown(F.concat(opening, "text", closing)).alias("body"))


@query(
    "b12_grounding_hint",
    "SELECT p_partkey, 'Domain of the texts: ' || p_name || '. How fine labels should be: ' || p_type ||"
    " '. Name things the texts speak of, not kinds of things.' AS hint FROM part",
)
def grounding(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.grounding_hint(F.col("p_name"), F.col("p_type")).alias("hint"))


@query("b13_format_params", f"WITH {TRIALS} SELECT trial AS trial_ord, params, tick, n_clusters FROM trials")
def format_params(spark, sf):
    tags = F.create_map(*[F.lit(x) for item in S.METHOD_TAGS.items() for x in item])
    return trials(spark, sf).select(
        "trial_ord", T.format_params(F.col("params")).alias("params"),
        F.concat(tags[F.col("algorithm")], F.lit(":"), T.compact_params(F.col("params"))).alias("tick"), "n_clusters",
    )


@query(
    "b13_part_params",
    """WITH p AS (SELECT p_partkey, p_size, p_retailprice / 1000 AS r, p_partkey % 3 AS kind FROM part)
    SELECT p_partkey, CASE kind WHEN 0 THEN 'k=' || CAST(p_size AS BIGINT)
        WHEN 1 THEN 'min_cluster_size=' || CAST(p_size AS BIGINT) || ', min_samples=5'
        ELSE 'resolution=' || printf('%.3f', r) || ', n_neighbors=' || CAST(p_size AS BIGINT) END AS params,
      CASE kind WHEN 0 THEN 'k=' || CAST(p_size AS BIGINT) WHEN 1 THEN 'mcs=' || CAST(p_size AS BIGINT) ELSE 'res=' || printf('%.1f', r) END AS tick FROM p""",
)
def part_params(spark, sf):
    """Parameter sets of three kinds, read off the parts."""
    size = F.col("p_size").cast("double")
    kinds = [
        F.create_map(F.lit("k"), size), F.create_map(F.lit("min_samples"), F.lit(5.0), F.lit("min_cluster_size"), size),
        F.create_map(F.lit("n_neighbors"), size, F.lit("resolution"), F.col("p_retailprice") / 1000),
    ]
    kind = F.col("p_partkey") % 3
    params = F.when(kind == 0, kinds[0]).when(kind == 1, kinds[1]).otherwise(kinds[2])
    return table(spark, sf, "part").withColumn("params", params).select(
        "p_partkey", T.format_params(F.col("params")).alias("params"), T.compact_params(F.col("params")).alias("tick")
    )


@query(
    "b14_candidate_score",
    """SELECT l_orderkey, l_linenumber, round(l_quantity * (1 - l_discount) * (0.5 + 0.5 * u) *
         (CASE WHEN u >= 0.9 THEN 0.3 WHEN u >= 0.8 THEN 0.6 ELSE 1 END), 6) AS score
       FROM (SELECT *, l_tax * 12.5 AS u FROM lineitem)""",
)
def candidate_score(spark, sf):
    score = scoring.candidate_score(F.col("l_quantity"), 1 - F.col("l_discount"), F.col("l_tax") * 12.5)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(score).alias("score"))


@query(
    "b15_quality_flag",
    """SELECT event_id, CASE WHEN v >= 0.4 THEN 'good' WHEN v >= 0.2 THEN 'warn' ELSE 'poor' END AS flag,
         CASE WHEN v >= 0.4 THEN 'Good' WHEN v >= 0.2 THEN 'Acceptable (with caveats)' ELSE 'Needs review' END AS shown
       FROM (SELECT event_id, value / 100 AS v FROM events)""",
)
def quality(spark, sf):
    flag = scoring.quality_flag(F.col("value") / 100)
    return table(spark, sf, "events").select("event_id", flag.alias("flag"), scoring.quality_label(flag).alias("shown"))


def _per_target(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") * 4).alias("n"), ((F.col("p_retailprice") - 900) / 1200).alias("share"),
        F.explode(F.array(*[F.lit(t) for t in S.TARGETS])).alias("target"),
    )


_PER_TARGET = """parts AS (SELECT p_partkey, p_size * 4 AS n, (p_retailprice - 900) / 1200 AS share, target, low, high, budget FROM part,
  (VALUES ('faq', 30, 80, 0.10::DOUBLE), ('chatbot', 50, 150, 0.07::DOUBLE), ('insight', NULL, NULL, 1.0::DOUBLE)) t(target, low, high, budget)),
fits AS (SELECT *, CASE WHEN low IS NULL THEN 1 WHEN n < low THEN greatest(0.1, n / low) WHEN n > high THEN greatest(0.3, 1 - (n - high) / (2.5 * high)) ELSE 1 END AS fit,
  CASE WHEN share <= budget THEN 1 ELSE greatest(0.2, 1 - 3 * (share - budget)) END AS penalty FROM parts)"""


@query("b16_granularity_fit", f"WITH {_PER_TARGET} SELECT p_partkey, target, round(fit, 6) AS fit FROM fits")
def granularity(spark, sf):
    return _per_target(spark, sf).select("p_partkey", "target", r6(scoring.granularity_fit(F.col("n"), F.col("target"))).alias("fit"))


@query("b17_share_penalty", f"WITH {_PER_TARGET} SELECT p_partkey, target, round(penalty, 6) AS penalty FROM fits")
def share(spark, sf):
    return _per_target(spark, sf).select("p_partkey", "target", r6(scoring.share_penalty(F.col("share"), F.col("target"))).alias("penalty"))


@query(
    "b18_target_score",
    f"WITH {TRIALS} SELECT trial AS trial_ord, round(faq, 6) AS faq_score, round(chatbot, 6) AS chatbot_score, round(insight, 6) AS insight_score FROM scored",
)
def target_score(spark, sf):
    from themeloom.plans.trials import with_scores

    scored = with_scores(trials(spark, sf), S.DEFAULT_TARGET)
    return scored.select("trial_ord", r6("faq_score").alias("faq_score"), r6("chatbot_score").alias("chatbot_score"), r6("insight_score").alias("insight_score"))


@query(
    "c1_drop_empty",
    r"SELECT count(*) AS n_rows, count(*) FILTER (t = '') AS n_empty, count(*) FILTER (length(t) > 4000) AS n_truncated FROM"
    r" (SELECT CASE WHEN lang = 'de' THEN '' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS t FROM documents)",
)
def drop_empty(spark, sf):
    """German texts are blanked out or made "nan" first, so that there is something to drop."""
    blanked = F.when(F.col("lang") == "de", F.when(F.col("n_chars") > 1000, " NaN ").otherwise("  \n")).otherwise(F.col("text"))
    return R.load_metrics(R.with_text(documents(spark, sf).withColumn("text", blanked), text_col="text"))


@query(
    "e1_load_records",
    f"WITH {RECORDS} SELECT r.row_id, substr(r.txt, 1, 4000) AS normalized, sha256(substr(r.txt, 1, 4000)) AS text_hash, r.dup AS duplicate_count, d.lang, d.source "
    "FROM recs r JOIN documents d ON d.doc_id = r.row_id",
)
def load(spark, sf):
    """Unique documents, cut to the limit."""
    return R.load_records(documents(spark, sf), text_col="text").select(
        "row_id", F.col(R.TEXT).alias("normalized"), "text_hash", F.col(R.COUNT).alias("duplicate_count"), "lang", "source"
    )


@query("d1_duplicate_groups", f"WITH {RECORDS} SELECT row_id, dup AS duplicate_count FROM recs WHERE dup > 1")
def duplicate_groups(spark, sf):
    return records(spark, sf).where(F.col(R.COUNT) > 1).select("row_id", F.col(R.COUNT).alias("duplicate_count"))


@query("f3_keep_first", "SELECT min(doc_id) AS row_id, sha256(text) AS text_hash, min_by(lang, doc_id) AS lang FROM documents GROUP BY text")
def keep_first(spark, sf):
    return R.collapse_duplicates(documents(spark, sf), text="text").select("row_id", "text_hash", "lang")


@query("h3_distinct_in_order", "SELECT p_name, min(p_partkey) AS first_part FROM part GROUP BY p_name")
def distinct_in_order(spark, sf):
    parts = table(spark, sf, "part").withColumnRenamed("p_partkey", "row_id")
    return R.collapse_duplicates(parts.select("row_id", "p_name"), text="p_name").select("p_name", F.col("row_id").alias("first_part"))
