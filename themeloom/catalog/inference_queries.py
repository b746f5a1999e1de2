"""Provider calls, caches, annotations and label clean-up."""

import json

from pyspark.sql import functions as F

from themeloom import settings as S
from themeloom.catalog.inputs import (
    LINE_NAMES, RECORDS, SUMMARIES, document_summaries, line_annotations, line_sizes, line_summaries, records,
)
from themeloom.catalog.report_queries import _DIGEST, _digest
from themeloom.catalog.registry import query, table
from themeloom.functions.text import annotation_key
from themeloom.inference import annotate as A, embed as E
from themeloom.inference.advise import advice
from themeloom.inference.providers import TransientError, charcode, lead_words
from themeloom.operators.records import TEXT
from themeloom.runtime import cut, scratch_path
from themeloom.sources import caches

_CHARCODE = f"""WITH {RECORDS}, chars AS (SELECT row_id, (i - 1) % 8 AS slot, unicode(substr(txt, i, 1)) % 17 AS v FROM
  (SELECT row_id, txt, unnest(range(1, length(txt) + 1)) AS i FROM recs))"""


@query("k1_embed_texts", f"{_CHARCODE} SELECT r.row_id, CAST(s.slot AS INTEGER) AS i, CAST(coalesce(sum(c.v), 0) AS DOUBLE) AS x"
       " FROM recs r CROSS JOIN range(8) s(slot) LEFT JOIN chars c ON c.row_id = r.row_id AND c.slot = s.slot GROUP BY r.row_id, s.slot")
def embed(spark, sf):
    got = E.embed(cut(records(spark, sf).select("row_id", "text_hash", TEXT)), charcode(8), "charcode")
    return got.select("row_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


@query(
    "a13_vector_cache",
    f"{_CHARCODE}, norm AS (SELECT row_id, slot, sum(v) AS s FROM chars GROUP BY row_id, slot) SELECT r.text_hash, CAST(sum(s) AS DOUBLE) AS total FROM norm JOIN recs r USING (row_id) GROUP BY r.row_id, r.text_hash",
)
def vector_cache(spark, sf):
    """Two runs on one cache, the second finding the first's vectors there; then the cache itself."""
    path = scratch_path(spark, "vectors")
    recs = cut(records(spark, sf).select("row_id", "text_hash", TEXT, "lang"))
    E.embed(recs.where("lang = 'en'"), charcode(8), "charcode", path)
    E.embed(recs, charcode(8), "charcode", path)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    return caches.cached_vectors(spark, path, "charcode").select("text_hash", total.alias("total"))


_TEXT_SUMS = f"{_CHARCODE} SELECT r.row_id, CAST(coalesce(sum(c.v), 0) AS DOUBLE) AS total FROM recs r LEFT JOIN chars c ON c.row_id = r.row_id GROUP BY r.row_id"


def no_embedding(texts):
    raise ValueError("nobody should ask")


@query("d3_cache_lookup", _TEXT_SUMS)
def cache_lookup(spark, sf):
    """Every record finds its text's vector in a cache that has them all; the provider would fail."""
    path = scratch_path(spark, "vectors")
    recs = cut(records(spark, sf).select("row_id", "text_hash", TEXT))
    E.embed(recs, charcode(8), "charcode", path)
    return E.embed(recs, no_embedding, "charcode", path).select("row_id", _total().alias("total"))


def _total():
    return F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)


_ATTEMPTS: dict = {}  # of a Python worker


def unsteady(texts):
    """Fails twice for every batch before it answers."""
    tries = _ATTEMPTS[texts[0]] = _ATTEMPTS.get(texts[0], 0) + 1
    if tries % 3:
        raise TransientError("busy")
    return charcode(8)(texts)


@query("k2_retries", _TEXT_SUMS)
def retries(spark, sf):
    recs = cut(records(spark, sf).select("row_id", "text_hash", TEXT))
    return E.embed(recs, unsteady, "unsteady", base_seconds=0.001).select("row_id", _total().alias("total"))


@query("k1_hashing_tfidf")
def hashing(spark, sf):
    return E.hashing_tfidf(records(spark, sf), 64)


@query(
    "g7_sample_texts",
    f"""WITH {RECORDS}, d AS (SELECT min(row_id) AS row_id, min(txt) AS txt FROM recs GROUP BY text_hash)
    SELECT CAST(row_number() OVER (ORDER BY sha256(CAST(row_id AS VARCHAR) || '|42'), row_id) AS INTEGER) AS sample_rank, row_id, txt AS text FROM d
    ORDER BY sample_rank LIMIT 5""",
)
def sample_texts(spark, sf):
    return A.sample_texts(records(spark, sf))


def lead_sample(request: dict) -> str:
    """The first words of the first sample, and how many samples there are."""
    samples = request["samples"]
    return json.dumps({"domain": " ".join(samples[0].split(" ")[:3]), "granularity_hint": f"{len(samples)} samples"}, ensure_ascii=False)


@query(
    "k3_dataset_context",
    f"""WITH {RECORDS}, d AS (SELECT min(row_id) AS row_id, min(txt) AS txt FROM recs GROUP BY text_hash),
    k AS (SELECT *, row_number() OVER (ORDER BY sha256(CAST(row_id AS VARCHAR) || '|42'), row_id) AS rk FROM d)
    SELECT array_to_string(string_split(max(txt) FILTER (rk = 1), ' ')[1:3], ' ') AS domain, count(*) || ' samples' AS granularity_hint, count(*) AS n_samples FROM k WHERE rk <= 5""",
)
def context(spark, sf):
    got = A.infer_context(records(spark, sf), lead_sample)
    return got.select("domain", "granularity_hint", F.size("sample_texts").cast("long").alias("n_samples"))


_BARE = "translate(array_to_string(string_split(txt, ' ')[1:3], ' '), '\"''「」『』`', '')"


@query(
    "k4_annotate_clusters",
    f"""WITH {SUMMARIES} SELECT s.cid AS cluster_id,
      CASE WHEN s.cid = -1 THEN 'Unassigned' ELSE (SELECT substr(trim({_BARE}), 1, 30) FROM reps WHERE reps.cid = s.cid AND rk = 1) END AS label,
      CASE WHEN s.cid = -1 THEN '{S.NOISE_SUMMARY}' ELSE (SELECT trim(substr(txt, 1, 100)) FROM reps WHERE reps.cid = s.cid AND rk = 1) END AS summary
    FROM csize s""",
)
def annotations(spark, sf):
    """Asked twice over one cache; the second run must find all of it there."""
    path = scratch_path(spark, "annotations")
    summaries = cut(document_summaries(spark, sf))
    A.annotate(summaries, lead_words, "offline", path)
    return A.annotate(summaries, no_answer, "offline", path)


def no_answer(request: dict) -> str:
    raise ValueError("nobody should ask")


def own_text(request: dict) -> str:
    """The first representative is the label; no summary."""
    return json.dumps({"label": request["representatives"][0]})


@query(
    "k5_labels_only",
    f"WITH {LINE_NAMES} SELECT cluster_id, label FROM ann",
)
def labels_only(spark, sf):
    return A.labels_only(line_annotations(spark, sf))


@query(
    "d5_assemble_annotations",
    f"""WITH a AS (SELECT CAST(p_partkey AS INTEGER) - 1 AS cid, p_name, p_type, p_brand, p_size FROM part)
    SELECT cid AS cluster_id,
      CASE WHEN cid = -1 THEN 'Unassigned' WHEN p_size > 40 OR p_brand = 'Brand#1' THEN 'Cluster #' || cid ELSE p_type END AS label,
      CASE WHEN cid = -1 THEN '{S.NOISE_SUMMARY}' WHEN p_size > 40 THEN '(no representative text available)'
           WHEN p_brand = 'Brand#1' THEN '(generation failed)' ELSE 'made by ' || p_brand END AS summary FROM a""",
)
def assemble(spark, sf):
    """Parts as clusters. Big ones have no representatives, and one brand's annotations never came."""
    parts = table(spark, sf, "part")
    rep = F.array(F.struct(F.lit(1).alias("rank"), F.col("p_partkey").alias("row_id"), F.lit(1.0).alias("similarity"), F.concat_ws(" ", "p_partkey", "p_name").alias("text")))
    summaries = parts.select(
        (F.col("p_partkey") - 1).cast("int").alias("cluster_id"), F.col("p_size").cast("bigint").alias("size"),
        F.when(F.col("p_size") <= 40, rep).otherwise(F.slice(rep, 1, 0)).alias("reps"), "p_brand", "p_type",
    )
    cache = summaries.where("p_brand <> 'Brand#1' and size(reps) > 0").select(
        annotation_key(A.rep_texts(), F.lit("")).alias("cache_key"), F.col("p_type").alias("label"), F.concat(F.lit("made by "), "p_brand").alias("summary")
    )
    return A.assemble(summaries.drop("p_brand", "p_type"), cache)


@query("e8_duplicate_labels", f"WITH {LINE_NAMES} SELECT label, count(*) AS n FROM ann WHERE cluster_id <> -1 GROUP BY label HAVING count(*) >= 2")
def duplicate_labels(spark, sf):
    return A.duplicate_labels(line_annotations(spark, sf))


@query("e8_label_frequencies", "SELECT p_type AS label, count(*) AS n FROM part GROUP BY p_type")
def label_frequencies(spark, sf):
    return A.label_frequencies(table(spark, sf, "part").select(F.col("p_partkey").alias("cluster_id"), F.col("p_type").alias("label")))


@query("d6_keepers_and_losers", f"WITH {LINE_NAMES} SELECT label, cluster_id, keeper_id FROM lose")
def keepers(spark, sf):
    return A.keepers_and_losers(line_annotations(spark, sf), line_sizes(spark, sf))


@query(
    "f6_keeper_rank",
    f"WITH {LINE_NAMES} SELECT k.label, k.keeper_id, s.size FROM keep k JOIN sized s ON s.cluster_id = k.keeper_id",
)
def keeper_rank(spark, sf):
    lost = A.keepers_and_losers(line_annotations(spark, sf), line_sizes(spark, sf)).select("label", "keeper_id").distinct()
    return lost.join(line_sizes(spark, sf).withColumnRenamed("cluster_id", "keeper_id"), "keeper_id").select("label", "keeper_id", "size")


@query(
    "k6_resolve_duplicates",
    f"WITH {LINE_NAMES} SELECT a.cluster_id, CASE WHEN l.cluster_id IS NULL THEN a.label ELSE a.summary END AS label, a.summary FROM ann a LEFT JOIN lose l USING (cluster_id)",
)
def resolve(spark, sf):
    return A.resolve_duplicates(line_annotations(spark, sf), cut(line_summaries(spark, sf)), own_text)


@query(
    "k7_advice",
    f"""{_DIGEST} SELECT CAST(w.n_clusters AS BIGINT) || ' groups, ' || printf('%.1f', w.n_noise * 100.0::DOUBLE / t.total) || '% not grouped: ' ||
      CASE WHEN t.largest * 100.0::DOUBLE / t.total > 10 THEN 'split the largest group' ELSE 'keep the present grouping' END || '.' AS advice
    FROM winner w, tot t""",
)
def run_advice(spark, sf):
    return advice(_digest(spark, sf), lead_words)
