"""Views of the test tables that the queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom import settings as S
from themeloom.catalog.registry import table
from themeloom.operators.clusters import cluster_sizes, summarize_clusters, unit_vectors
from themeloom.operators.records import load_records
from themeloom.plans import trials as tr
from themeloom.runtime import cut


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "row_id")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Unique documents, each whole."""
    return load_records(documents(spark, sf), text_col="text", max_length=None)


NORMALIZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
RECORDS = f"""
whole AS (SELECT doc_id, {NORMALIZED} AS t FROM documents),
uniq AS (SELECT min(doc_id) AS row_id, t, count(*) AS dup FROM whole WHERE t <> '' AND lower(t) <> 'nan' GROUP BY t),
recs AS (SELECT row_id, t AS txt, sha256(t) AS text_hash, dup FROM uniq)
"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    return unit_vectors(named)


def given_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("cluster_id"))


# Unit vectors, whole and as one row per component.
VECTORS = """
norms AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nrm FROM embeddings),
unit AS (SELECT vec_id, label, list_transform(e, lambda x: x / nrm) AS v FROM norms),
parts AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM unit)
"""


# Letters whose counts stand for a document's vector, so that SQL can compute the same.
COUNTED = "aeinorst"


def document_labels(recs: DataFrame) -> DataFrame:
    """A cluster for every record: the number of its source; Spanish plays noise."""
    number = F.substring("source", 4, 9).cast("int")
    return recs.select("row_id", F.when(F.col("lang") == "es", S.NOISE).otherwise(number).cast("int").alias("cluster_id"))


def document_vectors(recs: DataFrame) -> DataFrame:
    """A unit vector for every record, from counts of letters in its text."""
    text = F.col("_normalized_text")
    counts = [(F.length(text) - F.length(F.replace(text, F.lit(x)))).cast("double") for x in COUNTED]
    return unit_vectors(recs.select("row_id", F.array(F.lit(1.0), *counts).alias("embedding")))


def document_summaries(spark: SparkSession, sf: str, top: int = 3) -> DataFrame:
    recs = cut(records(spark, sf).select("row_id", "_normalized_text", "lang", "source"))
    return summarize_clusters(recs, cut(document_vectors(recs)), cut(document_labels(recs)), top)


# The same labels and vectors; the nearest three records of each cluster; sizes.
SUMMARIES = f"""
{RECORDS},
dlab AS (SELECT r.row_id AS vec_id, CASE WHEN d.lang = 'es' THEN -1 ELSE CAST(substr(d.source, 4) AS INTEGER) END AS cid,
  [1.0, {", ".join(f"length(r.txt) - length(replace(r.txt, '{x}', ''))" for x in COUNTED)}]::DOUBLE[] AS e
  FROM recs r JOIN documents d ON d.doc_id = r.row_id),
lab AS (SELECT vec_id, cid, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM dlab),
dpart AS (SELECT vec_id, cid, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM lab),
mean AS (SELECT cid, i, avg(x) AS m FROM dpart WHERE cid <> -1 GROUP BY cid, i),
center AS (SELECT cid, list(m / s ORDER BY i) AS c FROM (SELECT cid, i, m, sqrt(sum(m * m) OVER (PARTITION BY cid)) AS s FROM mean) GROUP BY cid),
near AS (SELECT l.cid, l.vec_id, round(list_dot_product(l.v, c.c), 9) AS sim FROM lab l JOIN center c USING (cid)),
ranked AS (SELECT cid, vec_id, sim, row_number() OVER (PARTITION BY cid ORDER BY sim DESC, vec_id) AS rk FROM near),
reps AS (SELECT k.cid, k.vec_id, k.sim, k.rk, r.txt FROM ranked k JOIN recs r ON r.row_id = k.vec_id WHERE k.rk <= 3),
csize AS (SELECT cid, count(*) AS size FROM lab GROUP BY cid)
"""


def line_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines grouped by supplier; returned ones play noise."""
    noise = F.when(F.col("l_returnflag") == "R", S.NOISE).otherwise(F.col("l_suppkey"))
    return table(spark, sf, "lineitem").select(noise.cast("int").alias("cluster_id"))


def line_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return cluster_sizes(line_labels(spark, sf))


SIZES = """
sz AS (SELECT CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE l_suppkey END AS INTEGER) AS cluster_id, count(*) AS size
       FROM lineitem GROUP BY 1),
tot AS (SELECT sum(size) AS total, sum(CASE WHEN cluster_id <> -1 THEN size ELSE 0 END) AS clustered,
               sum(CASE WHEN cluster_id = -1 THEN size ELSE 0 END) AS noise,
               max(CASE WHEN cluster_id <> -1 THEN size ELSE 0 END) AS largest,
               count(*) FILTER (cluster_id <> -1) AS k FROM sz),
cov AS (SELECT row_number() OVER w AS rank, cluster_id, size, sum(size) OVER w AS running, total, clustered, k
        FROM sz, tot WHERE cluster_id <> -1
        WINDOW w AS (ORDER BY size DESC, cluster_id ROWS UNBOUNDED PRECEDING))
"""

# A sweep read off the given labels: each trial merges neighbouring labels, or calls the low ones noise.
# (algorithm, params, labels below this are noise, labels merged into one cluster)
TRIAL_GRID = [
    ("kmeans", {"k": 2.0}, 0, 5),
    ("kmeans", {"k": 5.0}, 0, 2),
    ("kmeans", {"k": 10.0}, 0, 1),
    ("hdbscan", {"min_cluster_size": 5.0, "min_samples": 5.0}, 1, 1),
    ("hdbscan", {"min_cluster_size": 10.0, "min_samples": 5.0}, 3, 2),
    ("hdbscan", {"min_cluster_size": 50.0, "min_samples": 5.0}, 6, 1),
    ("leiden", {"resolution": 0.3, "n_neighbors": 15.0}, 0, 10),
    ("leiden", {"resolution": 1.0, "n_neighbors": 15.0}, 0, 3),
]


def trial_specs(spark: SparkSession) -> DataFrame:
    rows = [(i, algorithm, params) for i, (algorithm, params, _, _) in enumerate(TRIAL_GRID)]
    return spark.createDataFrame(rows, "trial_ord int, algorithm string, params map<string,double>")


def trial_labels(spark: SparkSession, sf: str) -> DataFrame:
    given = given_labels(spark, sf)
    sweeps = []
    for _, _, below, merged in TRIAL_GRID:
        cluster = F.when(F.col("cluster_id") < below, S.NOISE).otherwise(F.floor((F.col("cluster_id") - below) / merged))
        sweeps.append(given.select("row_id", cluster.cast("int").alias("cluster_id")))
    return tr.stack_labels(sweeps)


def trials(spark: SparkSession, sf: str) -> DataFrame:
    return cut(tr.build_trials(vectors(spark, sf), trial_labels(spark, sf), trial_specs(spark)))


def _params_text(params: dict[str, float]) -> str:
    return ", ".join(f"{k}={v:.3f}" if k in S.REAL_PARAMS else f"{k}={int(v)}" for k, v in params.items())


def _tick(algorithm: str, params: dict[str, float]) -> str:
    name, value = next(iter(params.items()))
    short = {"k": "k", "min_cluster_size": "mcs", "resolution": "res"}[name]
    shown = f"{value:.1f}" if name in S.REAL_PARAMS else str(int(value))
    return f"{S.METHOD_TAGS[algorithm]}:{short}={shown}"


GRID_ROWS = ", ".join(
    f"({i}, '{a}', '{_params_text(p)}', '{_tick(a, p)}', {below}, {merged})"
    for i, (a, p, below, merged) in enumerate(TRIAL_GRID)
)
TRIALS = f"""
{VECTORS},
grid(trial, algorithm, params, tick, below, merged) AS (VALUES {GRID_ROWS}),
lab AS (SELECT trial, vec_id, CASE WHEN label < below THEN -1 ELSE CAST(floor((label - below) / merged) AS INTEGER) END AS c
        FROM embeddings, grid),
csum AS (SELECT l.trial, l.c, p.i, sum(p.x) AS s FROM lab l JOIN parts p USING (vec_id) WHERE l.c <> -1 GROUP BY ALL),
cnum AS (SELECT trial, c, count(*) AS n FROM lab GROUP BY ALL),
dist AS (SELECT l.trial, l.vec_id, l.c AS own, s.c AS other, any_value(n.n) AS n, 1 - sum(p.x * s.s) / any_value(n.n) AS d
         FROM lab l JOIN parts p USING (vec_id) JOIN csum s ON s.trial = l.trial AND s.i = p.i
         JOIN cnum n ON n.trial = s.trial AND n.c = s.c WHERE l.c <> -1 GROUP BY l.trial, l.vec_id, l.c, s.c),
ab AS (SELECT trial, vec_id, own, max(CASE WHEN own = other THEN n END) AS n,
              max(CASE WHEN own = other THEN d * n / greatest(n - 1, 1) END) AS a,
              min(CASE WHEN own <> other THEN d END) AS b FROM dist GROUP BY ALL),
sil AS (SELECT trial, avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette
        FROM ab GROUP BY trial HAVING count(DISTINCT own) >= 2 AND max(n) > 1),
cnt AS (SELECT trial, count(*) FILTER (c <> -1) AS n_clusters, coalesce(sum(n) FILTER (c = -1), 0) AS n_noise,
               coalesce(max(n) FILTER (c <> -1), 0) / sum(n) AS share, sum(n) AS total FROM cnum GROUP BY trial),
trials AS (SELECT g.trial, g.algorithm, g.params, g.tick, s.silhouette, c.n_clusters, c.n_noise, c.share, c.total,
                  c.n_noise / c.total AS ratio
           FROM grid g JOIN cnt c USING (trial) LEFT JOIN sil s USING (trial)),
base AS (SELECT *, greatest(coalesce(silhouette, 0), 0.05) AS floor_sil FROM trials),
scored AS (SELECT *,
  floor_sil * (CASE WHEN n_clusters < 30 THEN greatest(0.1, n_clusters / 30) WHEN n_clusters > 80 THEN greatest(0.3, 1 - (n_clusters - 80) / 200.0) ELSE 1 END)
            * (CASE WHEN share <= 0.10 THEN 1 ELSE greatest(0.2, 1 - 3 * (share - 0.10)) END) AS faq,
  floor_sil * (CASE WHEN n_clusters < 50 THEN greatest(0.1, n_clusters / 50) WHEN n_clusters > 150 THEN greatest(0.3, 1 - (n_clusters - 150) / 375.0) ELSE 1 END)
            * (CASE WHEN share <= 0.07 THEN 1 ELSE greatest(0.2, 1 - 3 * (share - 0.07)) END) AS chatbot,
  floor_sil AS insight,
  CASE WHEN silhouette IS NULL OR n_clusters < 2 THEN 'rejected_degenerate' WHEN ratio > 0.5 THEN 'rejected_noise' ELSE 'accepted' END AS status
  FROM base),
winner AS (SELECT * FROM scored WHERE silhouette IS NOT NULL AND silhouette > -1 ORDER BY (ratio <= 0.5) DESC, faq DESC, trial LIMIT 1),
charted AS (SELECT trial, row_number() OVER (ORDER BY silhouette DESC, trial) AS chart_rank FROM scored WHERE silhouette IS NOT NULL)
"""


def run_row(spark: SparkSession, sf: str, tried: DataFrame, target: str = S.DEFAULT_TARGET) -> DataFrame:
    """The run table of that sweep: one row, the winner and the table's measures."""
    measures = table(spark, sf, "embeddings").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")
    ).first()
    won = tr.select_winner(tried, measures["n"], target)
    return won.select(
        "trial_ord", "algorithm", "params", "silhouette", "n_clusters", "n_noise", F.lit(measures["n"]).alias("n_rows"),
        F.lit(measures["n"]).alias("sweep_sample_size"), F.lit(measures["d"]).alias("dim_before"),
        F.lit(measures["d"]).alias("dim_after"), F.lit(target).alias("target"), F.lit(S.MAX_NOISE_RATIO).alias("max_noise_ratio"),
    )


def line_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as clusters, labelled by their nation, so that many share a label."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    named = table(spark, sf, "supplier").join(nation, "s_nationkey")
    return named.select(F.col("s_suppkey").cast("int").alias("cluster_id"), F.col("n_name").alias("label"), F.col("s_name").alias("summary"))


def line_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier clusters with the supplier's name as the only representative."""
    rep = F.struct(F.lit(1).alias("rank"), F.col("cluster_id").cast("bigint").alias("row_id"), F.lit(1.0).alias("similarity"), F.col("summary").alias("text"))
    named = line_annotations(spark, sf).select("cluster_id", F.array(rep).alias("reps"))
    empty = F.array().cast("array<struct<rank:int,row_id:bigint,similarity:double,text:string>>")
    return line_sizes(spark, sf).join(named, "cluster_id", "left").select("cluster_id", "size", F.coalesce("reps", empty).alias("reps"))


LINE_NAMES = f"""
{SIZES},
ann AS (SELECT CAST(s_suppkey AS INTEGER) AS cluster_id, n_name AS label, s_name AS summary FROM supplier JOIN nation ON n_nationkey = s_nationkey),
sized AS (SELECT a.cluster_id, a.label, a.summary, s.size FROM ann a JOIN sz s USING (cluster_id)),
keep AS (SELECT label, cluster_id AS keeper_id, n FROM (SELECT label, cluster_id, count(*) OVER (PARTITION BY label) AS n,
         row_number() OVER (PARTITION BY label ORDER BY size DESC, cluster_id) AS rn FROM sized) WHERE rn = 1 AND n >= 2),
lose AS (SELECT s.label, s.cluster_id, k.keeper_id FROM sized s JOIN keep k USING (label) WHERE s.cluster_id <> k.keeper_id)
"""
