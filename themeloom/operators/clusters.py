"""Sizes, centroids, representatives and counts of a labelled row set.

A label table holds `row_id, cluster_id`, with -1 for noise; vectors are
`row_id, embedding`.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom import settings as S
from themeloom.functions import vectors as V
from themeloom.operators.ranking import numbered
from themeloom.runtime import cut

CENTROID_BUDGET_BYTES = 32 << 20
SALTS = 32

def is_noise() -> Column:
    return F.col("cluster_id") == S.NOISE


def cluster_order() -> list[Column]:
    """Largest first, noise last."""
    return [is_noise().asc(), F.desc("size"), F.asc("cluster_id")]


def id_order() -> list[Column]:
    """Ascending ids, noise last."""
    return [is_noise().asc(), F.asc("cluster_id")]


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def count_clusters(labels: DataFrame) -> DataFrame:
    """Clusters, noise rows and largest-cluster share of all rows, from the sizes."""
    return summarize_sizes(cluster_sizes(labels))


def summarize_sizes(sizes: DataFrame, *by: str) -> DataFrame:
    real = F.col("cluster_id") != S.NOISE
    return sizes.groupBy(*by).agg(
        F.count_if(real).alias("n_clusters"),
        F.coalesce(F.sum(F.when(~real, F.col("size"))), F.lit(0)).cast("bigint").alias("n_noise"),
        (F.coalesce(F.max(F.when(real, F.col("size"))), F.lit(0)) / F.sum("size")).alias("max_cluster_share"),
        F.sum("size").cast("bigint").alias("n_rows"),
    )


def cluster_ids(labels: DataFrame) -> DataFrame:
    """The distinct ids without noise."""
    return labels.select("cluster_id").distinct().where(~is_noise())


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("embedding", V.l2_normalize(F.col("embedding")))


def centroids(points: DataFrame) -> DataFrame:
    """Unit-length mean of each cluster's unit vectors; a zero mean stays zero.

    The mean is combined per map task, so a cluster's size does not matter.
    """
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))))
    means = points.where(~is_noise()).groupBy("cluster_id").agg(mean.alias("mean"), F.count(F.lit(1)).alias("size"))
    length = V.norm(F.col("mean"))
    return means.select(
        "cluster_id",
        "size",
        F.transform(F.array(length), lambda n: F.transform(F.col("mean"), lambda x: F.when(n > 0, x / n).otherwise(0.0)))[
            0
        ].alias("centroid"),
        (length > 0).alias("directed"),
    )


def with_centroid(points: DataFrame, budget: int = CENTROID_BUDGET_BYTES, salts: int = SALTS) -> DataFrame:
    """`points` with the `centroid` of their cluster, and whether it points anywhere.

    Centroids of at most `budget` bytes are broadcast, so no vector moves. More than
    that are joined on cluster and salt, so that a cluster with a third of all rows
    spreads over `salts` tasks.
    """
    centers = cut(centroids(points)).select("cluster_id", "centroid", "directed")
    shape = centers.agg(F.count(F.lit(1)).alias("k"), F.max(F.size("centroid")).alias("d")).first()
    real = points.where(~is_noise())
    if shape["k"] * (shape["d"] or 0) * 8 <= budget:
        return real.join(F.broadcast(centers), "cluster_id")
    salted = real.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)))
    copies = centers.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(copies, ["cluster_id", "_salt"]).drop("_salt")


def representatives(points: DataFrame, top: int = S.TOP_REPRESENTATIVES, **join) -> DataFrame:
    """The `top` rows of each cluster nearest its centroid: `cluster_id, rank, row_id, similarity`.

    `points` is `row_id, cluster_id, embedding` with unit vectors. Similarities are
    compared at nine decimals and ties go to the lower row id, so the result does not
    depend on summation order. A centroid of length zero keeps row order. Spark keeps
    only `top` rows per cluster in each map task before it shuffles the ranking.
    """
    similarity = F.when(F.col("directed"), F.round(V.dot(F.col("embedding"), F.col("centroid")), 9))
    scored = with_centroid(points, **join).select("cluster_id", "row_id", similarity.alias("similarity"))
    best = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("similarity"), "row_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def summarize_clusters(
    records: DataFrame, vectors: DataFrame, labels: DataFrame, top: int = S.TOP_REPRESENTATIVES
) -> DataFrame:
    """`cluster_id, size, reps` with reps an ordered array of `(rank, row_id, similarity, text)`.

    Noise is counted but has no representatives.
    """
    points = labels.join(unit_vectors(vectors.select("row_id", "embedding")), "row_id")
    best = representatives(points, top).join(
        records.select("row_id", F.col("_normalized_text").alias("text")), "row_id"
    )
    reps = best.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "row_id", "similarity", "text"))).alias("reps")
    )
    empty = F.array().cast("array<struct<rank:int,row_id:bigint,similarity:double,text:string>>")
    return (
        cluster_sizes(labels)
        .join(reps, "cluster_id", "left")
        .select("cluster_id", "size", F.coalesce("reps", empty).alias("reps"))
    )


def require_aligned(records: DataFrame, vectors: DataFrame, labels: DataFrame) -> None:
    """ValueError unless the three tables hold the same row ids."""
    for left, right in ((records, vectors), (vectors, records), (records, labels), (labels, records)):
        if not left.join(right, "row_id", "left_anti").isEmpty():
            raise ValueError("records, vectors and labels do not hold the same rows")


def renumber(labels: DataFrame, *by: str) -> DataFrame:
    """Dense ids from 0, largest cluster first, ties by the lowest row id; noise stays -1.

    `cluster_id` may be of any type that joins; null or -1 means noise. Clusters are numbered by ranges, so that
    neither all of them nor all of one labelling of a sweep (`by`) pass through one task.
    """
    members = labels.where(F.col("cluster_id").isNotNull() & (F.col("cluster_id").cast("string") != str(S.NOISE)))
    sizes = members.groupBy(*by, "cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.min("row_id").alias("first_row")
    )
    ranked = numbered(sizes, F.desc("size"), "first_row", by=by)
    fresh = ranked.select(*by, F.col("cluster_id"), F.col("number").cast("int").alias("_new"))
    return (
        labels.join(fresh, [*by, "cluster_id"], "left")
        .withColumn("cluster_id", F.coalesce("_new", F.lit(S.NOISE)))
        .drop("_new")
    )
