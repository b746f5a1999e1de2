"""Global ranks and running sums that do not pass through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.runtime import cut

ID_BUCKET = 1 << 16


def rank_by_size(clusters: DataFrame, size: str = "size", key: str = "cluster_id") -> DataFrame:
    """Add `rank` (1 = largest, ties by `key`) and `running` (sum of sizes down to the row).

    A window over all clusters would put them into one task, and there may be as many
    clusters as a third of the rows. Here the rows of a window are bounded: clusters
    are counted per (size, key bucket), offsets are summed over those counts, and the
    last step ranks within one bucket of at most `ID_BUCKET` keys. Sizes add up to the
    row count N, so there are at most sqrt(2N) distinct ones, and keys are dense, so
    the count table has about K / ID_BUCKET more rows than that. `key` is an integer.
    """
    bucketed = clusters.withColumn("_bucket", F.floor(F.col(key) / ID_BUCKET).cast("bigint"))
    counts = bucketed.groupBy(F.col(size).alias("_size"), F.col("_bucket").alias("_b")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    before = Window.orderBy(F.desc("_size"), "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_size",
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rank0"),
        F.coalesce(F.sum(F.col("_n") * F.col("_size")).over(before), F.lit(0)).alias("_sum0"),
    )
    within = Window.partitionBy(size, "_bucket").orderBy(key)
    return (
        bucketed.withColumn("_i", F.row_number().over(within))
        .join(offsets, (F.col(size) == F.col("_size")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("rank", (F.col("_rank0") + F.col("_i")).cast("bigint"))
        .withColumn("running", (F.col("_sum0") + F.col("_i") * F.col(size)).cast("bigint"))
        .drop("_bucket", "_i", "_size", "_b", "_rank0", "_sum0")
    )


def numbered(df: DataFrame, *order: str | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Add `number`, the place of each row in `order` from 0 on, or its place among the rows of equal `by`.

    Rows are sorted by ranges, counted by partition, and each partition goes on from where those before it end: nothing
    but a count for each partition passes through one task. `order` should leave no ties.
    """
    ranged = cut(
        df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
        .withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    )
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = ranged.join(places, "_part").withColumn("number", F.col("_before") + F.col("_id") - F.col("_first"))
    found = found.drop("_part", "_id", "_first", "_before")
    if not by:
        return found
    firsts = found.groupBy(*by).agg(F.min("number").alias("_start"))
    return found.join(firsts, list(by)).withColumn("number", F.col("number") - F.col("_start")).drop("_start")


def hash_order(key: Column, seed: int) -> Column:
    """A repeatable random order that depends on the key alone, not on partitions."""
    return F.sha2(F.concat_ws("|", key.cast("string"), F.lit(str(seed))), 256)


def hash_sample(df: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """`n` rows without replacement: those lowest in a hash order of the key.

    Hashes are uniform, so the lowest `n` lie below a bound near n / rows. Only rows under that bound, with a
    margin, are merged; should they be too few, all rows are.
    """
    order = hash_order(F.col(key), seed)
    total = df.count()
    share = (n + 10 * n**0.5 + 100) / max(total, 1)
    if share < 1:
        low = df.where(order < f"{int(share * 2**48):012x}")
        if low.limit(n).count() == n:
            df = low
    return df.orderBy(order, key).limit(n)
