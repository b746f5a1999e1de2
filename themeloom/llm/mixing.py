"""Mixing sources to target weights by capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.runtime import cut

WEIGHTS = (3, 1, 2)  # by rank of the source, repeating
SHARE = 1.5  # words of the mix, as a multiple of all words
EPOCHS = 2  # times that a source may be repeated
SEED = 29
BUCKET_DIGITS = 3  # hexadecimal digits of the hash that make a bucket
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """Add `_rank` from 0, by code point with null last, without a window over all sources."""
    order = [F.col("_source").isNull(), F.col("_source")]
    dealt = cut(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = parts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        dealt.withColumn("_i", F.row_number().over(within))
        .join(offsets, F.col("_part") == F.col("_p"))
        .withColumn("_rank", F.col("_first") + F.col("_i") - 1)
        .drop("_part", "_i", "_p", "_first")
    )


def water_fill(sources: DataFrame, budget: float, epochs: float = EPOCHS) -> DataFrame:
    """Add `_target` to sources with `_size` and `_weight`: the budget shared by weight, no source above its cap.

    A source whose share exceeds `epochs` times its size is clamped there, and what it leaves is shared among
    the others by weight, until none is above. Clamping only ever raises the level, so the clamped sources are
    those whose cap lies below weight x level: a round is one aggregate, and the level is all that is remembered.
    If the budget exceeds all caps together, every source ends at its cap.
    """
    cap = F.col("_size") * F.lit(float(epochs))
    level = 0.0
    while True:
        clamped = cap < F.col("_weight") * F.lit(level)
        row = sources.agg(
            F.sum(F.when(clamped, F.col("_size")).otherwise(0)).alias("full"),
            F.sum(F.when(~clamped, F.col("_weight")).otherwise(0)).alias("open"),
        ).first()
        if not row["open"]:
            return sources.withColumn("_target", cap)
        raised = (budget - row["full"] * float(epochs)) / row["open"]
        if raised <= level:
            return sources.withColumn("_target", F.least(cap, F.col("_weight") * F.lit(level)))
        level = raised


def assign(
    sized: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """`sized` with `source_size`, `target` (its source's) and `taken`, the words that the mix takes from the row.

    A source's target is met by whole repetitions of all its rows, then by a fraction: its rows in the order of a
    seeded hash until the rest is used up, where the last row gives only the words that are missing. The
    rounded target is met exactly, no row gives more than `epochs` times its size, and reruns agree. Hash
    buckets carry the running sums, so that a source of any size is never sorted as one group; only the bucket
    in which the rest runs out is. Null sources are one source; empty rows give nothing; an empty table
    stays empty. Rows of equal key and size are interchangeable. Columns named `_mix...` are reserved.
    """
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(size).cast("string")))
    rows = sized.withColumns({"_mix": mark, "_mix_bucket": F.substring(mark, 1, BUCKET_DIGITS)})
    buckets = cut(
        rows.groupBy(F.col(source).alias("_source"), F.col("_mix_bucket").alias("_bucket")).agg(F.sum(size).alias("_words"))
    )
    totals = buckets.groupBy("_source").agg(F.sum("_words").alias("_size"))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = cut(_numbered(totals).withColumn("_weight", weight).drop("_rank"))
    total = sources.agg(F.sum("_size").alias("n")).first()["n"] or 0
    goal = F.round("_target").cast("long")
    goals = water_fill(sources, share * total, epochs).select(
        "_source", "_size", "_target", goal.alias("_goal"),
        F.when(F.col("_size") > 0, F.floor(goal / F.col("_size"))).otherwise(0).cast("long").alias("_whole"),
    )
    goals = cut(goals.withColumn("_rest", F.col("_goal") - F.col("_whole") * F.col("_size")))
    running = Window.partitionBy("_source").orderBy("_bucket")  # at most 16**BUCKET_DIGITS rows for a source
    crossing = (
        buckets.withColumn("_upto", F.sum("_words").over(running))
        .join(goals.select(F.col("_source").alias("_s"), "_rest"), F.col("_source").eqNullSafe(F.col("_s")))
        .where((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_words") <= F.col("_rest")))
        .select(F.col("_s").alias("_c"), F.col("_bucket").alias("_mix_cross"), (F.col("_upto") - F.col("_words")).alias("_mix_before"))
    )
    plan = cut(
        goals.join(crossing, F.col("_source").eqNullSafe(F.col("_c")), "left").select(
            F.col("_source").alias("_mix_source"), F.col("_size").alias("source_size"), F.col("_target").alias("target"),
            F.col("_whole").alias("_mix_whole"), F.col("_rest").alias("_mix_rest"), "_mix_cross", "_mix_before",
        )
    )
    columns = [c for c in sized.columns if c not in ("source_size", "target", "taken")]
    joined = rows.drop("source_size", "target", "taken").join(plan, F.col(source).eqNullSafe(F.col("_mix_source")))
    open_ = F.col("_mix_bucket").eqNullSafe(F.col("_mix_cross"))
    settled = joined.where(~open_).withColumn(
        "_mix_extra", F.when(F.col("_mix_bucket") < F.col("_mix_cross"), F.col(size)).otherwise(0).cast("long")
    )
    line = Window.partitionBy(source).orderBy("_mix", key, size).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_mix_rest") - F.col("_mix_before") - F.coalesce(F.sum(size).over(line), F.lit(0))
    crossed = joined.where(open_).withColumn("_mix_extra", F.greatest(F.lit(0), F.least(F.col(size), left)).cast("long"))
    taken = (F.col("_mix_whole") * F.col(size) + F.col("_mix_extra")).cast("long")
    return settled.unionByName(crossed).withColumn("taken", taken).select(*columns, "source_size", "target", "taken")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """`key, source, size, source_size, target, taken`: how many words of each document the mix takes (see `assign`)."""
    sized = cut(df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size")))
    return assign(sized, **options).withColumnsRenamed({"doc_id": key, "source": source})


def repeated(assigned: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """The rows of the mix: every row as often as it is taken whole, then its first words where only a part is taken.

    A part keeps words, joined by single blanks. Rows without words take no part in a mix.
    """
    whole = F.floor(F.col("taken") / F.col(size)).cast("int")
    part = F.col("taken") - whole * F.col(size)
    copies = F.when(F.col(size) > 0, F.concat(F.array_repeat(F.col(size), whole), F.when(part > 0, F.array(part)).otherwise(F.array())))
    out = assigned.select("*", F.explode(copies).alias("_mix_words"))
    cut_text = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), 0), 1, F.col("_mix_words").cast("int")), " ")
    return out.withColumn(text, F.when(F.col("_mix_words") == F.col(size), F.col(text)).otherwise(cut_text)).drop("_mix_words")
