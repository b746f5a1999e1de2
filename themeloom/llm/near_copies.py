"""Near copies of texts: Jaccard similarity of five-word shingles, 0.8 at least.

SimHash fingerprints of the shingle sets come first: those within three bits are found by the hierarchical index in Gray order
(`simhash.links`), and their texts are joined if they are similar enough. At a similarity of 0.8 two fingerprints
differ in about ten of 64 bits, so what is still apart is looked for again by the least hashes of the shingles, in bands; two
texts of similarity s share a band with probability 1 - (1 - s**4)**24, which is 0.999997 at 0.8. Every link is checked on the whole sets.

Equal sets are one node from the start. Texts that share a band form a bucket. In the first rounds each bucket tests its
members against one of them, which joins large groups of near copies with few tests; the members of buckets that are still apart
are then joined exactly, by their rarest shingles, so no candidate is left out and no bucket is paired off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm import simhash
from themeloom.llm.batches import map_texts, texts_of
from themeloom.llm.hashing import mix
from themeloom.operators.components import connected_components
from themeloom.runtime import cut

SHINGLE = 5
SIMILARITY = 0.8
SEED = 43
BANDS, BAND_ROWS = 24, 4
STARS = 2  # rounds in which a bucket tests its members against one
BLOCK = 1 << 12

_draws = mix(np.arange(1, 2 * BANDS * BAND_ROWS + 1, dtype=np.uint64))
FACTORS, TERMS = _draws[: BANDS * BAND_ROWS] | np.uint64(1), _draws[BANDS * BAND_ROWS :]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle, one without a word has none."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    size = min(SHINGLE, len(words))
    first, last = (ends - sizes)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first)))


def bands(marks: np.ndarray) -> np.ndarray:
    """A key for each band: its number and the least hashes of its rows; none without a shingle."""
    if not len(marks):
        return marks
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(marks), BLOCK):
        np.minimum(least, (marks[at : at + BLOCK, None] * FACTORS + TERMS).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = mix(keys * np.uint64(31) + row)
    return keys


def fingerprint(marks: np.ndarray) -> int:
    """SimHash of a set of shingle hashes: bits set in over half of them; 0 without a shingle."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(marks), simhash.HASH_BLOCK):
        bits = np.unpackbits(marks[at : at + simhash.HASH_BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(marks), bitorder="little").view("<i8")[0])


def sketches(df: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    """`keep` columns, `set` (a hash of the shingles; equal for equal sets), `fingerprint` and `bands`. No shuffle."""
    rows = df.select(*keep, F.col(text).alias("_text"))
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)

    def work(batch):
        marks = [shingles(t) for t in texts_of(batch, "_text")]
        sets = np.array([xxhash.xxh64_intdigest(m.tobytes(), SEED) for m in marks], np.uint64).view(np.int64)
        keys = pa.array([bands(m).view(np.int64) for m in marks], pa.list_(pa.int64()))
        prints = pa.array([fingerprint(m) for m in marks], pa.int64())
        columns = [*(batch.column(c) for c in keep), pa.array(sets), prints, keys]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, "set", "fingerprint", "bands"])

    return map_texts(rows, f"{kinds}set long, fingerprint long, bands array<long>", work, "_text")


def _shingle_sets(df: DataFrame) -> DataFrame:
    """`id, marks` from `id, text`."""

    def work(batch):
        marks = pa.array([shingles(t).view(np.int64) for t in texts_of(batch)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("id"), marks], names=["id", "marks"])

    return map_texts(df, "id long, marks array<long>", work)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct values."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose sets are similar enough."""
    left = sets.select(F.col("id").alias("src"), F.col("marks").alias("a"))
    right = sets.select(F.col("id").alias("dst"), F.col("marks").alias("b"))
    both = pairs.join(left, "src").join(right, "dst")
    near = F.least(F.size("a"), F.size("b")) >= similarity * F.greatest(F.size("a"), F.size("b"))
    return both.where(F.when(near, jaccard(F.col("a"), F.col("b")) >= similarity).otherwise(False)).select("src", "dst")


def _prefix_pairs(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """`src, dst` of different components among `apart` (id, component): all pairs of `similarity`, and few others.

    With every set's shingles in the order of how many sets have them, rarest first, two similar sets share one among the first
    size - ceil(similarity * size) + 1 of each. Copies that were changed each in its own way have as many shingles to
    themselves, so nothing is left of them to meet by, however many share a template.
    """
    held = cut(sets.join(apart, "id"))
    each = held.select("id", F.explode("marks").alias("mark"))
    shared = each.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    listed = each.join(shared, "mark").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "mark"))).alias("shared"))
    size = F.size("marks")
    first = size - F.ceil(similarity * size - 1e-9) + 1  # of which those no other set has come before all others
    take = F.greatest(first - (size - F.size("shared")), F.lit(0)).cast("int")
    keyed = held.join(listed, "id").select("id", "component", size.alias("size"), F.size("shared").alias("m"), F.posexplode(F.slice("shared", F.lit(1), take)).alias("at", "key"))
    left = cut(keyed.select("id", "component", "size", (F.col("m") - F.col("at")).alias("rest"), "key.mark"))
    right = left.select(F.col("id").alias("dst"), F.col("component").alias("other"), F.col("size").alias("wide"), F.col("rest").alias("more"), "mark")
    # From the first shingle that two sets share, no more than the shorter rest can be common: enough of both must be left.
    needed = F.ceil(similarity / (1 + similarity) * (F.col("size") + F.col("wide")) - 1e-9)
    possible = (F.col("id") < F.col("dst")) & (F.col("component") != F.col("other")) & (F.least("rest", "more") >= needed)
    return left.join(right, "mark").where(possible).select(F.col("id").alias("src"), "dst")


def fingerprint_pairs(marks: DataFrame) -> DataFrame:
    """`src, dst` of `id, fingerprint`: pairs that connect all fingerprints within three bits, each by its lowest id, and equal ones with it."""
    first = cut(marks.groupBy("fingerprint").agg(F.min("id").alias("src")))
    equal = marks.join(first, "fingerprint").where("id <> src").select("src", F.col("id").alias("dst"))
    ends = [first.select(F.col("fingerprint").alias(end), F.col("src").alias(f"{end}_id")) for end in ("src", "dst")]
    linked = simhash.links(first.select("fingerprint")).join(ends[0], "src").join(ends[1], "dst")
    return equal.unionByName(linked.select(F.least("src_id", "dst_id").alias("src"), F.greatest("src_id", "dst_id").alias("dst"))).distinct()


def _labels(members: DataFrame, sets: DataFrame, near: DataFrame, similarity: float) -> DataFrame:
    """`id, component` of all of `sets`: joined by the pairs `near`, then by buckets (key, id); a component is named by its lowest id."""
    nodes = sets.select("id")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    degree = members.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("degree"))
    members = cut(members.join(degree, "id"))
    tested = near
    links = cut(_alike(near, sets, similarity))

    def joined() -> DataFrame:
        placed = nodes.join(parts := connected_components(links), nodes["id"] == parts["node"], "left")
        return cut(placed.select("id", F.coalesce("component", "id").alias("component")))

    labels = joined()
    for step in range(STARS + 1):
        now = cut(members.join(labels, "id"))
        # first the member that shares most bands with others, which others are copies of; then any
        some = F.struct((-F.col("degree") if step == 0 else F.xxhash64("id", F.lit(step))).alias("draw"), "id", "component")
        buckets = now.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.min(some).alias("hub")
        )
        # a bucket of two is settled by its first test
        apart = cut(buckets.where((F.col("low") < F.col("high")) & ((F.col("n") > 2) | F.lit(step == 0))).select("key", "hub"))
        if apart.isEmpty():
            break
        if step < STARS:
            found = now.join(apart, "key").where(F.col("component") != F.col("hub.component"))
            found = found.select(F.least("id", "hub.id").alias("src"), F.greatest("id", "hub.id").alias("dst"))
        else:
            found = _prefix_pairs(cut(now.join(apart.select("key"), "key").select("id", "component").distinct()), sets, similarity)
        fresh = found.distinct()
        fresh = cut(fresh.join(tested, ["src", "dst"], "left_anti"))
        tested = tested.unionByName(fresh)
        links = links.unionByName(cut(_alike(fresh, sets, similarity)))
        labels = joined()
    return labels


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The row with the smallest key of each component of texts linked by `similarity` or more, with all its columns.

    Texts without a word (null, empty) are copies of each other. Rows without a key come after all others; of repeated rows one stays.
    """
    columns = df.columns
    renamed = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    marked = cut(sketches(renamed, tuple(names.values()), names[text]).withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(F.col(names[key]).isNull(), F.col(names[key]), F.col("row"))
    best = cut(marked.groupBy("set").agg(F.min(order).alias("best"), F.first("bands").alias("bands"), F.first("fingerprint").alias("fingerprint")))
    near = cut(fingerprint_pairs(best.select(F.col("best.row").alias("id"), "fingerprint")))
    keyed = best.select(F.col("best.row").alias("id"), F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = cut(keyed.join(shared.select("key"), "key", "left_semi"))
    some = cut(members.select("id").union(near.select("src")).union(near.select("dst")).distinct())
    texts = marked.join(some, F.col("row") == F.col("id"), "left_semi").select(F.col("row").alias("id"), F.col(names[text]).alias("text"))
    labels = _labels(members, cut(_shingle_sets(texts)), near, similarity)
    placed = best.withColumn("id", F.col("best.row")).join(labels, "id", "left")
    lowest = placed.groupBy(F.coalesce("component", "id").alias("component")).agg(F.min("best").alias("best"))
    chosen = cut(lowest.select(F.col("best.row").alias("chosen")))
    # most rows are chosen, so the list grows with the table: merged at every size, never broadcast
    kept = marked.join(chosen.hint("merge"), F.col("row") == F.col("chosen"), "left_semi")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
