"""Exact top-k inner products over a bit-sliced index.

A block of vectors is kept by attribute and bit: a slice is the bitmap of the rows whose quantised
attribute has that bit. The scores of all rows of a block against a query come from adding
slices, shifted by the bits of the query's attributes, with bitmap arithmetic, and are bit-sliced
themselves. The top rows are then chosen from the most significant score slice downward.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.runtime import cut

SCALE = 64
TOP = 20
BLOCK_COMPONENTS = 1 << 20
QUERY_ROWS = 512
LARGEST = 1 << 61  # of a quantised component
MOST_PARTITIONS = 10_000

INDEX = "dims int, block long, ids binary, low long, bits int, slices binary"


def quantised(vector: Column) -> Column:
    """floor(64 * x) of each component as double; an error where it has more than 61 bits."""

    def whole(x):
        scaled = F.floor(F.lit(SCALE) * x.cast("double"))
        fits = F.abs(F.lit(SCALE) * x.cast("double")) <= float(LARGEST)
        return F.when(fits, scaled.cast("long")).otherwise(F.raise_error(F.lit(f"a component exceeds {LARGEST // SCALE}")).cast("long"))

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, good)


def sliced(ids: np.ndarray, values: np.ndarray) -> tuple[bytes, int, int, bytes]:
    """(ids, lowest value, bits, slices by attribute and bit) of one block; rows by ascending id."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    low = int(values.min()) if values.size else 0
    high = int(values.max()) if values.size else 0
    bits = (high - low).bit_length()
    above = (values - low).T
    planes = ((above[:, None, :] >> np.arange(bits)[:, None]) & 1).astype(np.uint8)
    padded = np.zeros((*planes.shape[:2], -(-len(ids) // 64) * 64), np.uint8)
    padded[:, :, : len(ids)] = planes
    return ids.astype("<i8").tobytes(), low, bits, np.packbits(padded, axis=2, bitorder="little").tobytes()


def add_slices(stacks: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of bitmaps, `stacks[w]` weighing 2**w each, as one bitmap for each weight.

    Full adders turn three bitmaps of a weight into one of that weight and a carry of the next, all
    triples of a weight at once.
    """
    out = []
    carried: list[np.ndarray] = []
    weight = 0
    while weight < len(stacks) or carried:
        rows = np.concatenate([*(stacks[weight : weight + 1]), *carried])
        carried = []
        while len(rows) > 1:
            if len(rows) == 2:
                carried.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
                break
            n = len(rows) // 3
            a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
            half = a ^ b
            carried.append((a & b) | (c & half))
            rows = np.concatenate([half ^ c, rows[3 * n :]])
        out.append(rows)
        weight += 1
    return out


def best_rows(planes: list[np.ndarray], open_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the `k` largest sums among the rows of `open_`; equal sums by lowest row.

    Rows that are certainly in, and rows still tied, are bitmaps; each slice decides for one of them.
    """
    sure, tied = np.zeros_like(open_), open_
    for plane in reversed(planes):
        ones = tied & plane[0]
        n = int(np.bitwise_count(sure | ones).sum())
        if n > k:
            tied = ones
        else:
            sure, tied = sure | ones, tied & ~plane[0]
            if n == k:
                tied = np.zeros_like(tied)
                break
    chosen = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    if len(chosen) < k:
        rest = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))
        chosen = np.concatenate([chosen, rest[: k - len(chosen)]])
    word, bit = chosen >> 6, (chosen & 63).astype(np.uint64)
    scores = np.zeros(len(chosen), np.int64 if len(planes) < 63 else object)  # Python integers where 63 bits may not do
    for weight, plane in enumerate(planes):
        ones = ((plane[0][word] >> bit) & np.uint64(1)).astype(np.int64).astype(scores.dtype)
        scores = scores + (ones << weight)
    return chosen, scores


def search_block(ids: np.ndarray, low: int, bits: int, slices: np.ndarray, query_id: int, query: np.ndarray, k: int):
    """The block's best `k` rows for one query, its own id left out: (ids, scores).

    Attributes are stored above the block's lowest value. For a negative query component the complement of the
    slices is added, so that only unsigned numbers are summed; both shifts are constants of the query.
    """
    count = len(ids)
    words = -(-count // 64)
    valid = np.full(words, np.uint64(2**64 - 1))
    if count % 64:
        valid[-1] = np.uint64((1 << (count % 64)) - 1)
    for row in range(np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, side="right")):
        valid[row >> 6] &= ~np.uint64(1 << (row & 63))
    size = np.abs(query)
    width = int(size.max()).bit_length() if len(query) else 0
    picks: list[list[np.ndarray]] = [[] for _ in range(max(0, width + bits - 1))]
    for shift in range(width):
        has = np.flatnonzero((size >> shift) & 1)
        if len(has):
            flip = np.where(query[has] < 0, np.uint64(2**64 - 1), np.uint64(0))[:, None]
            for bit in range(bits):
                picks[shift + bit].append(slices[has, bit] ^ flip)
    stacks = [np.concatenate(p) if p else np.zeros((0, words), np.uint64) for p in picks]
    planes = [p if len(p) else np.zeros((1, words), np.uint64) for p in add_slices(stacks)]
    rows, scores = best_rows(planes, valid, k)
    shift = low * sum(query.tolist()) - ((1 << bits) - 1) * sum(size[query < 0].tolist())
    whole = [s + shift for s in scores.tolist()]
    if any(abs(s) >> 63 for s in whole):
        raise ValueError("a score of two vectors exceeds 64 bits")
    return ids[rows], np.array(whole, np.int64)


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The table of blocks (`INDEX`), of rows with a usable vector and a key, written to the shared folder.

    A block holds about a million components of vectors of equal dimension. The number of blocks follows from
    the table; rows are dealt to blocks by hash, so copies of a vector or of a key spread.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.select("id", quantised(F.col("v")).alias("v"), F.size("v").alias("dims"), F.monotonically_increasing_id().alias("n"))
    total = rows.agg(F.sum(F.greatest("dims", F.lit(1)).cast("long")).alias("n")).first()["n"] or 0
    blocks = -(-total // BLOCK_COMPONENTS) or 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "n"), F.lit(blocks))).drop("n")

    def run(batches):
        held_key, held = None, []

        def emit():
            ids, low, bits, slices = sliced(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            row = [[held_key[0]], [held_key[1]], [ids], [low], [bits], [slices]]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["dims", "block", "ids", "low", "bits", "slices"]
            )

        for batch in batches:
            ids, dims, block = (batch.column(c).to_numpy() for c in ("id", "dims", "block"))
            flat = batch.column("v").flatten().to_numpy()
            at = np.append(0, np.cumsum(dims))
            cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if a == b:
                    continue
                if held and held_key != (int(dims[a]), int(block[a])):
                    yield emit()
                    held = []
                held_key = (int(dims[a]), int(block[a]))
                held.append((ids[a:b].copy(), flat[at[a] : at[b]].reshape(b - a, held_key[0]).copy()))
        if held:
            yield emit()

    return cut(dealt.repartition("block").sortWithinPartitions("dims", "block").mapInArrow(run, INDEX))


def search(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = TOP) -> DataFrame:
    """`query_id, rank, vec_id, score`: each query's `k` largest integer inner products, ties by smaller id.

    Candidates are all indexed rows of the query's dimension but those with the query's own id; repeated rows
    are candidates each. Queries without id or usable vector get no rows, equal ones are asked once.
    Blocks of queries meet blocks of rows; of each meeting only `k` rows a query go on to the merge.
    """
    asked = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("v"))
    asked = asked.where(F.col("query_id").isNotNull() & usable(F.col("v")))
    asked = cut(asked.select("query_id", quantised(F.col("v")).alias("v"), F.size("v").alias("dims")).distinct())
    groups = -(-asked.count() // QUERY_ROWS) or 1
    grouped = cut(
        asked.withColumn("group", F.pmod(F.xxhash64("query_id", "v"), F.lit(groups)).cast("int"))
        .groupBy("dims", "group").agg(F.collect_list(F.struct("query_id", "v")).alias("queries"))
    )
    meetings = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")).join(grouped, ["dims", "group"])
    parts = min(MOST_PARTITIONS, index.count() * groups) or 1

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                meeting = {c: batch.column(c)[row] for c in ("dims", "ids", "low", "bits", "slices", "queries")}
                dims, low, bits = (meeting[c].as_py() for c in ("dims", "low", "bits"))
                ids = np.frombuffer(meeting["ids"].as_buffer(), "<i8")
                slices = np.frombuffer(meeting["slices"].as_buffer(), "<u8").reshape(dims, bits, -(-len(ids) // 64))
                out = []
                for asked in meeting["queries"].as_py():
                    found, scores = search_block(ids, low, bits, slices, asked["query_id"], np.array(asked["v"], np.int64), k)
                    out.append((np.full(len(found), asked["query_id"]), found, scores))
                columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    found = meetings.repartition(parts, "group", "block").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
