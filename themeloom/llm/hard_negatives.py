"""Hard negatives by threshold joins over an inverted index with norm bounds.

Rows lie in blocks. In a block the attributes are ordered by weight and cut into chunks, and each chunk has a
posting list. A row is left out of the lists from the chunk on whose suffix is covered by a norm bound: at most
`COVERED` of the row's norm. An anchor's scores are accumulated list by list; a row is given up as soon as its
partial score and the norms of what is left cannot reach the threshold, and those that remain are scored in full.
The threshold starts high and is lowered until an anchor has its positives, or its windows of negatives are full.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.bitsliced import usable
from themeloom.runtime import cut

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative scores between these hundredths of the positive's score
BLOCK_COMPONENTS = 1 << 19
SLICE = 4096  # anchors that meet a block in one task
CHUNK = 8  # attributes of a posting list
COVERED = 0.35
START, STEP = 0.6, 0.7  # first threshold as a share of the largest possible score, and each next one of the last
EXACT = 2.0**52  # doubles add whole numbers exactly below it
MOST_PARTITIONS = 10_000

FOUND = "anchor long, positive_score long, row_id long, score long"


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x); whole numbers as doubles, infinite only where 256 * x is no double."""
    with np.errstate(over="ignore"):
        return np.floor(vectors * SCALE)


def _whole(x: float) -> int:
    """floor(256 * x) of any finite double."""
    return int(x) * SCALE if abs(x) > 2.0**60 else math.floor(x * SCALE)


class Block:
    """The inverted index of some rows (ids, and vectors of equal length)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        values = quantised(vectors)
        with np.errstate(over="ignore", invalid="ignore"):
            self.by_weight = np.argsort(-(values * values).sum(axis=0), kind="stable")
            values = values[:, self.by_weight]
            chunks = range(0, values.shape[1], CHUNK)
            tails = np.zeros((len(chunks) + 1, len(ids)))  # norm of a row from a chunk on
            for c in reversed(range(len(chunks))):
                part = values[:, c * CHUNK : (c + 1) * CHUNK]
                tails[c] = tails[c + 1] + (part * part).sum(axis=1)
            tails = np.sqrt(tails)
            reach = (tails > COVERED * tails[0]).sum(axis=0)  # lists that hold the row
        order = np.lexsort((ids, -reach))
        self.ids, self.vectors, self.values, self.tails = ids[order], vectors[order], values[order], tails[:, order]
        held = [int((reach > c).sum()) for c in range(len(chunks))]
        self.lists = [np.ascontiguousarray(self.values[:n, at : at + CHUNK]) for n, at in zip(held, chunks, strict=True)]
        self.order = order
        self.largest = float(np.abs(values).max()) if values.size else 0.0
        self.norm = float(self.tails[0].max()) if len(ids) else 0.0

    def scores(self, rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
        """Inner products; in Python integers where doubles could round or 64 bits overflow."""
        if exact:
            return (self.values[rows] @ quantised(query)[self.by_weight]).astype(np.int64)
        asked = [_whole(x) for x in query.tolist()]
        found = [sum(a * _whole(x) for a, x in zip(asked, row, strict=True)) for row in self.vectors[rows].tolist()]
        if any(abs(s) >> 63 for s in found):
            raise ValueError("a score of two vectors exceeds 64 bits")
        return np.array(found, np.int64)

    def at_least(self, query: np.ndarray, least: float, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of `rows` (ascending places) that score `least` or more, and their scores."""
        asked = quantised(query)[self.by_weight]
        with np.errstate(over="ignore", invalid="ignore"):
            exact = len(asked) * self.largest * float(np.abs(asked).max(initial=0.0)) < EXACT
            squares = np.append(asked * asked, 0.0)
            partial = np.zeros(len(rows))
            for c, listed in enumerate(self.lists):
                m = int(np.searchsorted(rows, len(listed)))
                if not m:
                    break  # all that are left have their suffix bound
                here = rows[:m]
                partial[:m] += listed[here] @ asked[c * CHUNK : (c + 1) * CHUNK]
                left = self.tails[c + 1][here] * math.sqrt(squares[(c + 1) * CHUNK :].sum())
                slack = 1.0 + 1e-9 * (np.abs(partial[:m]) + left)
                gone = partial[:m] + left + slack < least
                if gone.any():
                    keep = np.append(~gone, np.ones(len(rows) - m, bool))
                    rows, partial = rows[keep], partial[keep]
        scores = self.scores(rows, query, exact)
        good = scores >= least
        return rows[good], scores[good]

    def ranked(self, rows: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the first `k`: higher scores first, then smaller ids."""
        return [(int(self.ids[rows[i]]), int(scores[i])) for i in np.lexsort((self.ids[rows], -scores))[:k]]

    def best(self, query: np.ndarray, rows: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The first `k` of `rows` that score `floor` or more (None: any score)."""
        most = math.sqrt(float((quantised(query) ** 2).sum())) * self.norm
        least = -math.inf if floor is None else floor
        start = START * most
        at = max(least, start) if floor is None and math.isfinite(start) else least
        while True:
            found, scores = self.at_least(query, at, rows)
            if len(found) >= k or at <= least:
                return self.ranked(found, scores, k)
            at = max(least, at * STEP if at > START * STEP**6 * most else -math.inf)

    def windows(self, query: np.ndarray, rows: np.ndarray, wanted: list[tuple[int, int | None]], k: int) -> list[tuple[int, int, int]]:
        """(positive score, id, score): for each (positive score, floor) the first `k` of `rows` in its window.

        A floor is a score that `k` rows of the window are known to reach.
        """
        open_ = {}
        for positive, floor in wanted:
            low, high = -(-LOW * positive // 100), HIGH * positive // 100
            if low <= high:
                open_[positive] = (low if floor is None else max(low, floor), high)
        if not open_:
            return []
        at = min(max(low, high - (high - low) // 8) for low, high in open_.values())
        step = max(1, max(high - low for low, high in open_.values()) // 8)
        while True:
            found, scores = self.at_least(query, at, rows)
            short = [low for low, high in open_.values() if at > low and ((scores >= low) & (scores <= high)).sum() < k]
            if not short:
                break
            at, step = max(min(short), at - step), 2 * step
        out = []
        for positive, (low, high) in open_.items():
            inside = (scores >= low) & (scores <= high)
            out += [(positive, i, s) for i, s in self.ranked(found[inside], scores[inside], k)]
        return out


def _blocks(df: DataFrame) -> tuple[DataFrame, int]:
    """The table of blocks and their number; rows are dealt by hash, so copies and labels spread."""
    total = df.agg(F.sum(F.greatest("dims", F.lit(1)).cast("long")).alias("n")).first()["n"] or 0
    blocks = -(-total // BLOCK_COMPONENTS) or 1
    dealt = df.withColumn("block", F.pmod(F.xxhash64("id", "n"), F.lit(blocks)))

    def pack(table: pa.Table) -> pa.Table:
        vectors = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        columns = {
            "dims": pa.array([table.column("dims")[0].as_py()], pa.int32()), "block": pa.array([table.column("block")[0].as_py()], pa.int64()),
            "ids": [ids.astype("<i8").tobytes()], "labels": [table.column("label").to_pylist()], "vectors": [vectors.astype("<f8").tobytes()],
        }
        return pa.table(columns)

    schema = "dims int, block long, ids binary, labels array<string>, vectors binary"
    return cut(dealt.groupBy("dims", "block").applyInArrow(pack, schema)), blocks


def _unpack(table: pa.Table):
    ids = np.frombuffer(table.column("ids")[0].as_buffer(), "<i8")
    dims = table.column("dims")[0].as_py()
    vectors = np.frombuffer(table.column("vectors")[0].as_buffer(), "<f8").reshape(len(ids), dims)
    return ids, np.array(table.column("labels")[0].as_py(), object), vectors


def _positives_of(table: pa.Table, asked: list[dict]):
    ids, labels, vectors = _unpack(table)
    groups: dict[str, Block] = {}
    for row in asked:
        label = row["label"]
        if label not in groups:
            mine = np.flatnonzero(labels == label)
            groups[label] = Block(ids[mine], vectors[mine])
        block = groups[label]
        others = np.flatnonzero(block.ids != row["id"])
        if len(others):
            for i, s in block.best(np.array(row["v"]), others, POSITIVES, row["floor"]):
                yield row["anchor"], None, i, s


def _negatives_of(table: pa.Table, asked: list[dict]):
    ids, labels, vectors = _unpack(table)
    block = Block(ids, vectors)
    labels = labels[block.order]
    different: dict[str, np.ndarray] = {}
    for row in asked:
        label = row["label"]
        if label not in different:
            different[label] = np.flatnonzero(labels != label)
        wanted = [(w["positive_score"], w["floor"]) for w in row["wanted"]]
        for p, i, s in block.windows(np.array(row["v"]), different[label], wanted, NEGATIVES):
            yield row["anchor"], p, i, s


def _meet(index: DataFrame, anchors: DataFrame, slices: int, parts: int, work) -> DataFrame:
    """`work` on every block and the anchors of a slice that are sent to it, one task each."""
    keys = ["dims", "block", "slice"]
    left = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(parts, *keys)

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        rows = list(work(block, asked.to_pylist())) if block.num_rows and asked.num_rows else []
        return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("anchor", "positive_score", "row_id", "score"))})

    return left.groupBy(*keys).cogroup(anchors.repartition(parts, *keys).groupBy(*keys)).applyInArrow(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score` for the rows where `anchor` holds.

    A row's score is its integer inner product with the anchor, of components floor(256 * x). Positives are the
    anchor's first five rows of its label, negatives of each the first three rows of other labels whose score lies
    between 50 and 95 hundredths of the positive's; higher scores come first, ties by smaller id, fewer rows where there
    are not enough. Rows without key, label or vector, and those with a null or non-finite component, take no part; rows
    meet only rows of their dimension. Rows with the anchor's own id are no positives of it, repeated rows are
    candidates each, and equal anchors are asked once. A positive with a negative score has an empty window. Scores are
    exact at any size of components; one beyond 64 bits is an error. An empty table gives no rows; other columns,
    whatever their names, are not read.

    Each anchor first meets about the square root of the number of blocks. What it finds there bounds what the
    remaining blocks must look for. A block hands over at most five rows an anchor, or three a window.
    """
    rows = df.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"),
        F.coalesce(anchor, F.lit(False)).alias("asks"),
    )
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    rows = cut(rows.withColumn("dims", F.size("v")).withColumn("n", F.monotonically_increasing_id()))
    index, blocks = _blocks(rows.drop("asks"))
    anchors = cut(rows.where("asks").select("id", "label", "v", "dims").distinct().withColumn("anchor", F.monotonically_increasing_id()))
    slices = -(-anchors.count() // SLICE) or 1
    parts = min(MOST_PARTITIONS, index.count() * slices) or 1
    stride = math.ceil(math.sqrt(blocks))

    def search(asked: DataFrame, bounds, work, k: int) -> DataFrame:
        """Seed blocks, then all others under the bounds that the seeds give."""
        dealt = asked.withColumn("slice", F.pmod(F.xxhash64("anchor"), F.lit(slices)).cast("int"))
        dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        seeded = F.pmod("block", F.lit(stride)) == F.pmod(F.xxhash64("anchor", F.lit(1)), F.lit(stride))
        first = cut(_first(_meet(index, dealt.where(seeded), slices, parts, work), k).drop("rank"))
        rest = bounds(dealt.where(~seeded), first.groupBy("anchor", "positive_score").agg(F.count("*").alias("have"), F.min("score").alias("kth")))
        return cut(_first(first.unionByName(_meet(index, rest, slices, parts, work)), k))

    full = lambda k: F.when(F.col("have") >= k, F.col("kth"))

    def floors(asked, known):
        known = known.select("anchor", full(POSITIVES).alias("known"))
        return asked.join(known, "anchor", "left").withColumn("floor", F.col("known")).drop("known")

    positives = search(anchors.withColumn("floor", F.lit(None).cast("long")), floors, _positives_of, POSITIVES)
    positives = positives.select("anchor", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))

    def wanting(windows: DataFrame) -> DataFrame:
        """At most five windows an anchor."""
        return windows.groupBy("anchor").agg(F.collect_list(F.struct("positive_score", "floor")).alias("wanted"))

    distinct = positives.select("anchor", "positive_score").distinct().withColumn("floor", F.lit(None).cast("long"))

    def window_floors(asked, known):
        known = distinct.drop("floor").join(known, ["anchor", "positive_score"], "left")
        return asked.drop("wanted").join(wanting(known.select("anchor", "positive_score", full(NEGATIVES).alias("floor"))), "anchor")

    negatives = search(anchors.join(wanting(distinct), "anchor"), window_floors, _negatives_of, NEGATIVES)
    negatives = negatives.select("anchor", "positive_score", "rank", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = positives.join(negatives, ["anchor", "positive_score"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
