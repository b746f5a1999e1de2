"""Exact nearest-neighbour self-join and the similarity graph built on it."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom import settings as S
from themeloom.operators import blocks as B
from themeloom.operators.ranking import hash_sample
from themeloom.runtime import cut

FEW_CELLS = 24
FIRST_PROBES = 3
RECALL, RECALL_SAMPLE = 0.9, 256
ROWS, COLUMNS, TRIAL_COLUMNS = 512, 8192, 2048  # of a matrix of similarities in a task; the first one finds where to begin
CROWD = 64  # members above a query's bound for each query, beyond which they are chosen by rank


def _chosen(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the best `k` of each row, ties to the earlier column."""
    if sim.shape[1] > k:
        kth = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
        above = sim > kth
        tied = sim == kth
        return np.nonzero(above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(1, keepdims=True))))
    return np.nonzero(np.ones_like(sim, dtype=bool))


def _top(qid: np.ndarray, x: np.ndarray, floor: np.ndarray, mid: np.ndarray, y: np.ndarray, k: int):
    """(row, similarity, id) of the best `k` members for each query, none below its `floor`; members come by id.

    Similarities count to ten decimals. Once a row has `k`, only higher ones can follow, since ties go to lower ids.
    """
    row, best, ids = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    least = floor - 0.6e-10
    at = 0
    while at < len(mid):
        stop = at + (TRIAL_COLUMNS if not at else COLUMNS)
        sim = x @ y[at:stop].T
        r, c = np.nonzero(sim >= least[:, None]) if at or np.isfinite(floor).all() else (None, None)
        if r is None or len(r) > CROWD * len(qid):
            sim = np.round(sim, 10)
            sim[qid[:, None] == mid[None, at:stop]] = -np.inf
            r, c = _chosen(sim, k)
        value, there = np.round(sim[r, c], 10), mid[at + c]
        good = np.isfinite(value) & (value >= floor[r]) & (there != qid[r])
        row, best, ids = (np.concatenate(p) for p in ((row, r[good]), (best, value[good]), (ids, there[good])))
        order = np.lexsort((ids, -best, row))
        row, best, ids = row[order], best[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        row, best, ids, place = row[keep], best[keep], ids[keep], place[keep]
        full = place == k - 1
        least[row[full]] = np.maximum(best[full] + 0.4e-10, least[row[full]])
        at = stop
    return row, best, ids


def _nearest(k: int, members):
    """Best `k` members per query row of two tiles, either way, ties to the lower id; `members` names the cells a cell meets."""

    def one_way(query: tuple, member: tuple) -> list[tuple]:
        (qc, qid, x, floor), (mc, mid, y) = query, member[:3]
        found = []
        by_id = np.argsort(mid, kind="stable")
        mc, mid, y = mc[by_id], mid[by_id], y[by_id]
        present = np.unique(mc)
        starts = np.flatnonzero(np.append(True, qc[1:] != qc[:-1])) if len(qc) else []
        for first, stop in zip(starts, np.append(starts[1:], len(qc))):
            here = np.intersect1d(members(int(qc[first])), present)
            if not len(here):
                continue
            at = np.flatnonzero(np.isin(mc, here)) if len(here) < len(present) else None
            some, vectors = (mid, y) if at is None else (mid[at], y[at])
            for low in range(first, stop, ROWS):
                rows = slice(low, min(low + ROWS, stop))
                row, sim, ids = _top(qid[rows], x[rows], floor[rows], some, vectors, k)
                found.append((qid[rows][row], ids, sim))
        return found

    def run(table: pa.Table) -> pa.Table:
        found = [part for query, member in B.both_ways(table, "floor") for part in one_way(query, member)]
        src, dst, sim = (np.concatenate(p) for p in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "similarity": pa.array(sim, pa.float64())})

    return run


def _best(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_join(
    vectors: DataFrame, k: int, block_rows: int = B.BLOCK_ROWS, exact: bool = True, nprobe: int | None = None, recall: float = RECALL
) -> DataFrame:
    """The `k` most similar other rows of each row: `src, dst, similarity, rank`.

    `vectors` is `row_id, embedding` with unit vectors, similarity is the cosine.

    With few cells every pair of blocks is compared. Otherwise a first round compares
    each cell with itself and its nearest cells, which bounds how far any row's k-th
    neighbour can be; a second round compares only the cells that could still hold a
    closer one, and only what is as near as that bound is emitted. The result is exact either way, and each task emits
    at most `k` rows per query row, never all pairs.

    `exact=False` compares each cell with its `nprobe` nearest cells alone, for tables so large that an approximate
    graph must do. Left out, `nprobe` is the least that finds a share of `recall` of the neighbours of a sample
    (`probes_needed`); with as many probes as cells the result is exact.
    """
    blocks = B.make_blocks(vectors, block_rows)
    n_cells = len(blocks.centers)

    def compare(rule, known: DataFrame | None = None) -> DataFrame:
        """Best members by cells that `rule` names; `known` (src, floor) has what rows are sure to reach already."""
        points = blocks.points
        if known is not None:
            points = points.join(known, F.col("row_id") == F.col("src"), "left").drop("src")
            points = cut(points.withColumn("floor", F.coalesce("floor", F.lit(-math.inf))))
        else:
            points = points.withColumn("floor", F.lit(-math.inf))
        grouped = B.pair_up(replace(blocks, points=points), blocks.pairs(rule)).groupBy("qt", "mt")
        return grouped.applyInArrow(_nearest(k, blocks.met(rule)), "src long, dst long, similarity double")

    def nearest_cells(count: int):
        def rule(c, gap):
            order = np.where(np.arange(len(gap)) == c, -1.0, gap)
            return np.argsort(order, kind="stable")[:count]

        return rule

    if not exact:
        found = probes_needed(blocks, k, recall)[0] if nprobe is None else nprobe
        return _best(compare(nearest_cells(min(found, n_cells))), k)
    if n_cells <= FEW_CELLS:
        return _best(compare(nearest_cells(n_cells)), k)
    first = cut(_best(compare(nearest_cells(FIRST_PROBES)), k))
    # Unit vectors: squared distance = 2 - 2 * similarity. A row short of k has no bound yet.
    known = first.where(F.col("rank") == k).select("src", F.col("similarity").alias("floor"))
    worst = (
        blocks.points.select("row_id", "cell").join(known, F.col("row_id") == F.col("src"), "left").groupBy("cell")
        .agg(F.max(F.when(F.col("floor").isNotNull(), F.sqrt(F.greatest(2 - 2 * F.col("floor"), F.lit(0.0)))).otherwise(math.inf)).alias("bound"))
    )
    bound = np.zeros(n_cells)
    for row in worst.collect():  # one row per cell
        bound[row["cell"]] = row["bound"]
    done = nearest_cells(FIRST_PROBES)
    rest = compare(lambda c, gap: np.setdiff1d(np.flatnonzero(gap <= bound[c] + 1e-6), done(c, gap)), known)
    return _best(first.drop("rank").unionByName(rest), k)


def probes_needed(blocks: B.Blocks, k: int, recall: float = RECALL, sample: int = RECALL_SAMPLE) -> tuple[int, float]:
    """(probes, measured recall): the fewest nearest cells that hold a share of `recall` of the sampled rows' true `k` neighbours.

    The sample, by hash, is compared with all rows; a neighbour counts from the probe on that visits its cell.
    """
    asked = hash_sample(blocks.points.select("row_id", "cell", "embedding"), sample, seed=11).collect()  # at most `sample`
    ids, cells = np.array([r["row_id"] for r in asked]), np.array([r["cell"] for r in asked])
    x = np.array([r["embedding"] for r in asked], np.float64)
    shared = blocks.points.sparkSession.sparkContext.broadcast((ids, x))

    def score(batches):
        ids, x = shared.value
        for batch in batches:
            sim = np.round(x @ B.matrix(batch.column("embedding")).T, 10)
            rows, cell = batch.column("row_id").to_numpy(), batch.column("cell").to_numpy()
            sim[ids[:, None] == rows[None, :]] = -np.inf
            top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(ids)), top.shape[1])
            found = sim[at, top.ravel()]
            good = np.isfinite(found)
            columns = [ids[at][good], rows[top.ravel()][good], found[good], cell[top.ravel()][good].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["src", "dst", "similarity", "cell"])

    near = blocks.points.select("row_id", "cell", "embedding").mapInArrow(score, "src long, dst long, similarity double, cell int")
    true = _best(near, k).select("src", "cell").collect()  # k rows for each of the sample
    own = dict(zip(ids.tolist(), cells.tolist(), strict=True))
    squares = (blocks.centers**2).sum(1)
    places: dict[int, np.ndarray] = {}
    visits = []
    for row in true:
        c = own[row["src"]]
        if c not in places:
            apart = np.sqrt(np.maximum(squares[c] + squares - 2 * blocks.centers @ blocks.centers[c], 0))
            gap = np.maximum(apart - blocks.radius[c] - blocks.radius - 1e-9, 0)
            gap[c] = -1.0
            places[c] = np.argsort(np.argsort(gap, kind="stable"), kind="stable")
        visits.append(places[c][row["cell"]])
    if not visits:
        return len(blocks.centers), 1.0
    visits = np.sort(visits)
    probes = int(visits[max(0, math.ceil(recall * len(visits)) - 1)]) + 1
    return probes, float((visits < probes).mean())


def neighbour_count(n_rows: int, k: int = S.GRAPH_NEIGHBOURS) -> int:
    """Neighbours per row, the row itself counted, for a table of `n_rows`."""
    return min(k, max(2, n_rows - 1))


def similarity_edges(neighbours: DataFrame) -> DataFrame:
    """Undirected edges `src < dst` weighted by similarity, at least 0; the stronger direction counts."""
    weight = F.greatest(F.col("similarity"), F.lit(0.0))
    return (
        neighbours.select(
            F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), weight.alias("w")
        )
        .groupBy("src", "dst")
        .agg(F.max("w").alias("w"))
    )


def knn_graph(vectors: DataFrame, n_neighbours: int = S.GRAPH_NEIGHBOURS, block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """Similarity graph in which `n_neighbours` counts the row itself."""
    return similarity_edges(knn_join(vectors, n_neighbours - 1, block_rows))
