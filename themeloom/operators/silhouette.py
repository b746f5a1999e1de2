"""Exact cosine silhouette from cluster sums.

For unit vectors the mean cosine distance from x to a cluster is 1 - x.S/n with S the
sum of its vectors and n its size, so only per-cluster sums are needed (Rousseeuw 1987
for the score itself). All labellings of a sweep are scored together: a row carries its
vector once and an array of cluster ids, one per trial.

Rows are packed into blocks and sums into tiles of bounded size, and a block meets each tile by an equi-join. Few tiles are
broadcast by Spark, many are shuffled with the blocks; the nearest other cluster is a minimum over the tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom import settings as S
from themeloom.operators.blocks import lists, matrix
from themeloom.runtime import cut

BLOCK_ROWS = 1024
TILE_BYTES, TILE_CLUSTERS = 1 << 20, 4096  # of sums; a block and a tile have a few million distances at most


def gather_labels(labels: DataFrame) -> DataFrame:
    """`row_id, marks`: each row's `(trial_ord, cluster_id)` pairs, noise left out.

    The array is bounded by the number of trials in a sweep.
    """
    return (
        labels.where(F.col("cluster_id") != S.NOISE)
        .groupBy("row_id")
        .agg(F.collect_list(F.struct(F.col("trial_ord").cast("int").alias("t"), F.col("cluster_id").cast("int").alias("c"))).alias("marks"))
    )


def _marks(batch):
    """Row numbers, trials and clusters of a batch's marks, flattened."""
    column = batch.column("marks")
    counts = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    return (
        np.repeat(np.arange(len(counts)), counts),
        flat.field("t").to_numpy(zero_copy_only=False),
        flat.field("c").to_numpy(zero_copy_only=False),
    )


def cluster_sums(points: DataFrame) -> DataFrame:
    """Per trial and cluster the size and vector sum, added up within each batch first."""

    def partial(batches):
        for batch in batches:
            x = matrix(batch.column("embedding"))
            row, t, c = _marks(batch)
            if not len(row):
                continue
            keys, where = np.unique(np.stack([t, c], 1), axis=0, return_inverse=True)
            where = where.ravel()
            sums = np.zeros((len(keys), x.shape[1]))
            np.add.at(sums, where, x[row])
            size = np.bincount(where, minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[:, 0], pa.int32()), pa.array(keys[:, 1], pa.int32()), pa.array(size), lists(sums)],
                names=["t", "c", "n", "s"],
            )

    parts = points.mapInArrow(partial, "t int, c int, n long, s array<double>")
    total = vector_to_array(Summarizer.sum(array_to_vector(F.col("s"))))
    return parts.groupBy("t", "c").agg(F.sum("n").alias("n"), total.alias("s"))


def _tiles(stats: DataFrame, count: int) -> DataFrame:
    """`tile, sums`: cluster sums of all trials, dealt to `count` tiles by hash."""

    def pack(table: pa.Table) -> pa.Table:
        t, c, n = (table.column(x).to_numpy() for x in ("t", "c", "n"))
        sums = matrix(table.column("s"))
        columns = {"tile": [table.column("tile")[0].as_py()], "t": [t.astype("<i4").tobytes()], "c": [c.astype("<i4").tobytes()]}
        columns |= {"n": [n.astype("<i8").tobytes()], "s": [sums.astype("<f8").tobytes()]}
        return pa.table(columns, schema=pa.schema([("tile", pa.int64()), *((x, pa.binary()) for x in ("t", "c", "n", "s"))]))

    dealt = stats.withColumn("tile", F.pmod(F.xxhash64("t", "c"), F.lit(count)))
    return dealt.groupBy("tile").applyInArrow(pack, "tile long, t binary, c binary, n binary, s binary")


def _blocks(points: DataFrame) -> DataFrame:
    """Rows packed as they lie, at most BLOCK_ROWS together: ids, vectors, and marks flattened."""

    def pack(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                row, t, c = _marks(batch)
                packed = [batch.column("row_id").to_numpy().astype("<i8"), matrix(batch.column("embedding")), row.astype("<i4"), t.astype("<i4"), c.astype("<i4")]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], names=["ids", "x", "row", "bt", "bc"])

    return points.mapInArrow(pack, "ids binary, x binary, row binary, bt binary, bc binary")


def _meet(batches):
    """Per row and trial of a block, `a` (own cluster, if in the tile) and `b` (nearest other cluster in the tile)."""
    for batch in batches:
        for place in range(batch.num_rows):
            got = {name: batch.column(name)[place].as_buffer() for name in ("ids", "x", "row", "bt", "bc", "t", "c", "n", "s")}
            ids, row, t, c = (np.frombuffer(got[name], kind) for name, kind in (("ids", "<i8"), ("row", "<i4"), ("bt", "<i4"), ("bc", "<i4")))
            x = np.frombuffer(got["x"], "<f8").reshape(len(ids), -1)
            trials, clusters, sizes = (np.frombuffer(got[name], kind) for name, kind in (("t", "<i4"), ("c", "<i4"), ("n", "<i8")))
            sums = np.frombuffer(got["s"], "<f8").reshape(len(trials), -1)
            for trial in np.unique(t):
                mine, theirs = t == trial, trials == trial
                cluster, n, s = clusters[theirs], sizes[theirs].astype(float), sums[theirs]
                xs, own = x[row[mine]], c[mine]
                if len(cluster):
                    far = 1 - xs @ s.T / n[None, :]
                    same = own[:, None] == cluster[None, :]
                    held, size = same.any(1), np.where(same, n[None, :], 0).sum(1)
                    near, b = np.where(same, far, 0).sum(1), np.where(same, np.inf, far).min(1)
                else:
                    held, size, near, b = np.zeros(len(xs), bool), np.zeros(len(xs)), np.zeros(len(xs)), np.full(len(xs), np.inf)
                # The row itself is at distance 1 - x.x from itself, which is 0 for a unit vector.
                inner = near * size - (1 - (xs * xs).sum(1))
                a = np.where(size > 1, inner / np.maximum(size - 1, 1), 0.0)
                columns = [
                    pa.array(ids[row[mine]]), pa.array(np.full(len(xs), trial, np.int32)), pa.array(a, mask=~held), pa.array(b),
                    pa.array(size.astype(np.int64), mask=~held),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row_id", "trial_ord", "a", "b", "own_size"])


def silhouettes(vectors: DataFrame, labels: DataFrame, budget: int = TILE_BYTES) -> DataFrame:
    """`trial_ord, silhouette` for every trial that has one.

    `labels` is `trial_ord, row_id, cluster_id`; `vectors` is `row_id, embedding` of unit
    length. A trial with fewer than two clusters, or whose clusters are all single rows,
    has no score and no row here; rows without a vector take no part. A tile holds sums of about `budget` bytes; with several, the parts of a row's
    score are merged, with one there is nothing to merge.
    """
    points = cut(vectors.select("row_id", "embedding").where(F.col("embedding").isNotNull()).join(gather_labels(labels), "row_id"))
    stats = cut(cluster_sums(points))
    shape = stats.agg(F.count(F.lit(1)).alias("k"), F.max(F.size("s")).alias("d")).first()
    if not shape["k"]:
        return points.sparkSession.createDataFrame([], "trial_ord int, silhouette double")
    count = max(-(-shape["k"] * (shape["d"] + 2) * 8 // budget), -(-shape["k"] // TILE_CLUSTERS))
    met = _blocks(points).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))).join(_tiles(stats, count), "tile")
    per_row = met.drop("tile").mapInArrow(_meet, "row_id long, trial_ord int, a double, b double, own_size long")
    if count > 1:
        per_row = per_row.groupBy("row_id", "trial_ord").agg(F.max("a").alias("a"), F.min("b").alias("b"), F.max("own_size").alias("own_size"))
    s = F.when(F.col("own_size") == 1, 0.0).otherwise(
        F.when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    )
    scored = per_row.groupBy("trial_ord").agg(
        F.avg(s).alias("silhouette"), F.max("own_size").alias("largest"), F.min("own_size").alias("smallest"), F.count(F.lit(1)).alias("n")
    )
    clusters = stats.groupBy(F.col("t").alias("trial_ord")).agg(F.count(F.lit(1)).alias("k"))
    return (
        scored.join(clusters, "trial_ord")
        .where((F.col("k") >= 2) & (F.col("largest") > 1))
        .select("trial_ord", "silhouette")
    )


def silhouette(vectors: DataFrame, labels: DataFrame) -> float | None:
    """Score of one labelling, None when it has none."""
    row = silhouettes(vectors, labels.select(F.lit(0).alias("trial_ord"), "row_id", "cluster_id")).first()
    return None if row is None else row["silhouette"]
