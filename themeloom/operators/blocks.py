"""Vectors in blocks: the ground work of the exact neighbour and spanning-tree joins.

Points are assigned to the nearest of some pivots, whose number grows with the root of the table: a row compares itself with
coarse pivots first, and then with the pivots that lie at the nearest of those. A pivot's points form
a cell. Cells that lie near each other are packed into tiles, and a cell larger than a tile is split by hash over several,
so one group of near-identical vectors, however large, spreads over many tasks. A join compares two tiles, both ways, in one bounded
task, and in it only cells that may meet. There are about `TILES` tiles, so a row is sent to at most as many tasks
whatever the size of the table; only where such a tile would pass `TILE_BYTES` are there more.
Which cells meet is a table, worked out in tasks, and rows get there by an equi-join on the cell. The triangle inequality on
pivots and cell radii says which pairs of cells cannot hold anything of interest.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.ranking import hash_sample
from themeloom.runtime import cut

BLOCK_ROWS = 1024
TILES = 16
TILE_BYTES = 64 << 20  # of a tile's vectors
MOST_PARTITIONS = 10_000
COARSE_PROBES = 3  # coarse pivots whose pivots a row looks at


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), -1)


def lists(values: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


Rule = Callable[[int, np.ndarray], np.ndarray]


@dataclass
class Blocks:
    """`points` has `row_id, cell, tile, embedding` and the carried columns; `tiles` has `cell, tiles`, all that hold rows of the cell.

    `centers` and `radius` are arrays on the driver, with a row for each cell.
    """

    points: DataFrame
    centers: np.ndarray
    radius: np.ndarray
    tiles: DataFrame
    n_tiles: int

    def met(self, rule: Rule) -> Callable[[int], np.ndarray]:
        """For tasks: the cells that `rule(cell, gaps)` names for a cell.

        `gaps` has the least possible distance between a point of the cell and one of each cell, 0 for itself.
        """
        shared = self.points.sparkSession.sparkContext.broadcast((self.centers, self.radius, (self.centers**2).sum(1)))

        def members(c: int) -> np.ndarray:
            centers, radius, squares = shared.value
            apart = np.sqrt(np.maximum(squares[c] + squares - 2 * centers @ centers[c], 0))
            gap = np.maximum(apart - radius[c] - radius - 1e-9, 0)
            gap[c] = 0.0
            return np.asarray(rule(c, gap), np.int64)

        return members

    def pairs(self, rule: Rule) -> DataFrame:
        """`qc, mc`: for each cell those that the rule names."""
        members = self.met(rule)

        def run(batches):
            for batch in batches:
                for c in batch.column("id").to_pylist():
                    met = members(c)
                    columns = [np.full(len(met), c), met]
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in columns], names=["qc", "mc"])

        return self.points.sparkSession.range(len(self.centers)).mapInArrow(run, "qc int, mc int")


def cell_count(n: int, block_rows: int) -> int:
    """A cell for every block that all rows would fill, and no more than the root of the table."""
    return max(1, min(math.ceil(n / block_rows), max(1024, math.isqrt(n))))


def nearest_center(x: np.ndarray, centers: np.ndarray, coarse: int) -> tuple[np.ndarray, np.ndarray]:
    """(center, squared distance) for each row, by way of the first `coarse` centers; with one for each it is the nearest of all."""
    squares = (centers**2).sum(1)
    own = (x**2).sum(1)
    if coarse >= len(centers):
        away = own[:, None] + squares[None, :] - 2 * x @ centers.T
        cell = away.argmin(1)
        return cell, np.maximum(away[np.arange(len(x)), cell], 0)
    home = (squares[:, None] + squares[None, :coarse] - 2 * centers @ centers[:coarse].T).argmin(1)
    lists = [np.flatnonzero(home == c) for c in range(coarse)]
    rough = squares[None, :coarse] - 2 * x @ centers[:coarse].T
    probes = np.argpartition(rough, min(COARSE_PROBES, coarse) - 1, axis=1)[:, :COARSE_PROBES]
    best, cell = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for c in range(coarse):
        rows = np.flatnonzero((probes == c).any(1))
        if len(rows) and len(lists[c]):
            away = own[rows, None] + squares[None, lists[c]] - 2 * x[rows] @ centers[lists[c]].T
            near = away.argmin(1)
            least = away[np.arange(len(rows)), near]
            closer = least < best[rows]
            best[rows[closer]], cell[rows[closer]] = least[closer], lists[c][near[closer]]
    return cell, np.maximum(best, 0)


def make_blocks(vectors: DataFrame, block_rows: int = BLOCK_ROWS, carry: tuple[str, ...] = ()) -> Blocks:
    spark = vectors.sparkSession
    n_rows = vectors.count()
    n_cells = cell_count(n_rows, block_rows)
    pivots = hash_sample(vectors.select("row_id", "embedding"), n_cells, seed=7).collect()  # the root of the table
    centers = np.array([row["embedding"] for row in pivots], dtype=np.float64).reshape(len(pivots), -1 if pivots else 1)
    n_cells = len(centers)
    coarse = n_cells if n_cells <= 1024 else math.isqrt(n_cells)
    shared = spark.sparkContext.broadcast(centers)

    def assign(batches):
        for batch in batches:
            cell, squared = nearest_center(matrix(batch.column("embedding")), shared.value, coarse)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(squared))],
                names=[*batch.schema.names, "cell", "reach"],
            )

    base = vectors.select("row_id", F.col("embedding").cast("array<double>").alias("embedding"), *carry)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields)
    placed = cut(base.mapInArrow(assign, f"{schema}, cell int, reach double"))
    radius = np.zeros(n_cells)
    sizes = np.zeros(n_cells, np.int64)
    for row in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("r")).collect():  # one row per cell
        radius[row["cell"]], sizes[row["cell"]] = row["r"], row["n"]
    listed, n_tiles = _packed(centers, sizes, max(block_rows, min(-(-n_rows // TILES), TILE_BYTES // (8 * max(1, centers.shape[1])))))
    tiles = spark.createDataFrame(list(enumerate(listed)), "cell int, tiles array<int>")
    one = F.element_at("tiles", (F.pmod(F.xxhash64("row_id"), F.size("tiles")) + 1).cast("int"))
    points = placed.join(tiles, "cell").withColumn("tile", one).drop("reach", "tiles")
    return Blocks(points, centers, radius, tiles, n_tiles)


def _packed(centers: np.ndarray, sizes: np.ndarray, tile_rows: int) -> tuple[list[list[int]], int]:
    """The tiles of each cell, and their number: cells in the order of some coarse ones, a tile for about `tile_rows` rows."""
    coarse = centers[: math.isqrt(max(1, len(centers)))]
    home = ((coarse**2).sum(1)[None, :] - 2 * centers @ coarse.T).argmin(1) if len(centers) else np.empty(0, np.int64)
    listed: list[list[int]] = [[0] for _ in sizes]
    before = 0
    for c in np.argsort(home, kind="stable").tolist():
        parts = max(1, math.ceil(sizes[c] / tile_rows))
        listed[c] = sorted({int((before + i * sizes[c] // parts) // tile_rows) for i in range(parts)})
        before += int(sizes[c])
    return listed, max((t for tiles in listed for t in tiles), default=0) + 1


def pair_up(blocks: Blocks, pairs: DataFrame) -> DataFrame:
    """Rows of every two tiles that hold cells of `pairs`, keyed by `qt, mt` (`qt <= mt`), `side` 0 for those of `qt`, else 1.

    `pairs` are those of `Blocks.pairs`. A row is sent once to each tile that its cell meets or is met by, not once to each cell
    and not again for the other way.
    """
    points, tiles = blocks.points, blocks.tiles
    pairs = cut(pairs)
    other = [c for c in points.columns if c != "tile"]
    asked = pairs.join(tiles, F.col("mc") == F.col("cell")).select(F.col("qc").alias("met"), F.explode("tiles").alias("to"))
    offered = pairs.join(tiles, F.col("qc") == F.col("cell")).select(F.col("mc").alias("met"), F.explode("tiles").alias("to"))
    sent = asked.unionByName(offered).distinct()
    rows = points.join(sent, F.col("cell") == F.col("met")).select(
        F.least("tile", "to").alias("qt"), F.greatest("tile", "to").alias("mt"), (F.col("tile") > F.col("to")).cast("int").alias("side"), *other
    )
    return rows.repartition(min(MOST_PARTITIONS, blocks.n_tiles**2), "qt", "mt")  # a pair is work, however few bytes it has


def sides(table: pa.Table, *columns: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """`cell, row_id, embedding` and `columns` of either tile, by cell and row; rows without finite vectors are left out."""
    side = table.column("side").to_numpy()
    x = matrix(table.column("embedding")) if len(side) else np.empty((0, 0))
    finite = np.isfinite(x).all(axis=1)
    cell, ids = table.column("cell").to_numpy(), table.column("row_id").to_numpy()
    found = []
    for number in (0, 1):
        at = np.flatnonzero((side == number) & finite)
        at = at[np.lexsort((ids[at], cell[at]))]
        found.append([cell[at], ids[at], x[at], *(table.column(c).to_numpy()[at] for c in columns)])
    return found[0], found[1]


def both_ways(table: pa.Table, *columns: str, shape: Callable = lambda *side: side) -> list[tuple]:
    """Queries and members, as `sides` has them and `shape` makes them, of two tiles: each asks the other, and a tile on its own itself."""
    one, two = (shape(*side) for side in sides(table, *columns))
    alone = table.num_rows and table.column("qt")[0].as_py() == table.column("mt")[0].as_py()
    return [(one, one)] if alone else [(one, two), (two, one)]
