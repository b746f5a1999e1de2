"""Connected components by contraction: nodes move to a neighbour, over and over, until no link is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.runtime import cut, discard

MAX_ROUNDS = 100  # a round leaves at most half of the nodes that have links, on average: far above what is needed


def connected_components(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`[by,] node, component` for every node that has an edge in `src, dst`.

    The component id is its lowest node. In a round every node points to the lowest of itself and its neighbours, by a
    hash that differs from round to round, and moves to where that one points; links follow, and the next round
    goes on with those that still lead elsewhere. Whatever the ids or the length of a chain, nodes with links grow fewer by half. The aggregates
    combine before the shuffle, which keeps hubs harmless. Moves are put together from the last round back.
    """
    keys = list(by)
    links = cut(_one_way(edges, keys, F.col("src"), F.col("dst")))
    rounds: list[DataFrame] = []
    for number in range(MAX_ROUNDS):
        if links.isEmpty():
            break
        place = lambda node, number=number: F.struct(F.xxhash64(node, F.lit(number)).alias("h"), F.col(node).alias("at"))
        both = links.unionByName(links.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
        points = both.groupBy(*keys, F.col("src").alias("node")).agg(F.min(place("dst")).alias("near"))
        points = points.select(*keys, "node", F.least(place("node"), "near")["at"].alias("to"))
        onward = points.select(*keys, F.col("node").alias("to"), F.col("to").alias("into"))
        moves = cut(points.join(onward, [*keys, "to"]).select(*keys, "node", "into"))
        rounds.append(moves)
        a = moves.select(*keys, F.col("node").alias("src"), F.col("into").alias("a"))
        b = moves.select(*keys, F.col("node").alias("dst"), F.col("into").alias("b"))
        fewer = cut(_one_way(links.join(a, [*keys, "src"]).join(b, [*keys, "dst"]), keys, F.col("a"), F.col("b")))
        discard(links)
        links = fewer
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    discard(links)
    if not rounds:
        return edges.select(*keys, F.col("src").alias("node"), F.col("src").alias("component")).where(F.lit(False))
    ends = rounds.pop()
    while rounds:
        moves = rounds.pop()
        then = ends.select(*keys, F.col("node").alias("into"), F.col("into").alias("last"))
        whole = cut(moves.join(then, [*keys, "into"], "left").select(*keys, "node", F.coalesce("last", "into").alias("into")))
        discard(moves)
        discard(ends)
        ends = whole
    lowest = ends.groupBy(*keys, "into").agg(F.min("node").alias("component"))
    found = cut(ends.join(lowest, [*keys, "into"]).select(*keys, "node", "component"))
    discard(ends)
    return found


def _one_way(links: DataFrame, keys: list[str], a, b) -> DataFrame:
    """Each link once, from its lower end; those from a node to itself are left out."""
    return links.select(*keys, F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where((a != b)).distinct()
