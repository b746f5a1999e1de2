"""Near-duplicates by SimHash fingerprints and a hierarchical index in Gray order.

Neighbours in Gray order differ in few bits. An index node therefore stands for a run of sorted
fingerprints that share many bits; it keeps those as a masked pattern, and its children keep only
what they share beyond it. A search walks down and adds up differences on the masked bits,
and a node that exceeds the distance drops with everything below.

Two fingerprints that differ in at most three bits agree on one of four blocks of bits. Rows are
dealt by such a block; a block value with more fingerprints than one index should hold is dealt again
by four blocks of the remaining bits, and so on. Each step is exact, so no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.batches import map_texts, texts_of
from themeloom.operators.components import connected_components
from themeloom.runtime import cut

SHINGLE = 3
SEED = 42
DISTANCE = 3
FAN = 8
INDEX_ROWS = 2048  # fingerprints that agree on a block, before it is dealt again
SEARCH_ROWS = 1 << 21
HASH_BLOCK = 1 << 16
WIDTHS = ((16, 16, 16, 16), (12, 12, 12, 12), (9, 9, 9, 9), (7, 7, 7, 6))


def fingerprint(text: str | None) -> int:
    """64-bit fingerprint of the three-word shingles of a text; 0 if it has no word."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    size = min(SHINGLE, len(words))
    first, last = starts[: len(words) - size + 1], ends[size - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), HASH_BLOCK):
        pairs = zip(first[at : at + HASH_BLOCK].tolist(), last[at : at + HASH_BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` columns and `fingerprint` (long, the 64 bits); null and empty texts get 0. No shuffle."""
    rows = df.select(*keep, F.col(text).alias("_text"))
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)

    def work(batch):
        marks = pa.array([fingerprint(t) for t in texts_of(batch, "_text")], pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), marks], names=[*keep, "fingerprint"])

    return map_texts(rows, f"{kinds}fingerprint long", work, "_text")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each word in the Gray code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayForest:
    """One index for each group of sorted fingerprints; a level holds all nodes of that height."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        """`values` in Gray order within each group; groups begin at `starts`."""
        self.values = values
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
        every, some, first, last = values, values, np.arange(len(values)), np.arange(len(values)) + 1
        self.levels = []
        while True:
            heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            within = np.arange(len(group)) - np.repeat(heads, np.diff(np.append(heads, len(group))))
            heads = np.flatnonzero(within % FAN == 0)
            stops = np.append(heads[1:], len(group))
            every, some = np.bitwise_and.reduceat(every, heads), np.bitwise_or.reduceat(some, heads)
            group, first, last = group[heads], first[heads], last[stops - 1]
            mask = ~(every ^ some)  # the bits in which all below agree
            self.levels.append((mask, every & mask, heads, stops, last))
            if len(group) == len(starts):
                break
        self.levels.reverse()
        self.group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))

    def pairs(self, first: int, stop: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (i, j), i in first..stop and j > i, of fingerprints of a group within `distance` bits."""
        query = np.arange(first, stop)
        node = self.group[query]
        word = self.values[query]
        mask, pattern, heads, stops, last = self.levels[0]
        differ = np.bitwise_count((word ^ pattern[node]) & mask[node]).astype(np.int64)
        for depth in range(len(self.levels)):
            near = (differ <= distance) & (last[node] > query + 1)
            query, node, differ = query[near], node[near], differ[near]
            count = stops[node] - heads[node]
            total = np.cumsum(count)
            child = np.repeat(heads[node] - (total - count), count) + np.arange(total[-1] if len(total) else 0)
            query, differ, known = np.repeat(query, count), np.repeat(differ, count), np.repeat(mask[node], count)
            word = self.values[query]
            if depth + 1 < len(self.levels):
                mask, pattern, heads, stops, last = self.levels[depth + 1]
                differ += np.bitwise_count((word ^ pattern[child]) & mask[child] & ~known)
            else:
                differ += np.bitwise_count((word ^ self.values[child]) & ~known)
            node = child
        near = (differ <= distance) & (node > query)
        return query[near], node[near]


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`labels` (a position of each item's set, its own lowest) after joining the sets of each pair."""
    while True:
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        open_ = low < high
        if not open_.any():
            return labels
        a, b = a[open_], b[open_]
        np.minimum.at(labels, high[open_], low[open_])
        while not np.array_equal(labels, further := labels[labels]):
            labels = further


def links_of_groups(path: np.ndarray, bits: np.ndarray, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each group of equal (path, bits), as pairs of fingerprints."""
    rank = gray_rank(values)
    order = np.lexsort((rank, bits, path))
    path, bits, values = path[order], bits[order], values[order]
    starts = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (bits[1:] != bits[:-1])))
    sizes = np.diff(np.append(starts, len(values)))
    many = np.repeat(sizes > 1, sizes)
    values, sizes = values[many], sizes[sizes > 1]
    if not len(values):
        return values, values
    forest = GrayForest(values, np.cumsum(sizes) - sizes)
    labels = np.arange(len(values))
    chunk = max(1, SEARCH_ROWS // int(sizes.max()))
    for at in range(0, len(values), chunk):
        labels = merge_labels(labels, *forest.pairs(at, min(at + chunk, len(values)), distance))
    linked = np.flatnonzero(labels != np.arange(len(values)))
    return values[linked], values[labels[linked]]


def _link_batches(distance: int):
    """Groups come sorted by (path, bits); the last group of a batch waits for the next batch."""

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                now = [np.concatenate(pair) for pair in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            edge = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            whole = int(edge[-1]) + 1 if len(edge) else 0
            held = [x[whole:] for x in now]
            if whole:
                yield emit([x[:whole] for x in now])
        if held is not None and len(held[0]):
            yield emit(held)

    def emit(columns):
        src, dst = links_of_groups(columns[0], columns[1], columns[2].view(np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

    return run


def _masks(level: int) -> list[int]:
    """The bits of each path down to `level`: one block of the bits that are left at each step."""
    paths = [((), tuple(range(64)))]
    for widths in WIDTHS[: level + 1]:
        longer = []
        for used, left in paths:
            at = 0
            for width in widths:
                longer.append((used + left[at : at + width], left[:at] + left[at + width :]))
                at += width
        paths = longer
    return [sum(1 << bit for bit in used) for used, _ in paths]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(rows: DataFrame, level: int) -> DataFrame:
    """`rows` (fingerprint, path) once for each block of the next level."""
    masks = [_signed(m) for m in _masks(level)]
    paths = F.sequence(F.col("path") * 4, F.col("path") * 4 + 3)
    table = F.array(*(F.lit(m).cast("long") for m in masks))
    deeper = rows.select("fingerprint", F.explode(paths).alias("path"))
    return deeper.withColumn("bits", F.col("fingerprint").bitwiseAND(F.element_at(table, F.col("path") + 1)))


def links(marks: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """`src, dst`: links that connect all fingerprints within `distance` (at most 3) bits, each group's as a forest.

    `marks` holds distinct fingerprints. A group of more than `INDEX_ROWS` goes to the next level,
    where its fingerprints agree on more bits; on the last level, 57 or 58 of 64, groups are small by themselves.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError("four blocks find distances of up to three bits")
    rows = marks.select("fingerprint", F.lit(0).alias("path"))
    found = []
    for level in range(len(WIDTHS)):
        rows = _dealt(rows, level)
        small = rows
        if level + 1 < len(WIDTHS):
            full = cut(rows.groupBy("path", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > INDEX_ROWS).drop("n"))
            if full.isEmpty():
                level = len(WIDTHS)
            else:
                small = rows.join(full, ["path", "bits"], "left_anti")
        grouped = small.select("path", "bits", "fingerprint").repartition("path", "bits").sortWithinPartitions("path", "bits")
        found.append(grouped.mapInArrow(_link_batches(distance), "src long, dst long"))
        if level >= len(WIDTHS) - 1:
            break
        rows = rows.join(full, ["path", "bits"], "left_semi").select("fingerprint", "path")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components(marks: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """`fingerprint, component` for each distinct fingerprint of `marks`; a component is named by its lowest one."""
    nodes = cut(marks.select("fingerprint").distinct())
    parts = connected_components(links(nodes, distance))
    placed = nodes.join(parts, nodes["fingerprint"] == parts["node"], "left")
    return cut(placed.select("fingerprint", F.coalesce("component", "fingerprint").alias("component")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """`key, fingerprint (16 hex digits), component_id`: the smallest key reachable over linked fingerprints.

    Texts without a word (null, empty) share fingerprint 0 and are linked like others. Equal
    fingerprints are one node from the start, so copies cost one row each. A null key is kept and gets
    its component, but is never the smallest; a component of null keys alone has a null id. Repeated rows stay.
    """
    named = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    marks = cut(fingerprints(named, ("_key",), "_text"))
    classes = components(marks, distance)
    first = marks.groupBy("fingerprint").agg(F.min("_key").alias("first"))
    lowest = classes.join(first, "fingerprint").groupBy("component").agg(F.min("first").alias("component_id"))
    ids = cut(classes.join(lowest, "component").select("fingerprint", "component_id"))
    return marks.join(ids, "fingerprint").select(
        F.col("_key").alias(key), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The row with the smallest key of each component of `near_duplicates`, with all its columns.

    Rows without a key come after all others; of repeated rows one stays.
    """
    columns = df.columns
    renamed = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    marked = cut(fingerprints(renamed, tuple(names.values()), names[text]).withColumn("row", F.monotonically_increasing_id()))
    classes = components(marked, distance)
    order = F.struct(F.col(names[key]).isNull(), F.col(names[key]), F.col("row"))
    best = marked.groupBy("fingerprint").agg(F.min(order).alias("best"))
    chosen = cut(
        best.join(classes, "fingerprint").groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row").alias("chosen"))
    )
    # most rows are chosen, so the list grows with the table: merged at every size, never broadcast
    kept = marked.join(chosen.hint("merge"), F.col("row") == F.col("chosen"), "left_semi")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
