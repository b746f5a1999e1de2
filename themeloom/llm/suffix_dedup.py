"""Removing repeated byte strings with suffix arrays built by two-stage sorting.

A string of `LENGTH` bytes contains one smallest hashed gram of `GRAM` bytes, its anchor, which depends on
its bytes alone. Strings are counted by anchor, and only those whose anchor occurs again, with different
surroundings, go to suffix sorting; equal surroundings are equal strings already. Texts that share an anchor
meet in one task as contexts: the bytes of all strings of one occurrence of the anchor. An anchor with more
contexts than one task should sort is replaced by longer ones until its groups are small.

The suffix array of a task's contexts is sorted in two stages: suffixes smaller than their successors are
sorted directly, all others follow from a scan over the buckets of first bytes. A string is repeated
where an adjacent common prefix reaches `LENGTH`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.batches import CHUNK_BYTES, map_texts, slices
from themeloom.llm.hashing import BASES, Prefix
from themeloom.runtime import cut

LENGTH = 400
GRAM = 128
PLACE_BITS = 20
SORT_BYTES = 2 << 20
GROUP_ROWS = 512
HOT_ROWS, HOT_KEYS, DEALS = 4096, 4096, 64  # a key of more rows is dealt over as many tasks; so many keys at most, the fullest


# --- anchors


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive values, from block prefixes and suffixes."""
    n = len(values)
    blocks = np.full((-(-n // width), width), np.uint64(2**64 - 1))
    blocks.ravel()[:n] = values
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored(raw: bytes) -> list[np.ndarray]:
    """[anchor place, first start, end of starts, anchor hash, hash of the surroundings] of all strings of a text.

    The starts from first to end (exclusive) have the same anchor; their surroundings reach `LENGTH` - 1 bytes further.
    """
    out = []
    step = (1 << PLACE_BITS) - LENGTH
    for at in range(0, max(0, len(raw) - LENGTH + 1), step):
        part = raw[at : at + step + LENGTH - 1]
        grams = Prefix(part, BASES[0]).windows(GRAM)
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        end = np.append(first[1:], len(place))
        around = Prefix(part, BASES[1]).ranges(first, end + LENGTH - 1)
        place = place[first]
        out.append([place + at, first + at, end + at, grams[place], around])
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 5


# --- suffix arrays


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number; zeros follow the text."""
    padded = np.zeros(len(text) + 8, np.uint64)
    padded[: len(text)] = text
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def ascending_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last suffix is not."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    nearest = np.where(differs, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]  # where the run of equal bytes ends
    following = np.append(text[1:], np.uint8(0)).astype(np.int16)
    following[-1] = -1
    return text[nearest] < following[nearest]


def _refined(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split the ties of `active` (whole groups of equal rank) by `key`; returns those still tied."""
    order = np.lexsort((key, rank[active]))
    active, key = active[order], key[order]
    old = rank[active]
    at = np.arange(len(active))
    group = np.append(True, old[1:] != old[:-1])
    fresh = group | np.append(True, key[1:] != key[:-1])
    start = np.maximum.accumulate(np.where(fresh, at, 0))
    rank[active] = old + start - np.maximum.accumulate(np.where(group, at, 0))
    size = np.diff(np.append(np.flatnonzero(fresh), len(active)))
    return active[np.repeat(size > 1, size)]


def sorted_ascending(text: np.ndarray, words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at `places` (all that are smaller than their successors) in order, as far as `depth` bytes tell.

    The text between two such places is a name. Names are sorted by eight bytes at a time; sequences
    of names by doubling, and only while they are tied. A name that ends fills up with 0xFF, which UTF-8 does not
    have: where one name ends another may only descend, so the one that ends is the larger.
    """
    n = len(places)
    if not n:
        return places
    length = np.diff(np.append(places, len(text) - 1)) + 1
    keep = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], np.uint64)
    rank = np.zeros(n, np.int64)
    active, taken = np.arange(n), 0
    while len(active):
        left = np.minimum(length[active] - taken, 8)
        key = (words[np.minimum(places[active] + taken, len(text) - 1)] & keep[left]) | ~keep[left]
        active = _refined(rank, active, key)
        taken += 8
        active = active[length[active] >= taken]  # one that just ended is still to be told from longer ones
    order = np.argsort(rank, kind="stable")
    tied = np.append(rank[order][1:] == rank[order][:-1], False)
    active = order[tied | np.append(False, tied[:-1])]
    step = 1
    far = np.append(places, np.full(1, len(text) + depth))
    while len(active):
        ahead = np.minimum(active + step, n)
        active = active[far[ahead] - places[active] < depth]
        if not len(active):
            break
        key = rank[active + step]  # the end of the text is unique, so a tie never reaches it
        active = _refined(rank, active, key)
        step *= 2
    return places[np.argsort(rank, kind="stable")]


def closed(raw: bytes) -> np.ndarray:
    """Bytes (below 0xFE) raised by one, and a zero that occurs nowhere else."""
    return np.append(np.frombuffer(raw, np.uint8) + np.uint8(1), np.uint8(0))


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes of a `closed` text, sorted at least by their first `depth` bytes."""
    ascending = ascending_types(text)
    words = words_at(text)
    direct = sorted_ascending(text, words, np.flatnonzero(ascending), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    queues[text[-1]].append(np.array([len(text) - 1]))
    out = []
    for byte in range(256):
        bucket = []
        wave = np.concatenate(queues[byte]) if queues[byte] else np.empty(0, np.int64)
        while len(wave):  # runs of one byte follow within the bucket
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == byte) & ~ascending[before]]
        bucket.append(direct[bounds[byte] : bounds[byte + 1]])
        whole = np.concatenate(bucket)
        queues[byte] = []
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[(text[before] > byte)]
        kinds = text[before]
        before = before[np.argsort(kinds, kind="stable")]
        counts = np.bincount(kinds, minlength=256)
        ends = np.cumsum(counts)
        for kind in np.flatnonzero(counts):
            queues[kind].append(before[ends[kind] - counts[kind] : ends[kind]])
    return np.concatenate(out)


def common_prefixes(words: np.ndarray, order: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix in `order` with the next one, in steps of eight bytes, up to `limit`."""
    out = np.full(max(0, len(order) - 1), limit, np.int64)
    open_ = np.arange(len(out))
    for at in range(0, limit, 8):
        same = words[order[open_] + at] == words[order[open_ + 1] + at]
        out[open_[~same]] = at
        open_ = open_[same]
    return out


def repeated_starts(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context a mask over its starts of whole strings: does the string occur at another start?"""
    text = closed(b"\0".join(contexts))
    sizes = np.array([len(c) for c in contexts])
    at = np.cumsum(sizes + 1) - sizes - 1  # a separator follows each context
    counts = np.maximum(sizes - LENGTH + 1, 0)
    whole = np.zeros(len(text), bool)
    starts = np.repeat(at - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    whole[starts] = True
    order = suffix_array(text)
    order = order[whole[order]]
    reach = common_prefixes(words_at(text), order) >= LENGTH
    found = np.zeros(len(text), bool)
    found[order[:-1][reach]] = True
    found[order[1:][reach]] = True
    return [found[a : a + n] for a, n in zip(at, counts, strict=True)]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


# --- tables


def _anchor_rows(rows: DataFrame) -> DataFrame:
    schema = "k1 long, k2 long, place int, first int, end int, h long, c long"

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = piece.column("text").to_pylist()
                found = [anchored(t.encode()) for t in texts]
                sizes = [len(f[0]) for f in found]
                keys = [np.repeat(piece.column(k).to_numpy(), sizes) for k in ("k1", "k2")]
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                arrays = keys + [c.astype(np.int32) for c in columns[:3]] + [c.astype(np.uint64).view(np.int64) for c in columns[3:]]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["k1", "k2", "place", "first", "end", "h", "c"])

    return rows.mapInArrow(run, schema)


def _joined(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with what `counted` (a row for each of the `keys`, with their number as `rows`) says of its keys; others go.

    A very common passage is one key, and would be one task's: such keys get a third part, which deals their rows.
    `counted` holds each of them once for every deal.
    """
    hot = counted.where(F.col("rows") > HOT_ROWS).orderBy(F.col("rows").desc(), *keys).limit(HOT_KEYS)
    hot = F.broadcast(cut(hot.select(*keys, F.lit(True).alias("hot"))))
    deal = F.when(F.col("hot"), F.col("turn") % DEALS).otherwise(F.lit(0))
    dealt = rows.withColumn("turn", F.monotonically_increasing_id()).join(hot, keys, "left").withColumn("deal", deal.cast("int"))
    deals = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(DEALS - 1))).otherwise(F.array(F.lit(0)))
    said = counted.drop("rows").join(hot, keys, "left").withColumn("deal", F.explode(deals))
    return dealt.drop("hot", "turn").join(said.drop("hot"), [*keys, "deal"]).drop("deal")


def _half_shared(contexts: DataFrame) -> DataFrame:
    """Each context as two: its strings that reach further left of the anchor, and those that reach further right.

    `body` holds the strings of the starts first..end, `core_from` and `core_to` bound the bytes that the anchor now
    stands for. Every string of one half contains a longer anchor, which becomes the key.
    """
    span = F.col("end") - F.col("first")
    rest = F.lit(LENGTH) - (F.col("core_to") - F.col("core_from"))
    half = F.floor((rest + 1) / 2).cast("int")
    edge = F.col("core_from") - half  # the last start whose string has that much on the left
    left_n = F.greatest(F.lit(0), F.least(span, edge + 1))
    left = F.struct(
        F.lit(0).alias("skip"), left_n.alias("n"), (F.col("core_from") - half).alias("a"), F.col("core_to").alias("b")
    )
    skip = F.greatest(F.lit(0), edge + 1)
    right = F.struct(
        skip.alias("skip"), (span - skip).alias("n"), F.col("core_from").alias("a"), (F.col("core_to") + rest - half + 1).alias("b")
    )
    halves = contexts.select("*", F.explode(F.array(left, right)).alias("part")).where("part.n > 0")
    core = F.col("body").substr(F.col("part.a") + 1, F.col("part.b") - F.col("part.a"))
    first = F.col("first") + F.col("part.skip")
    return halves.select(
        F.xxhash64("key", core).alias("key"), "n", "k1", "k2", first.alias("first"), (first + F.col("part.n")).alias("end"),
        (F.col("part.a") - F.col("part.skip")).alias("core_from"), (F.col("part.b") - F.col("part.skip")).alias("core_to"),
        F.col("body").substr(F.col("part.skip") + 1, F.col("part.n") + LENGTH - 1).alias("body"),
    )


def _sorted_groups(contexts: DataFrame) -> DataFrame:
    """Repeated starts of the contexts that occur once, from suffix arrays over whole groups of equal key."""
    names = ["key", "n", "k1", "k2", "first", "body"]

    def resolve(held):
        key, n, k1, k2, first, body = held
        order = np.argsort(key, kind="stable")
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        order = order[count[which[order]] > 1]
        out = [[], [], [], []]
        if len(order):
            for i, mask in zip(order.tolist(), repeated_starts([body[i] for i in order.tolist()]), strict=True):
                if n[i] == 1:
                    a, b = runs(mask)
                    for column, values in zip(out, (np.full(len(a), k1[i]), np.full(len(a), k2[i]), first[i] + a, first[i] + b), strict=True):
                        column.append(values)
        arrays = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
        kinds = [np.int64, np.int64, np.int32, np.int32]
        return pa.RecordBatch.from_arrays([pa.array(a.astype(k)) for a, k in zip(arrays, kinds, strict=True)], names=["k1", "k2", "first", "end"])

    def run(batches):
        held, size = None, 0
        for batch in batches:
            for piece in slices(batch, "body", SORT_BYTES):
                now = [piece.column(c).to_numpy() for c in names[:-1]] + [piece.column("body").to_pylist()]
                held = now if held is None else [np.concatenate(p) for p in zip(held[:-1], now[:-1], strict=True)] + [held[-1] + now[-1]]
                size = sum(map(len, held[-1]))
                other = np.flatnonzero(held[0] != held[0][-1])  # the last group may go on
                if size >= SORT_BYTES and len(other):
                    whole = int(other[-1]) + 1
                    yield resolve([c[:whole] for c in held])
                    held = [c[whole:] for c in held]
        if held is not None and len(held[0]):
            yield resolve(held)

    sorted_ = contexts.select(*names).repartition("key").sortWithinPartitions("key")
    return sorted_.mapInArrow(run, "k1 long, k2 long, first int, end int")


def repeated_strings(rows: DataFrame) -> DataFrame:
    """`k1, k2, first, end`: the starts, from first to end (exclusive), of strings that occur more than once.

    `rows` holds `k1, k2` (together the name of a text) and `text`. Every row counts as an occurrence.
    """
    anchors = cut(_anchor_rows(rows.where(F.octet_length("text") >= LENGTH)))
    again = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.min("c").alias("low"), F.max("c").alias("high"))
    again = cut(again.where("rows > 1").select("h", "rows", (F.col("low") != F.col("high")).alias("contested")))
    shared = cut(_joined(anchors, again, ["h"]))
    ranges = ["k1", "k2", "first", "end"]
    found = [shared.where("NOT contested").select(*ranges)]

    open_ = shared.where("contested")
    kinds = cut(
        open_.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "place", "first", "end")).alias("one"))
    )
    twice = kinds.where("n > 1").select("h", "c", F.col("n").alias("rows"))
    found.append(_joined(open_, twice, ["h", "c"]).select(*ranges))

    named = rows.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.encode("text", "UTF-8").alias("bytes"))
    place = F.col("place") - F.col("first")
    contexts = (
        kinds.select(F.col("h").alias("key"), "n", "one.*")
        .join(named, (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")))
        .select(
            "key", F.col("n").cast("long").alias("n"), *ranges, place.alias("core_from"), (place + GRAM).alias("core_to"),
            F.col("bytes").substr(F.col("first") + 1, F.col("end") - F.col("first") + LENGTH - 1).alias("body"),
        )
    )
    contexts = cut(contexts)
    while True:
        full = cut(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > GROUP_ROWS).select(F.col("key").alias("fk")))
        if full.isEmpty():
            found.append(_sorted_groups(contexts))
            break
        big = F.col("key") == F.col("fk")
        found.append(_sorted_groups(contexts.join(full, big, "left_anti")))
        large = contexts.join(full, big, "left_semi")
        single = F.col("core_to") - F.col("core_from") >= LENGTH  # the anchor is the string: all members are equal
        found.append(large.where(single & (F.col("n") == 1)).select(*ranges))
        contexts = cut(_half_shared(large.where(~single)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, n_bytes, n_removed, n_spans, kept binary` for every row.

    Removed is each byte covered by a string of 400 bytes that also starts elsewhere, in the same text or
    another, as the texts came; copies and overlaps count. A null text is empty, shorter texts are never
    touched. Repeated rows are occurrences of each other; null keys are kept. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("_key"), body.alias("text"))
    rows = rows.withColumns({"k1": F.xxhash64("_key", "text"), "k2": F.xxhash64("text", "_key")})
    ranges = repeated_strings(rows.select("k1", "k2", "text"))
    per_text = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "end")).alias("ranges"))
    joined = rows.join(
        per_text.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), "ranges"),
        (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left",
    ).select("_key", "text", "ranges.first", "ranges.end")

    def work(batch):
        out = []
        for body, first, end in zip(*(batch.column(c).to_pylist() for c in ("text", "first", "end")), strict=True):
            raw = body.encode()
            steps = np.zeros(len(raw) + 1, np.int32)
            if first:
                np.add.at(steps, np.array(first), 1)
                np.add.at(steps, np.array(end) + LENGTH - 1, -1)
            gone = np.cumsum(steps[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((len(raw), len(raw) - len(kept), len(runs(gone)[0]), kept))
        columns = zip(*out, strict=True)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [batch.column("_key"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["_key", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    kind = rows.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    return map_texts(joined, schema, work, limit=CHUNK_BYTES).withColumnRenamed("_key", key)
