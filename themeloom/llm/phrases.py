"""Collocations: phrases whose words occur together more often than apart.

A word and the three after it, lead columns padded where the piece ends, make its longest window. Only those windows are
counted; Spark's ROLLUP sums the counts to ever shorter prefixes, so that every phrase of one to four words has its
number of occurrences from one aggregation.

A phrase is no more frequent than its words and its pairs of words. So a window is padded from the first word, or pair
of words, that is surely too rare for any candidate. Two filters of bounded size say which are; they err only towards keeping.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.batches import slices
from themeloom.llm.hashing import Prefix, mix
from themeloom.llm.words import Collision, Words, classes, split
from themeloom.runtime import cut

GAPS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
LONGEST = 4
LEAST = 30  # occurrences of a candidate
TOP = 2000
SCALE = 2_000_000
INSIDE = (80, 100)  # a phrase goes if a longer one has this share of its occurrences
UNKNOWN = "und"
CHUNK = 1 << 21  # bytes of text counted together
BITS_EACH, MOST_BITS = 64, 1 << 29  # of a filter: 64 MB at most; a fuller filter keeps more, and the result is the same
SEEDS = 4
W = [f"w{i}" for i in range(LONGEST)]


def _ids(found: Words, langs: list[str]) -> np.ndarray:
    """A number other than 0 for each word, of its hash and its language's."""
    names, which = np.unique(np.array(langs, object), return_inverse=True)
    own = np.array([Prefix(x.encode()).ranges(np.array([0]), np.array([len(x.encode())]))[0] for x in names], np.uint64)
    # not symmetric: a word may read like the name of its language
    ids = mix(found.hash + (own * np.uint64(0x9E3779B97F4A7C15))[which][found.text]) if len(langs) else found.hash
    ids[ids == 0] = 1
    return ids


def _pairs(ids: np.ndarray, found: Words) -> tuple[np.ndarray, np.ndarray]:
    """For every word but the last: a hash of it and the next, and whether that is in the same piece."""
    return mix(ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]), found.piece[:-1] == found.piece[1:]


class Filter:
    """A set of 64-bit numbers as bits; it may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = ids >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _filter(ids: DataFrame, column: str) -> Filter:
    """The filter of a column; its bits are set by an aggregate, and only they come to the driver."""
    count = ids.count()
    size = max(1 << 10, min(MOST_BITS, 1 << (BITS_EACH * count).bit_length()))
    slot = F.shiftrightunsigned(F.col(column), 64 - size.bit_length() + 1)
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits"))
    table = words.toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return Filter(bits.astype("<i8").view(np.uint8))


def _map(rows: DataFrame, schema: str, work) -> DataFrame:
    """`work` on the words of bounded pieces of the texts; it returns arrays, one for each column."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", CHUNK):
                columns = work(piece)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return rows.mapInArrow(run, schema)


def vocabulary(rows: DataFrame, seed: int) -> DataFrame:
    """`id, lang, word, c`: how often each word occurs in each language."""

    def work(piece):
        langs = piece.column("lang").to_pylist()
        found = split(piece.column("text"), classes(GAPS, BREAKS), seed, check=True)
        ids, first, count = found.counted(_ids(found, langs), found.check, np.unique(np.array(langs, object), return_inverse=True)[1][found.text])
        lang = pa.array([langs[i] for i in found.text[first]], pa.string())
        return ids.view(np.int64), lang, found.bytes_of(first), count.astype(np.int64)

    counted = _map(rows, "id long, lang string, word string, c long", work)
    return counted.groupBy("id", "lang", "word").agg(F.sum("c").alias("c"))


def pair_counts(rows: DataFrame, seed: int, words) -> DataFrame:
    """`pair, c`: occurrences of neighbouring words that are both in the filter."""

    def work(piece):
        found = split(piece.column("text"), classes(GAPS, BREAKS), seed)
        ids = _ids(found, piece.column("lang").to_pylist())
        if len(ids) < 2:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        good = words.value.has(ids)
        pair, together = _pairs(ids, found)
        pair, count = np.unique(pair[together & good[:-1] & good[1:]], return_counts=True)
        return pair.view(np.int64), count.astype(np.int64)

    return _map(rows, "pair long, c long", work).groupBy("pair").agg(F.sum("c").alias("c"))


def combined(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some columns and how often each occurs."""
    key = columns[0]
    for column in columns[1:]:
        key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + column)
    _, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if any((c[first][which] != c).any() for c in columns):
        exact, count = np.unique(np.column_stack(columns), axis=0, return_counts=True)
        return list(exact.T), count
    return [c[first] for c in columns], count


def windows(rows: DataFrame, seed: int, words, pairs) -> DataFrame:
    """`w0 .. w3, c`: the longest window of each word, padded with 0, and how often it occurs."""

    def work(piece):
        found = split(piece.column("text"), classes(GAPS, BREAKS), seed)
        ids = _ids(found, piece.column("lang").to_pylist())
        good = words.value.has(ids) if len(ids) else np.empty(0, bool)
        leads = [np.where(good, ids, np.uint64(0))]
        on = good
        for k in range(1, LONGEST):
            if k == 1:
                linked = np.zeros(len(ids), bool)
                if len(ids) > 1:
                    pair, together = _pairs(ids, found)
                    linked[:-1] = together & good[1:] & pairs.value.has(pair)
            ahead = np.append(linked[k - 1 :], np.zeros(min(k - 1, len(ids)), bool))[: len(ids)]
            on = on & ahead
            leads.append(np.where(on, np.append(ids[k:], np.zeros(min(k, len(ids)), np.uint64))[: len(ids)], np.uint64(0)))
        leads, count = combined([lead[good] for lead in leads])
        return *(np.ascontiguousarray(lead).view(np.int64) for lead in leads), count.astype(np.int64)

    return _map(rows, ", ".join(f"{w} long" for w in W) + ", c long", work)


def frequencies(counted: DataFrame, least: int) -> DataFrame:
    """`size, w0 .. w3, a` of every phrase that occurs `least` times or more: windows summed to shorter and shorter prefixes."""
    rolled = counted.rollup(*W).agg(F.sum("c").alias("a"), F.grouping_id().alias("g"))
    size = LONGEST - F.bit_count("g")
    last = F.coalesce(*(F.col(w) for w in reversed(W)))  # of the words that are not summed over
    kept = rolled.where((F.col("a") >= least) & (last != 0))
    return kept.select(size.cast("int").alias("size"), *(F.coalesce(w, F.lit(0).cast("long")).alias(w) for w in W), "a")


def _part(at: int, size: int) -> list[Column]:
    """`size` words from place `at` on, padded."""
    return [F.col(W[at + i]) if i < size and at + i < LONGEST else F.lit(0).cast("long") for i in range(LONGEST)]


def _parts(phrases: DataFrame, parts: list[tuple[int, int, int]], *more: str) -> DataFrame:
    """A row (`p0 .. p3`, `from`) for each (phrase size, place, size) that fits; `more` columns stay."""
    rows = [
        F.when(F.col("size") == of, F.struct(F.lit(at).alias("from"), *(c.alias(f"p{i}") for i, c in enumerate(_part(at, size)))))
        for of, at, size in parts
    ]
    return phrases.select(*more, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("part")).select(*more, "part.*")


def scored(phrases: DataFrame) -> DataFrame:
    """`size, w0 .. w3, a, l, r, score` of the candidates that no longer candidate makes idle."""
    whole = F.col("size") >= 2
    long = "decimal(20,0)"
    candidates = phrases.where(whole)
    counts = phrases.select(*(F.col(w).alias(f"p{i}") for i, w in enumerate(W)), F.col("a").alias("f"))
    keys = [f"p{i}" for i in range(LONGEST)]
    sizes = range(2, LONGEST + 1)
    first = _parts(candidates, [(n, 0, k) for n in sizes for k in range(1, n)], "size", *W, "a")
    # A part's size tells the cut: the first part of k words and the rest from k on.
    first = first.withColumn("k", sum(F.when(F.col(p) != 0, 1).otherwise(0) for p in keys))
    first = first.join(counts, keys).select(*W, "k", "a", "size", F.col("f").alias("l"))
    rest = _parts(candidates, [(n, k, n - k) for n in sizes for k in range(1, n)], *W)
    rest = rest.join(counts, keys).select(*W, F.col("from").alias("k"), F.col("f").alias("r"))
    score = F.expr(f"cast({SCALE} AS decimal(7,0)) * cast(a AS {long}) div (cast(l AS {long}) + cast(r AS {long}))")
    cuts = first.join(rest, [*W, "k"]).withColumn("score", score)
    best = cuts.groupBy("size", *W, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = [(n, at, k) for n in sizes for k in range(2, n) for at in range(n - k + 1)]
    longer = _parts(candidates, inner, "a").groupBy(*keys).agg(F.max("a").alias("longer"))
    longer = longer.select(*(F.col(p).alias(w) for p, w in zip(keys, W, strict=True)), "longer")
    share, of = INSIDE
    idle = of * F.col("longer").cast(long) >= share * F.col("a").cast(long)
    kept = best.join(longer, W, "left").where(~F.coalesce(idle, F.lit(False)))
    return kept.select("size", *W, "a", "cut.l", "cut.r", "cut.score")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: the first `top` phrases of each language.

    A-Z are lowered; texts are cut at `.,;:!?` and line ends into pieces, those at spaces and tabs into words. A null
    text has no words, a null language is `und`. `a` counts a phrase's occurrences within pieces, overlaps included, `n` all words
    of the language; a candidate has two to four words and occurs `least` times. Of its cuts in two the one with the lowest
    score floor(2000000 a / (l + r)) counts, then the first; `l` and `r` are the occurrences of the parts. A candidate
    inside a longer one that has 80 % of its occurrences is dropped. Order: score, then `a`, descending, then
    the phrase in byte order. Repeated rows count each; an empty table gives no rows; other columns are not read.

    Words are 64-bit hashes on the way; the vocabulary shows whether two share one, and then another seed is taken.
    """
    rows = df.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    for seed in range(SEEDS):
        words = cut(vocabulary(rows, seed))
        if words.groupBy("id").count().where("count > 1").isEmpty():
            break
    else:
        raise Collision("words share hashes under every seed")
    context = df.sparkSession.sparkContext
    common = words.where(F.col("c") >= least)
    known = context.broadcast(_filter(common, "id"))
    pairs = cut(pair_counts(rows, seed, known).where(F.col("c") >= least))
    linked = context.broadcast(_filter(pairs, "pair"))
    phrases = cut(frequencies(windows(rows, seed, known, linked), least))
    found = cut(scored(phrases).join(common.select(F.col("id").alias("w0"), "lang"), "w0"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = found.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place")
    spelled = near.select("*", F.posexplode(F.slice(F.array(*W), F.lit(1), F.col("size"))).alias("at", "id"))
    spelled = spelled.join(common.select("id", "word"), "id").groupBy("lang", "size", *W, "a", "l", "r", "score").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
