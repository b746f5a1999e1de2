"""Repetition rules: how much of a text stands inside repeated n-grams and lines."""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.batches import SPACES, map_texts, texts_of
from themeloom.llm.hashing import mix

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50  # of the words, in windows of three found twice
WINDOW = 3
# The largest share of characters that the most frequent n-gram may hold, and that
# all later copies of n-grams and of lines may hold.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
LATER_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30
FACTOR = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = (
    "_key {key}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, top_share double, later_share double, line_share double, broken array<string>"
)


def _occurrences(rolling: np.ndarray, ids: np.ndarray, inside: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows at `inside` where the first equal one is, and how many are equal.

    Windows are sorted by rolling hash; those that share one are compared word by word with
    the first, and should one differ, the words themselves are sorted instead.
    """
    _, first, which, count = np.unique(rolling[inside], return_index=True, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[which] > 1)
    here, head = inside[again], inside[first[which[again]]]
    if any((ids[here + k] != ids[head + k]).any() for k in range(width)):
        exact = np.lib.stride_tricks.sliding_window_view(ids, width)[inside]
        _, first, which, count = np.unique(exact, axis=0, return_index=True, return_inverse=True, return_counts=True)
        which = which.ravel()
    return inside[first[which]], count[which]


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of `n` words lie in a window of `width` that begins at one of `starts`."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(texts: list[str | None]) -> list[tuple]:
    """The columns after the key, for each text.

    The words of all texts lie in one array, each text with word numbers of its own, so that
    a window of one text never equals a window of another and one sort serves all.
    """
    number: defaultdict = defaultdict(itertools.count().__next__)
    ids, chars, sizes, symbols, dup_lines, line_chars = [], [], [], [], [], []
    for text in texts:
        raw = (text or "").encode()
        number.clear()
        number.default_factory = itertools.count(len(chars)).__next__
        words = raw.split()
        ids += map(number.__getitem__, words)
        chars += [len(w.decode()) for w in number]  # dicts keep the order of numbering
        sizes.append(len(words))
        symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
        seen: set[bytes] = set()
        lines = repeated = 0
        for line in raw.split(b"\n"):
            if line in seen:
                lines += 1
                repeated += len(b"".join(line.split()).decode())
            elif line.strip(SPACES):
                seen.add(line)
        dup_lines.append(lines)
        line_chars.append(repeated)
    ids = np.array(ids, np.int64)
    size = np.array(sizes, np.int64)
    length = np.array(chars, np.int64)[ids] if len(ids) else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    ends = np.cumsum(size)
    rest = ends[doc] - np.arange(len(ids))  # words from here to the end of the text
    per_text = lambda mask: np.bincount(doc[mask], minlength=len(texts))
    weight = lambda mask: np.bincount(doc[mask], weights=length[mask], minlength=len(texts)).astype(np.int64)
    total = weight(slice(None))
    share = lambda x: x / np.maximum(total, 1)

    values = mix(ids.astype(np.uint64) + np.uint64(1))
    before = np.append(0, np.cumsum(length))
    rolling = values
    repeat_words = np.zeros(len(texts), np.int64)
    top = np.zeros(len(texts))
    later = np.zeros(len(texts))
    broken: list[list[str]] = [[] for _ in texts]
    for n in range(2, max(LATER_LIMITS) + 1):
        if len(rolling) < 2:
            break
        rolling = rolling[:-1] * FACTOR + values[n - 1 :]
        inside = np.flatnonzero(rest[: len(rolling)] >= n)
        first, count = _occurrences(rolling, ids, inside, n)
        if n == WINDOW:
            repeat_words = per_text(_covered(inside[count > 1], n, len(ids)))
        if n in TOP_LIMITS:
            held = np.where(count > 1, count * (before[inside + n] - before[inside]), 0)
            most = np.zeros(len(texts), np.int64)
            np.maximum.at(most, doc[inside], held)
            got, limit, name = share(most), TOP_LIMITS[n], f"top_{n}_gram"
            top = np.maximum(top, got)
        elif n in LATER_LIMITS:
            got, limit, name = share(weight(_covered(inside[first != inside], n, len(ids)))), LATER_LIMITS[n], f"later_{n}_grams"
            later = np.maximum(later, got)
        else:
            continue
        for i in np.flatnonzero(got > limit).tolist():
            broken[i].append(name)
    line_share = share(np.array(line_chars))
    for i in np.flatnonzero(line_share > LINE_LIMIT).tolist():
        broken[i].append("later_lines")
    failed = (size < MIN_WORDS) | (100 * repeat_words > MAX_REPEATED_PERCENT * size)
    return [
        (
            sizes[i], int(total[i]), symbols[i], dup_lines[i], int(repeat_words[i]), bool(failed[i]), not (failed[i] or broken[i]),
            float(top[i]), float(later[i]), float(line_share[i]), broken[i],
        )
        for i in range(len(texts))
    ]


def repetition(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, base counts, shares of characters, the rules that are broken, and the verdict `kept`.

    Words are `[^\\x20\\x09-\\x0D]+`. `top_share` is the largest share of one repeated n-gram (2 to 4
    words), `later_share` that of all copies after the first of n-grams of 5 to 10 words, `line_share`
    that of lines equal to an earlier one. A text fails the base rule with fewer than 50 words, or
    with more than half of its words in three-word windows found twice; otherwise the limits above
    decide. A null or empty text has no words: every count is zero and it is not kept. Rows keep
    their multiplicity, a null key stays null, other columns are ignored. No shuffle.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    schema = SCHEMA.format(key=rows.schema["_key"].dataType.simpleString())
    names = [part.split()[0] for part in schema.split(", ")]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.list_(pa.string())]

    def work(batch):
        columns = zip(*measure(texts_of(batch)), strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column("_key"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names
        )

    return map_texts(rows, schema, work).withColumnRenamed("_key", key)
