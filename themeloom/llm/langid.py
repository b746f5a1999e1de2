"""Language identification with hyperdimensional profiles.

A letter has a random vector of +1 and -1, drawn from its code point. Rotating it marks its place
in an n-gram, multiplying the rotated vectors binds the n-gram, and adding n-gram vectors bundles
a text. Prototypes bundle all training texts of a language; a text gets the language whose
prototype has the largest cosine with its own bundle.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.batches import map_texts, release, slices, texts_of
from themeloom.llm.hashing import mix

DIMENSIONS = 1024
GRAM = 3
SEED = 17
MAX_LANGUAGES = 4096  # prototypes are collected; 4,096 of 1,024 longs are 32 MB
UNDETERMINED = "und"
DENSE_GRAMS = 1 << 22
DENSE_COUNTS = 1 << 22  # texts x n-grams counted in one table
BLOCK = 2048
TOGETHER = 512  # pieces of texts bundled together at most
SHARE = 0.5  # of the cosine expected of a text in its language
SPREAD, SLACK = 1.5, 3.0  # spread of an n-gram's cosine as a multiple of the mean, and deviations granted
SEGMENT = 1 << 19  # symbols bundled together; what a task holds follows from it


@functools.lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Lower-case code point of every letter, 0 for everything else."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            low = letter.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def letter_vectors(symbols: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """A row of +1 and -1 for each symbol; it depends on the symbol and the seed alone."""
    words = -(-dimensions // 64)
    at = symbols.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
    bits = np.unpackbits(mix(mix(at + np.uint64(1)) ^ np.uint64(seed)).view(np.uint8).reshape(len(symbols), -1), axis=1)
    return bits[:, :dimensions].astype(np.int8) * np.int8(2) - np.int8(1)


def segments(texts: list[str | None]) -> tuple[list[int], list[np.ndarray]]:
    """(text, symbols) pieces of bounded length: letters, and 0 once for what stands between words."""
    table = symbol_table()
    owner, pieces = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        symbols = table[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        letter = symbols != 0
        if not letter.any():
            continue
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        symbols = np.concatenate([[0], symbols[keep]]).astype(np.uint32)
        if symbols[-1]:
            symbols = np.append(symbols, np.uint32(0))
        symbols = symbols[1:] if len(symbols) > 1 and symbols[1] == 0 else symbols
        for at in range(0, max(1, len(symbols) - GRAM + 1), SEGMENT):
            owner.append(i)
            pieces.append(symbols[at : at + SEGMENT + GRAM - 1])
    return owner, pieces


def gram_counts(owner: list[int], pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams (rows of symbols), and sorted by n-gram: its number, the owner, and how often the owner has it."""
    joined = np.concatenate(pieces)
    alphabet, small = np.unique(joined, return_inverse=True)
    size = len(alphabet)
    code = np.zeros(len(joined) - GRAM + 1, np.int64)
    for k in range(GRAM):
        code = code * size + small[k : len(code) + k]
    lengths = np.array([len(p) for p in pieces])
    within = np.ones(len(joined), bool)
    ends = np.cumsum(lengths)
    for k in range(1, GRAM):
        within[ends - k] = False
    within = within[: len(code)]
    code, who = code[within], np.repeat(np.array(owner), lengths)[: len(within)][within]
    if size**GRAM <= DENSE_GRAMS:
        present = np.zeros(size**GRAM, bool)
        present[code] = True
        grams = np.flatnonzero(present)
        place = np.empty(size**GRAM, np.int32)
        place[grams] = np.arange(len(grams), dtype=np.int32)
        code = place[code].astype(np.int64)
    else:
        grams, code = np.unique(code, return_inverse=True)
    owners = int(who.max()) + 1
    if owners * len(grams) <= DENSE_COUNTS:
        counted = np.bincount(code * owners + who, minlength=owners * len(grams))
        pair = np.flatnonzero(counted)
        count = counted[pair]
    else:  # many short texts: only the pairs that occur
        pair, count = np.unique(code * owners + who, return_counts=True)
    symbols = np.empty((len(grams), GRAM), np.int64)
    rest = grams
    for k in reversed(range(GRAM)):
        symbols[:, k] = rest % size
        rest = rest // size
    return alphabet[symbols], pair // owners, pair % owners, count


def bundles(owner: list[int], pieces: list[np.ndarray], n: int) -> np.ndarray:
    """The bundled vector of each of `n` owners; whole numbers, added exactly."""
    out = np.zeros((n, DIMENSIONS), np.float64)
    group, held = [], 0
    for i, piece in enumerate([*pieces, None]):
        if group and (piece is None or held + len(piece) > SEGMENT or len(group) == TOGETHER):
            _bundle([owner[j] for j in group], [pieces[j] for j in group], out)
            group, held = [], 0
        if piece is not None and len(piece) >= GRAM:
            group.append(i)
            held += len(piece)
    return out


def _bundle(owner: list[int], pieces: list[np.ndarray], out: np.ndarray) -> None:
    """Adds the bundles of a group of pieces to the rows of their owners."""
    who, local = np.unique(owner, return_inverse=True)
    grams, number, whose, count = gram_counts(local.tolist(), pieces)
    alphabet, place = np.unique(grams, return_inverse=True)
    place = place.reshape(grams.shape)
    letters = letter_vectors(alphabet)
    turned = [np.roll(letters, GRAM - 1 - k, axis=1) for k in range(GRAM)]
    total = np.zeros((len(who), DIMENSIONS), np.float32)  # below 2**24 in a segment, hence exact
    ends = np.searchsorted(number, np.arange(0, len(grams) + BLOCK, BLOCK))
    for block, at in enumerate(range(0, len(grams), BLOCK)):
        rows = place[at : at + BLOCK]
        bound = turned[0][rows[:, 0]]
        for k in range(1, GRAM):
            bound = bound * turned[k][rows[:, k]]
        part = slice(ends[block], ends[block + 1])
        counts = np.zeros((len(who), len(rows)), np.float32)
        counts[whose[part], number[part] - at] = count[part]
        total += counts @ bound.astype(np.float32)
    out[who] += total


def gram_totals(owner: list[int], pieces: list[np.ndarray], n: int) -> np.ndarray:
    """Number of n-grams of each of `n` owners."""
    sizes = [max(0, len(p) - GRAM + 1) for p in pieces]
    return np.bincount(owner, weights=sizes, minlength=n).astype(np.int64)


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """`lang, prototype array<long>, grams long`: the bundle of all texts of each language, and of how many n-grams.

    Rows without text or language teach nothing. A task adds up the rows it reads and hands over
    one vector for each language, so the shuffle carries languages x dimensions numbers for each task,
    whatever the texts are. An empty table gives no prototypes.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    )

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in slices(batch, "text", SEGMENT):
                names, which = np.unique(np.array(piece.column("lang").to_pylist(), object), return_inverse=True)
                owner, pieces = segments(texts_of(piece))
                if pieces:
                    owner = [int(which[i]) for i in owner]
                    found = bundles(owner, pieces, len(names)).astype(np.int64)
                    found = np.column_stack([found, gram_totals(owner, pieces, len(names))])
                    for name, row in zip(names, found, strict=True):
                        sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(row)), pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row)],
                names=["lang", "place", "value"],
            )
        release()

    cells = rows.mapInArrow(partial, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    sums = cells.groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("sums")
    )
    return sums.select("lang", F.slice("sums", 1, DIMENSIONS).alias("prototype"), F.element_at("sums", -1).alias("grams"))


def least_cosine(own: np.ndarray, grams: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The cosine below which texts are taken for none of a language's.

    An n-gram of the language has the cosine `own` with its prototype on average. A bundle of `grams` n-grams and
    `length` (its norm, in units of one n-gram) is then expected to have own * grams / length; copies count in its
    norm, so repetition promises no more. A text keeps its language down to `SHARE` of that, and further down to `SLACK`
    deviations: the spread of n-grams about their mean, and the noise of a cosine. For short texts that asks for nothing.
    """
    expected = own * grams / np.where(length == 0, 1, length)
    spread = np.sqrt((SPREAD * own) ** 2 + 1 / DIMENSIONS)
    return np.minimum(SHARE * expected, expected - SLACK * spread)


def predict(
    df: DataFrame, prototypes: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", floor: bool = False
) -> DataFrame:
    """`keep` columns, `lang_pred`, `score` (the cosine, at least 0) and `margin` over the next language.

    With `floor` also `least`, the `least_cosine` of that language.

    A null text, or one without a letter, is `und` with score 0, and so is every text if nothing was
    learned. Equal cosines go to the first language by code point. Whole texts are read, long ones in
    segments. Prototypes are collected: their number is checked against `MAX_LANGUAGES`.
    """
    learned = prototypes.limit(MAX_LANGUAGES + 1).collect()
    if len(learned) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    learned.sort(key=lambda r: r["lang"].encode())
    names = [r["lang"] for r in learned]
    matrix = np.array([r["prototype"] for r in learned], np.float64).reshape(len(names), DIMENSIONS)
    if len(names):
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(norm == 0, 1, norm)
    carried = text in keep  # then the text goes to the task once
    rows = df.select(*keep) if carried else df.select(*keep, F.col(text).alias("_text"))
    column = text if carried else "_text"
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    own = np.zeros(len(names))
    if floor and len(names):
        totals = np.array([r["grams"] for r in learned], np.float64)
        own = norm[:, 0] / np.where(totals == 0, 1, totals) / np.sqrt(DIMENSIONS)
    model = df.sparkSession.sparkContext.broadcast((names, matrix, own))

    def work(batch):
        names, matrix, own = model.value
        least = np.zeros(batch.num_rows)
        owner, pieces = segments(texts_of(batch, column))
        pred, score, margin = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        if pieces and names:
            vectors = bundles(owner, pieces, batch.num_rows)
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            cosine = np.round(vectors @ matrix.T / np.where(norm == 0, 1, norm), 9)
            best = cosine.argmax(axis=1)
            top = np.sort(cosine, axis=1)
            if floor:
                least = least_cosine(own[best], gram_totals(owner, pieces, batch.num_rows), norm[:, 0] / np.sqrt(DIMENSIONS))
            for i in set(owner):
                pred[i] = names[best[i]]
                score[i] = min(1.0, max(0.0, top[i, -1]))
                margin[i] = top[i, -1] - top[i, -2] if len(names) > 1 else score[i]
        found = [pa.array(pred), pa.array(score), pa.array(margin), pa.array(least)]
        columns = [*(batch.column(c) for c in keep), *found[: 4 if floor else 3]]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "margin", "least"][: len(columns)])

    schema = f"{kinds}, lang_pred string, score double, margin double" + (", least double" if floor else "")
    return map_texts(rows, schema, work, column, SEGMENT)


def held_out(key: str = "doc_id"):
    """True for the third of the documents that training must not see; a null key counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 3 == 1
