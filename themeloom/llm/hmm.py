"""A hidden Markov language model.

Latent states follow one another along a text and each word is drawn from its state. A state does not hold a
probability for every word but for symbols: a word that makes up 1/8192 of the training tokens is a symbol of its own,
others share one with words of like endings, and within a symbol words keep their share by count. So a model is a table
of bounded size, and what grows with the corpus, the vocabulary, stays a Spark table that texts are joined to.

Baum-Welch trains the states: in each round tasks add up expected counts over all training texts, the sums give the
next model. The scaled forward recursion over a whole text gives its likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.batches import slices
from themeloom.llm.hashing import mix
from themeloom.llm.words import Collision, Words, classes, split
from themeloom.runtime import cut

GAPS = b" \t\n\x0b\x0c\r"
ADD = 0.1  # to the count of every word, and once for all unknown words
STATES = 8
ROUNDS = 8
PIECE = 128  # tokens that training follows the states through
OWN = 1 << 13  # a word with this share (1 / OWN) of the tokens is a symbol; there are at most OWN
SENT = 1 << 20  # counts of words with this share are sent to tasks, 16 MB at most; rarer ones are joined
ENDINGS = 1 << 11
PRIOR = 100.0  # tokens of the plain distribution added to each state
SEED = 5
SEEDS = 4
FIXED = 1 << 16  # expected counts travel as whole multiples of 1 / FIXED, so that sums do not depend on their order
CHUNK = 1 << 21  # bytes of text or symbols worked on together


@dataclass
class Model:
    start: np.ndarray  # (2, states): at the start of a text, and of a later piece of one
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)

    @staticmethod
    def first(plain: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
        """States that differ at random around the plain distribution of symbols."""
        random = np.random.default_rng(seed)
        emit = plain[:, None] * np.exp(random.normal(size=(len(plain), states)))
        move = random.random((states, states)) / states + np.eye(states)
        start = random.random((2, states)) + 1.0
        return Model(start / start.sum(axis=1, keepdims=True), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _by_time(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sequences by falling length, and for each step the places of those that reach it."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    reach = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    return order, [first[:m] + t for t, m in enumerate(reach)]


def log10_likelihoods(symbols: np.ndarray, size: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of each sequence; `symbols` holds them one after the other."""
    order, steps = _by_time(np.cumsum(size) - size, size)
    total = np.zeros(len(size))
    state = None
    for at in steps:
        here = model.emit[symbols[at]]
        state = model.start[0] * here if state is None else (state[: len(at)] @ model.move) * here
        scale = state.sum(axis=1)
        state /= scale[:, None]
        total[: len(at)] += np.log10(scale)
    out = np.empty(len(size))
    out[order] = total
    return out


def expected_counts(symbols: np.ndarray, size: np.ndarray, model: Model, piece: int = PIECE) -> tuple[Model, float]:
    """Expected counts of starts, moves and emissions (in the shape of a model), and the log10 likelihood.

    Each sequence is followed in pieces of `piece` tokens; later ones have a start of their own.
    """
    states = model.move.shape[0]
    begin = np.cumsum(size) - size
    parts = -(-size // piece)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    order, steps = _by_time(np.repeat(begin, parts) + nth * piece, np.minimum(piece, np.repeat(size, parts) - nth * piece))
    later = (nth > 0).astype(np.int64)[order]
    starts, moves = np.zeros((2, states)), np.zeros((states, states))
    if not steps:
        return Model(starts, moves, np.zeros_like(model.emit)), 0.0
    emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
    forward, scales, total = [], [], 0.0
    for t, at in enumerate(steps):
        state = emit[symbols[at]] * (model.start[later].astype(np.float32) if t == 0 else forward[-1][: len(at)] @ move)
        scale = state.sum(axis=1, keepdims=True)
        state /= scale
        total += float(np.log10(scale.astype(np.float64)).sum())
        forward.append(state)
        scales.append(scale)
    ahead = None
    for t in reversed(range(len(steps))):
        back = np.ones_like(forward[t])
        if ahead is not None:
            back[: len(ahead)] = ahead @ move.T
            moves += forward[t][: len(ahead)].T @ ahead
        here = forward[t] * back
        ahead = back * emit[symbols[steps[t]]] / scales[t]
        forward[t] = here
    for kind in (0, 1):
        starts[kind] = forward[0][later == kind].sum(axis=0, dtype=np.float64)
    seen = symbols[np.concatenate(steps)]
    shares = np.concatenate(forward)
    emits = np.column_stack([np.bincount(seen, weights=shares[:, s], minlength=len(emit)) for s in range(states)])
    return Model(starts, moves * model.move, emits), total


def maximised(counts: Model, plain: np.ndarray) -> Model:
    """The next model; a little of an even or the plain distribution is mixed in, so that nothing has probability 0."""
    start, move = counts.start + 1.0, counts.move + 1.0
    emit = counts.emit + PRIOR * plain[:, None]
    return Model(start / start.sum(axis=1, keepdims=True), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _endings(found: Words) -> np.ndarray:
    """A number below ENDINGS for each word, from its last three bytes."""
    tail = np.zeros(len(found.start), np.uint64)
    for k in (1, 2, 3):
        at = found.stop - k
        tail |= np.where(at >= found.start, found.codes[at], 0).astype(np.uint64) << np.uint64(8 * (k - 1))
    return (mix(tail + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.int64)


def vocabulary(rows: DataFrame, seed: int = 0) -> DataFrame:
    """`id, check, ending, c`: how often each word (two hashes) occurs in the column `text`."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", CHUNK):
                found = split(piece.column("text"), classes(GAPS), seed, check=True)
                ids, first, count = found.counted(found.hash, found.check)
                columns = [ids.view(np.int64), found.check[first].view(np.int64), _endings(found)[first].astype(np.int32), count.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "check", "ending", "c"])

    counted = rows.select("text").mapInArrow(run, "id long, check long, ending int, c long")
    return counted.groupBy("id", "check", "ending").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Counts of the frequent words, the symbols, and their plain distribution."""

    tokens: int
    words: int
    ends: int
    ids: np.ndarray  # ascending
    counts: np.ndarray
    symbol: np.ndarray  # of the words above; -1: by ending
    plain: np.ndarray  # symbol 0 is the end, then words, then endings
    seed: int

    @property
    def weight(self) -> float:
        return self.tokens + ADD * (self.words + 1)


def lexicon(words: DataFrame, texts: int, seed: int) -> Lexicon:
    """From the vocabulary of the training texts and their number. At most SENT words come to the driver."""
    total = words.agg(F.sum("c").alias("c"), F.count("*").alias("n")).first()
    tokens, kinds = (total["c"] or 0) + texts, total["n"] + (texts > 0)
    sent = words.where(F.col("c") * SENT >= tokens).select("id", "c").toArrow()
    ids, counts = sent.column("id").to_numpy().view(np.uint64), sent.column("c").to_numpy()
    order = np.argsort(ids)
    ids, counts = ids[order], counts[order]
    own = counts * OWN >= tokens
    symbol = np.where(own, np.cumsum(own), -1)
    weight = tokens + ADD * (kinds + 1)
    endings = np.full(ENDINGS, ADD / ENDINGS)  # unknown words are spread over the endings
    for row in words.where(F.col("c") * OWN < tokens).groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        endings[row["ending"]] += row["c"] + ADD * row["n"]
    plain = np.concatenate([[texts + ADD], counts[own] + ADD, endings]) / weight
    return Lexicon(tokens, kinds, texts, ids, counts, symbol, plain, seed)


ENCODED = "symbols binary, n_words long, known long, sure double, rare array<long>"


def encode(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds to each row of `n, key, held_out, text` its symbols (little-endian 16 bits, the end included), the number of its words,
    how many of its tokens are known for certain and their log10 probability, and the hashes of the words to be joined.
    """
    model = rows.sparkSession.sparkContext.broadcast(lexicon)
    names = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        lex = model.value
        logs = np.log10((lex.counts + ADD) / lex.weight)
        end = np.log10(((lex.ends if lex.tokens else 0) + ADD) / lex.weight)
        base = len(lex.plain) - ENDINGS
        for batch in batches:
            for piece in slices(batch, "text", CHUNK):
                n = piece.num_rows
                found = split(piece.column("text"), classes(GAPS), lex.seed)
                at = np.searchsorted(lex.ids, found.hash)
                known = np.zeros(len(at), bool)
                inside = at < len(lex.ids)
                known[inside] = lex.ids[at[inside]] == found.hash[inside]
                symbol = _endings(found) + base
                own = lex.symbol[at[known]]
                symbol[known] = np.where(own >= 0, own, symbol[known])
                size = np.bincount(found.text, minlength=n)
                stop = np.cumsum(size + 1)
                coded = np.zeros(stop[-1], "<i2")
                coded[np.arange(len(at)) + found.text] = symbol
                held = coded.tobytes()
                sure = np.bincount(found.text[known], weights=logs[at[known]], minlength=n) + end
                rare = found.hash[~known].view(np.int64)
                offsets = np.append(0, np.cumsum(np.bincount(found.text[~known], minlength=n))).astype(np.int32)
                columns = [
                    *(piece.column(c) for c in names),
                    pa.array([held[2 * (b - s - 1) : 2 * b] for b, s in zip(stop.tolist(), size.tolist(), strict=True)], pa.binary()),
                    pa.array(size.astype(np.int64)),
                    pa.array((np.bincount(found.text[known], minlength=n) + (lex.tokens > 0)).astype(np.int64)),
                    pa.array(sure.astype(np.float64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(rare)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "symbols", "n_words", "known", "sure", "rare"])

    return rows.mapInArrow(run, f"{kinds}, {ENCODED}")


def _symbols(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = piece.column("symbols").to_pylist()
    return np.frombuffer(b"".join(column), "<i2").astype(np.int64), np.array([len(c) // 2 for c in column], np.int64)


def baum_welch(encoded: DataFrame, plain: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model after `rounds` over all rows of `encoded`, and the log10 likelihood before each round.

    A task adds up the expected counts of its texts; Spark sums them. The driver sees one model a round.
    """
    model = Model.first(plain, states)
    likelihoods = []
    shapes = [model.start.shape, model.move.shape, model.emit.shape]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    rows = encoded.select("symbols")
    for _ in range(rounds):
        sent = encoded.sparkSession.sparkContext.broadcast(model)

        def run(batches, sent=sent):
            sums, total = np.zeros(ends[-1] + 1), 0.0
            for batch in batches:
                for piece in slices(batch, "symbols", CHUNK >> 1):
                    counts, likelihood = expected_counts(*_symbols(piece), sent.value)
                    sums[:-1] += np.concatenate([counts.start.ravel(), counts.move.ravel(), counts.emit.ravel()])
                    total += likelihood
            sums[-1] = total
            whole = np.rint(sums * FIXED).astype(np.int64)
            slots = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(whole[slots])], names=["slot", "value"])

        table = rows.mapInArrow(run, "slot int, value long").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
        sums = np.zeros(ends[-1] + 1)
        sums[table.column("slot").to_numpy()] = table.column("value").to_numpy() / FIXED
        parts = [p.reshape(s) for p, s in zip(np.split(sums[:-1], ends[:-1]), shapes, strict=True)]
        likelihoods.append(float(sums[-1]))
        model = maximised(Model(*parts), plain)
        sent.unpersist()
    return model, likelihoods


def likelihoods(encoded: DataFrame, model: Model, plain: np.ndarray) -> DataFrame:
    """The rows of `encoded` without symbols, with `gain`: log10 of how much likelier the model makes the symbols than the plain distribution."""
    sent = encoded.sparkSession.sparkContext.broadcast((model, np.log10(plain)))
    names = [c for c in encoded.columns if c not in ("symbols", "rare")]
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        model, logs = sent.value
        for batch in batches:
            for piece in slices(batch, "symbols", CHUNK):
                symbols, size = _symbols(piece)
                alone = np.bincount(np.repeat(np.arange(len(size)), size), weights=logs[symbols], minlength=len(size))
                gain = log10_likelihoods(symbols, size, model) - alone
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(gain)], names=[*names, "gain"])

    return encoded.select(*names, "symbols").mapInArrow(run, f"{kinds}, gain double")


def score(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """`key, held_out, n_tokens, n_known, train_tokens, base_score, score` of every row; training leaves out the rows where `held_out` holds.

    Tokens are the words, A-Z lowered and split at spaces, and one end, which is a token too; a null or empty text is an
    end alone. `base_score` is the log10 probability by counts of single tokens with 0.1 added. `score` is the log10
    probability of the whole text under the trained states; unknown words have the probability of one
    unknown word with their ending. Without anything to learn from both are 0. Repeated rows and null keys are scored
    each on their own; other columns, whatever their names, are not read. Words are told apart by 64-bit hashes, which
    the vocabulary checks by second ones. Training follows states for pieces of 128 tokens, scoring through whole texts.
    """
    rows = df.select(
        F.monotonically_increasing_id().alias("n"), F.col(key).alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col(text).cast("string").alias("text"),
    )
    learned = rows.where(~F.col("held_out"))
    texts = learned.count()
    for seed in range(SEEDS):
        words = cut(vocabulary(learned, seed))
        if words.groupBy("id").count().where("count > 1").isEmpty():
            break
    else:
        raise Collision("words share hashes under every seed")
    lex = lexicon(words, texts, seed)
    encoded = cut(encode(rows, lex))
    model, _ = baum_welch(encoded.where(~F.col("held_out")), lex.plain, states, rounds) if texts else (Model.first(lex.plain, states), [])
    rare = encoded.select("n", F.explode("rare").alias("id")).join(words.select("id", "c"), "id", "left")
    chance = F.log10((F.coalesce("c", F.lit(0)) + ADD) / lex.weight)
    joined = rare.groupBy("n").agg(F.sum(chance).alias("more"), F.count("c").alias("seen"), F.count("*").alias("all"))
    scored = likelihoods(encoded, model, lex.plain).join(joined, "n", "left").fillna(0, ["more", "seen", "all"])
    base = F.col("sure") + F.col("more")
    unknown = F.col("all") - F.col("seen")
    return scored.select(
        F.col("key").alias(key), "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + F.col("seen")).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (base + F.col("gain") - unknown * float(np.log10(ENDINGS)) if lex.tokens else base).alias("score"),
    )
