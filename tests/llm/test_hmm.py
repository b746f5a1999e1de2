"""The hidden Markov model against sums over all paths, plain counting and held-out texts."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.llm import hmm

SCHEMA = "doc_id long, text string, n string, key string, held_out string, score string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.fixture
def model():
    random = np.random.default_rng(2)
    model = hmm.Model.first(np.full(6, 1 / 6), 3)
    model.move = random.dirichlet(np.ones(3), 3)
    return model


def paths(sequence, model, start):
    """(path, probability) of all sequences of states."""
    for path in itertools.product(range(3), repeat=len(sequence)):
        p = start[path[0]] * model.emit[sequence[0], path[0]]
        for a, b, symbol in zip(path, path[1:], sequence[1:]):
            p *= model.move[a, b] * model.emit[symbol, b]
        yield path, p


SEQUENCES = [[0, 1, 2, 3, 4], [5], [2, 2, 2], [1, 0, 1, 0, 1, 5, 3], [4, 4]]


def test_likelihood_is_the_sum_over_all_paths(model):
    symbols, size = np.concatenate(SEQUENCES), np.array([len(s) for s in SEQUENCES])
    want = [math.log10(sum(p for _, p in paths(s, model, model.start[0]))) for s in SEQUENCES]
    assert np.allclose(hmm.log10_likelihoods(symbols, size, model), want)
    assert len(hmm.log10_likelihoods(symbols[:0], size[:0], model)) == 0
    long = np.tile(symbols, 2000)
    assert np.isfinite(hmm.log10_likelihoods(long, np.array([len(long)]), model)).all()


@pytest.mark.parametrize("piece", [3, 128])
def test_expected_counts_are_those_of_all_paths(model, piece):
    symbols, size = np.concatenate(SEQUENCES), np.array([len(s) for s in SEQUENCES])
    starts, moves, emits, total = np.zeros((2, 3)), np.zeros((3, 3)), np.zeros((6, 3)), 0.0
    for s in SEQUENCES:
        for at in range(0, len(s), piece):
            part, kind = s[at : at + piece], int(at > 0)
            found = list(paths(part, model, model.start[kind]))
            whole = sum(p for _, p in found)
            total += math.log10(whole)
            for path, p in found:
                starts[kind, path[0]] += p / whole
                for a, b in zip(path, path[1:]):
                    moves[a, b] += p / whole
                for state, symbol in zip(path, part):
                    emits[symbol, state] += p / whole
    got, likelihood = hmm.expected_counts(symbols, size, model, piece)
    assert np.allclose(got.start, starts, atol=1e-4) and np.allclose(got.move, moves, atol=1e-4) and np.allclose(got.emit, emits, atol=1e-4)
    assert abs(likelihood - total) < 1e-4


@pytest.fixture(scope="module")
def rows():
    """Two kinds of texts with words of their own, one of them a hot third, among odd rows."""
    random.seed(3)
    kinds = [["der", "Hund", "und", "die", "Katze"], ["the", "dog", "and", "a", "cat"]]
    texts = [" ".join(random.choice(kinds[i % 2]) for _ in range(random.randrange(1, 60))) for i in range(300)]
    texts += ["the dog"] * 100 + [None, "", " \n", "unseen wörds hier", "x" * 5000, "a\x1fb \x85", " ".join(f"w{i % 37}" for i in range(3000))]
    return [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2


def scored(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", "clash", None, "0") for r in rows], SCHEMA)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    return hmm.score(df, held_out, **more)


def base(rows):
    held = [zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for (_, t), h in zip(rows, held) if not h for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    chance = lambda w: math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1)))
    return sorted(
        (str(i), h, len(ws), sum(w in counts for w in ws), n, round(sum(map(chance, ws)), 6)) for (i, t), h in zip(rows, held) for ws in [[*words(t), None]]
    )


@pytest.mark.parametrize("own, sent", [(1 << 13, 1 << 20), (20, 40), (1, 1)])
def test_base_by_plain_counting_and_states_that_help(spark, rows, monkeypatch, own, sent):
    """With few words sent to tasks the others are joined, and the numbers stay."""
    monkeypatch.setattr(hmm, "OWN", own)
    monkeypatch.setattr(hmm, "SENT", sent)
    found = scored(spark, rows, rounds=4).collect()
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert sorted((str(r[0]), *(r[c] for c in names[1:]), round(r["base_score"], 6)) for r in found) == base(rows)
    assert all(math.isfinite(r["score"]) for r in found)
    if own > 10:
        held = [r for r in found if r["held_out"] and r["n_tokens"] > 10]
        assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)  # both negative


def test_a_score_is_the_probability_of_the_text(spark):
    """One state, every word a symbol: the scores of words and unknown words by ending."""
    rows = [(i, "b b a") for i in range(40)] + [(100, "b zz"), (101, "a")]
    found = {r["doc_id"]: r for r in scored(spark, rows, states=1, rounds=30).collect()}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i, t in rows if i in train for w in [*t.split(), None])
    known, n = "zz" in counts, sum(counts.values())
    for i, t in rows:
        if i < 100 or known:
            assert abs(found[i]["score"] - found[i]["base_score"]) < 0.05 * len(t.split())
    assert found[0]["train_tokens"] == n


def test_rounds_raise_the_likelihood_and_reruns_agree(spark, rows):
    df = spark.createDataFrame([(i, t) for i, t in rows], "key long, text string").withColumn("held_out", F.lit(False))
    lex = hmm.lexicon(hmm.vocabulary(df).cache(), len(rows), 0)
    assert abs(lex.plain.sum() - 1) < 1e-12
    encoded = hmm.encode(df, lex).cache()
    model, found = hmm.baum_welch(encoded, lex.plain, 4, 6)
    assert all(b > a for a, b in zip(found, found[1:]))
    again, same = hmm.baum_welch(encoded.repartition(3), lex.plain, 4, 6)
    assert np.allclose(found, same) and np.allclose(model.emit, again.emit, atol=1e-6)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)


def test_nothing_to_learn_from(spark, rows):
    assert scored(spark, []).collect() == []
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found = sorted(map(tuple, hmm.score(df, F.lit(True)).collect()))
    assert found == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
