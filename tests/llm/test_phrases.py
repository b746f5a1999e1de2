"""Collocations against plain counting of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from themeloom.llm import phrases as P, words as W

SCHEMA = "doc_id long, text string, lang string, phrase string, w0 long, rank int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute(rows, least=P.LEAST, top=P.TOP):
    counts = {}
    for text, lang in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            ws = tuple(re.findall(r"[^\x20\x09]+", piece))
            own.update(ws[i : i + k] for k in range(1, 5) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        idle = {g[i : i + k] for g, a in candidates.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= 80 * f[g[i : i + k]]}
        n = sum(a for g, a in f.items() if len(g) == 1)
        found = []
        for g, a in candidates.items():
            if g not in idle:
                score, _, left, right = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), left, right))
        found.sort()
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


@pytest.fixture
def texts():
    random.seed(7)
    pool = ["The", "the", "of", "naïve", "Ünï", "x", "a\x1fb", "new", "york", "city", "stock", "exchange", "-", "\U0001f600"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "!? "]
    make = lambda n: "".join(random.choice(pool) + random.choice(marks) for _ in range(n))
    rows = [(make(random.randrange(80)), random.choice(["en", "de", None, "und", ""])) for _ in range(400)]
    rows += [("new york city hall is here. " * 40, "en"), ("rare words only here", "fr"), (None, "en"), ("", None), (" .,;", "en"), ("A A A A A A", "de"), ("en de en und", "de"), ("de en de und", "en")] * 3
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, lang, "clash", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA)
    found = P.collocations(df, **more)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, found.collect()))


def test_as_by_plain_counting(spark, texts, monkeypatch):
    want = brute(texts)
    assert {w[0] for w in want} >= {"en", "de", "und"} and run(spark, texts) == want
    assert run(spark, texts, least=2, top=5) == brute(texts, 2, 5)
    monkeypatch.setattr(P, "MOST_BITS", 1 << 10)  # crowded filters keep more windows and change nothing
    monkeypatch.setattr(P, "BITS_EACH", 1)
    assert run(spark, texts, least=2) == brute(texts, 2)


def test_empty_and_repeated_rows(spark, texts):
    assert run(spark, []) == [] and run(spark, [(None, None)]) == [] and run(spark, [("a b", "en")] * 29) == []
    rows = [("a b c", "en")] * 30
    assert run(spark, rows) == brute(rows) == [("en", 1, "a b c", 30, 30, 30, 90, 1000000)]


def test_large_counts_are_exact(spark):
    big = 1 << 55
    rows = [(1, 1, 0, 0, 0, 3 * big + 1), (1, 2, 0, 0, 0, 2 * big + 1), (2, 1, 2, 0, 0, 2 * big - 1)]
    df = spark.createDataFrame(rows, "size int, w0 long, w1 long, w2 long, w3 long, a long")
    (found,) = P.scored(df).collect()
    assert found["score"] == 2000000 * (2 * big - 1) // (5 * big + 2) and (found["l"], found["r"]) == (3 * big + 1, 2 * big + 1)


def test_words_of_a_batch(texts):
    column = pa.array([t for t, _ in texts])
    found = W.split(column[3:], W.classes(P.GAPS, P.BREAKS), check=True)
    want = [(i, w) for i, (t, _) in enumerate(texts[3:]) for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", lowered(t))]
    assert list(zip(found.text.tolist(), found.bytes_of(np.arange(len(found.start))).to_pylist())) == want
    assert len(set(found.hash.tolist())) == len(set(w for _, w in want))
    ids, first, count = found.counted(found.hash & np.uint64(3), found.check)  # forced collisions stay apart
    names = found.bytes_of(first).to_pylist()
    assert dict(zip(names, count.tolist())) == Counter(w for _, w in want) and len(ids) == len(names)
