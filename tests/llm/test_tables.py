"""Operators over whole tables against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from themeloom.llm import mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, fingerprint string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(nodes, linked):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_near_duplicates_equal_brute_force(spark):
    random.seed(9)
    vocabulary = ["W%d" % i for i in range(50)] + ["É", "ß x"]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "one two"), (None, "one two"), (7, "one two three four")]
    for group in range(30):
        words = random.choices(vocabulary, k=random.choice([4, 30, 400]))
        for copy in range(6):
            text = list(words)
            if copy > 2:
                text[random.randrange(len(text))] = random.choice(vocabulary)
            rows.append((group * 10 + copy, random.choice([" ", "\n", "  "]).join(text)))
    rows += [rows[-1], rows[-1]]
    df = spark.createDataFrame([(*r, "l", "s", 1, "clash", "clash") for r in rows], SCHEMA)
    marks = {r: brute_fingerprint(r[1]) for r in rows}
    classes = components(set(marks.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (key, _), mark in marks.items():
        if key is not None:
            least[classes[mark]] = min(key, least.get(classes[mark], key))
    want = sorted((str(r[0]), f"{marks[r]:016x}", least[classes[marks[r]]]) for r in rows)
    got = simhash.near_duplicates(df)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got.collect()) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_lose_none_at_any_level(spark, monkeypatch):
    monkeypatch.setattr(simhash, "INDEX_ROWS", 3)
    random.seed(10)
    marks = set()
    for _ in range(12):
        center = random.getrandbits(64)
        for _ in range(25):
            marks.add(center ^ sum(1 << random.randrange(64) for _ in range(random.randrange(4))) & (1 << 64) - 1)
    marks |= {0, (1 << 64) - 1, 7, 15}
    df = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "fingerprint long")
    found = defaultdict(set)
    for r in simhash.links(df).distinct().collect():
        a, b = r["src"] % (1 << 64), r["dst"] % (1 << 64)
        assert (a ^ b).bit_count() > 0
        found[a].add(b), found[b].add(a)
    joined = lambda a, b: (a ^ b).bit_count() <= 3
    want = components(marks, joined)
    assert components(marks, lambda a, b: b in found[a]) == want and len(set(want.values())) < len(marks)


def test_index_finds_the_pairs_of_brute_force():
    random.seed(11)
    values = np.array(sorted({random.getrandbits(64) & 0xFFF0000000000FFF for _ in range(600)}), np.uint64)
    values = values[np.argsort(simhash.gray_rank(values))]
    starts = np.array([0, 150, 151, 400])
    i, j = simhash.GrayForest(values, starts).pairs(0, len(values), 3)
    group = np.searchsorted(starts, np.arange(len(values)), side="right")
    differ = np.bitwise_count(values[:, None] ^ values)
    want = {(a, b) for a, b in zip(*np.nonzero(differ <= 3), strict=True) if a < b and group[a] == group[b]}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want


def brute_targets(sizes, share=1.5, epochs=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left = share * sum(sizes.values()) - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > epochs * sizes[s]}
        if not above:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: epochs * sizes[s] for s in above}
        open_ -= above
    return target


def test_mixing_meets_the_targets(spark):
    random.seed(12)
    rows = [(i, " ".join(["w"] * random.choice([0, 1, 5, 60, 900])), random.choice("aAbé\U0001f600zq" + "h" * 9)) for i in range(600)]
    rows += [(None, "x y", None), (5, None, "a"), (5, "  ", None), (6, "a\tb\x1cc", None), rows[3], rows[3], (9999, "", "only empty")]
    df = spark.createDataFrame([(k, t, "l", s, 1, "clash", "clash") for k, t, s in rows], SCHEMA)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += count(text)
    target = brute_targets(sizes)
    got = mixing.mix(df).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(k), count(t)) for k, t, _ in rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(df.limit(0)).count() == 0

    kept = mixing.repeated(mixing.assign(df.withColumn("size", mixing.word_count("text"))))
    words = defaultdict(int)
    for r in kept.select("source", mixing.word_count("text").alias("n")).collect():
        words[r["source"]] += r["n"]
    assert {s: n for s, n in taken.items() if n} == {s: n for s, n in words.items() if n}
