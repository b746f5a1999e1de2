"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp  # noqa: E402
from themeloom.llm import near_copies, simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts, least=0.8):
    """Positions of the first of each component; a pair is compared on its sets of word tuples."""
    sets = []
    for text in texts:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [i for i in range(len(texts)) if find(i) == i]


def test_near_copies_at_every_distance_go_and_others_stay(spark):
    draw = random.Random(7)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    texts = [None, "", " ", "one two", "One  two"]
    for size in (30, 100, 400):
        for changes in (1, 2, 3, 5, 9, 14):
            for _ in range(4):
                first = [word() for _ in range(size)]
                other = list(first)
                for at in draw.sample(range(size), changes):
                    other[at] = word()
                texts += [" ".join(first), " ".join(other)]
    chain = [word() for _ in range(100)]  # each is near the next alone
    for at in range(0, 60, 4):
        texts.append(" ".join(chain))
        chain[at : at + 4] = [word() for _ in range(4)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, "").collect())
    assert got == brute(texts)
    linked = [(texts[i], texts[i + 1]) for i in range(5, len(texts) - 16, 2) if i + 1 not in set(got)]
    far = [p for p in linked if (simhash.fingerprint(p[0]) ^ simhash.fingerprint(p[1])).bit_count() > 3]
    assert len(far) > 10  # what three bits would have left


def test_documents_of_the_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    want = [rows[i]["doc_id"] for i in brute([r["text"] for r in rows])]
    assert sorted(r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, "").collect()) == want


def test_bands_meet_at_the_least_similarity():
    draw = random.Random(3)
    met = 0
    for _ in range(300):
        common = [draw.getrandbits(64) for _ in range(80)]
        a, b = (near_copies.np.array(common + [draw.getrandbits(64) for _ in range(10)], "u8") for _ in range(2))
        met += bool(set(near_copies.bands(a).tolist()) & set(near_copies.bands(b).tolist()))
    assert met == 300


def test_many_texts_of_one_template(spark, monkeypatch):
    """600 texts share a template and differ each in its own way, below 0.8 of each other; a few are nearer. No bucket is paired off."""
    random.seed(21)
    template = [f"t{i}" for i in range(150)]

    def changed(n):
        words = list(template)
        for at in random.sample(range(150), n):
            words[at] = f"x{random.randrange(10**9)}"
        return " ".join(words)

    texts = [changed(random.randrange(4, 9)) for _ in range(600)]
    texts += [t.replace(" t149", " z") for t in texts[:20]] + [" ".join(template)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = []
    alike = near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda p, s, t: (pairs.append(p.count()), alike(p, s, t))[1])
    kept = {r["doc_id"] for r in near_copies.one_of_each(df).collect()}
    marks = [set(near_copies.shingles(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(marks[i] & marks[j])
            if 5 * common >= 4 * (len(marks[i]) + len(marks[j]) - common):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert kept == {find(i) for i in range(len(texts))} and len(kept) < 600
    assert sum(pairs) < 20 * len(texts)


def test_fingerprints_join_near_copies_before_any_band(spark):
    """Texts of many words with one changed differ in few bits; the pair counts once its sets are alike."""
    from themeloom.llm import near_copies as N

    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(reversed(words)), "w1 w2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    marks = N.sketches(df, ("id",), "text").select("id", "fingerprint").cache()
    prints = {r.id: r.fingerprint & (2**64 - 1) for r in marks.collect()}
    assert (prints[0] ^ prints[1]).bit_count() <= 3 < (prints[0] ^ prints[2]).bit_count()
    near = N.fingerprint_pairs(marks)
    assert [tuple(r) for r in near.collect()] == [(0, 1)]
    none = spark.createDataFrame([], "key long, id long")
    labels = N._labels(none, N._shingle_sets(df), near, 0.8)
    assert sorted(tuple(r) for r in labels.collect()) == [(0, 0), (1, 0), (2, 2), (3, 3)]
