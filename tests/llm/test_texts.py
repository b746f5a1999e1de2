"""Operators on single texts against plain Python: tokens, repetition, secrets, languages, licenses."""

import hashlib
import math
import random
import re
import struct
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from themeloom.llm import byte_bpe, langid, repetition, secrets
from themeloom.llm.batches import slices, texts_of
from themeloom.llm.hashing import BASES, BLOCK, Prefix, hashes_in_turn

SCHEMA = "doc_id long, text string, lang string, score string, size string"
AWKWARD = [
    None, "", " ", "\n\n", "a", "it's we'll they've 'tis 'S ''s don 't", "x  \n  y \t", "  lead", "tail   ",
    "\U0001f600 naïve Straße ²³ 一二三 \x1c\x85", "ab " * 300, "a" * 5000, "12345 6789, (ok)!! ...", "Ünï'll 're're r'e",
]


def make(spark, texts):
    rows = [(i, t, None, "clash", "clash") for i, t in enumerate(texts)]
    rows += [(None, "no key", None, "clash", None), (0, texts[0], None, None, None), (0, texts[0], None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def ranks():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_tokens_equal_tiktoken_and_decode(spark, ranks):
    random.seed(4)
    signs = list("aestmdrvlQ''  \n\t1²é字-!. 　") + ["'ll", "'re", "'ve"]
    texts = AWKWARD + ["".join(random.choice(signs) for _ in range(random.randrange(50))) for _ in range(400)]
    df, rows = make(spark, texts)
    vocabulary = byte_bpe.Vocabulary(open(ranks, "rb").read())
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    encoded = byte_bpe.encode(df, ranks).cache()
    assert encoded.columns == ["doc_id", "ids", "offsets"] and encoded.count() == len(rows)
    want = sorted((str(r[0]), oracle.encode_ordinary(r[1] or "")) for r in rows)
    assert sorted((str(r["doc_id"]), byte_bpe.unpack(bytes(r["ids"]))) for r in encoded.collect()) == want
    back = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(encoded, ranks).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))
    for r in encoded.collect():
        lengths = [len(oracle.decode_single_token_bytes(t)) for t in byte_bpe.unpack(bytes(r["ids"]))]
        assert byte_bpe.unpack(bytes(r["offsets"])) == [sum(lengths[:i]) for i in range(len(lengths))]
    assert byte_bpe.encode(df.limit(0), ranks).count() == 0


def test_hashes_of_ranges_in_turn_hold_a_block():
    random.seed(6)
    raw = random.randbytes(1 << 20)
    cuts = np.unique(np.array([0, *(random.randrange(len(raw)) for _ in range(5000)), len(raw)]))
    cuts = cuts[(cuts <= 200_000) | (cuts >= 200_000 + 3 * BLOCK)]  # one range is longer than a block
    starts, stops = cuts[:-1][1::2], cuts[1:][1::2]  # with gaps
    for base in BASES:
        whole = Prefix(raw, base).ranges(starts, stops)
        assert np.array_equal(hashes_in_turn(raw, starts, stops, base), whole)
    assert len(hashes_in_turn(raw, starts[:0], stops[:0])) == 0

    ends = np.arange(8, len(raw) + 1, 8)
    hashes_in_turn(raw, ends - 8, ends)
    tracemalloc.start()
    hashes_in_turn(raw, ends - 8, ends)
    in_turn = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert in_turn < 4e6  # the result takes one; sums over all of it took 30


def test_long_texts_in_pieces(ranks):
    vocabulary = byte_bpe.Vocabulary(open(ranks, "rb").read())
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    random.seed(5)
    text = "".join(random.choice(list("ab'sl  \n\t1é.") + ["'re"]) for _ in range(6000)) + "z" * 3000 + " " * 500
    for limit in (5, 17, 1000):
        assert byte_bpe.unpack(vocabulary.encode_text(text, limit)) == oracle.encode_ordinary(text)


def brute_repetition(text):
    found, body = words(text), text or ""
    n = len(found)
    windows = [tuple(found[i : i + 3]) for i in range(n - 2)]
    twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in body.split("\n"):
        dup += line in seen
        if words(line):
            seen.add(line)
    failed = n < 50 or 100 * len(twice) > 50 * n
    total, kept = sum(map(len, found)), not failed
    for size in range(2, 11):
        grams = [tuple(found[i : i + size]) for i in range(n - size + 1)]
        if size <= 4:
            held = max([sum(map(len, g)) * grams.count(g) for g in grams if grams.count(g) > 1], default=0)
            kept &= held <= repetition.TOP_LIMITS[size] * total
        else:
            inside = {i + k for i, g in enumerate(grams) if grams.index(g) < i for k in range(size)}
            kept &= sum(len(found[i]) for i in inside) <= repetition.LATER_LIMITS[size] * total
    seen, later = set(), 0
    for line in body.split("\n"):
        later += sum(map(len, words(line))) if line in seen else 0
        seen.add(line)
    kept &= later <= repetition.LINE_LIMIT * max(total, 1)
    return n, total, sum(c in "#*$%&|<>" for c in body), dup, len(twice), failed, bool(kept)


def test_repetition_equals_brute_force(spark):
    random.seed(6)
    texts = AWKWARD + [
        "".join(random.choice(["aa ", "b ", "cç ", "d\n", "e#\n", "f g "]) for _ in range(random.randrange(160))) for _ in range(40)
    ]
    texts += [" ".join(random.choice(["w%d" % k for k in range(size)]) for _ in range(120)) for size in (10, 25, 60, 400) for _ in range(4)]
    df, rows = make(spark, texts)
    got = repetition.repetition(df).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted((str(r["doc_id"]), *(r[f] for f in fields)) for r in got) == sorted((str(r[0]), *brute_repetition(r[1])) for r in rows)
    assert {r["kept"] for r in got} == {True, False}
    assert repetition.repetition(df.limit(0)).count() == 0


def brute_entropy(candidate):
    best = 0.0
    for i in range(len(candidate) - secrets.WINDOW + 1):
        window = candidate[i : i + secrets.WINDOW]
        best = max(best, -sum(window.count(c) / len(window) * math.log2(window.count(c) / len(window)) for c in set(window)))
    return best


def brute_spans(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    more = []
    for m in re.finditer(secrets.CANDIDATE, text):
        bits = next((b for p, b in secrets.CLASSES if re.search(p, m[0])), None)
        if bits is None or any(re.search(p, m[0]) for p in secrets.ALLOWED) or any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        if brute_entropy(m[0]) >= bits - 1e-9:
            more.append((m.start(), 3, m.end()))
    spell = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return hashlib.sha256(spell(base).encode()).hexdigest(), spell(base + more)


def test_secrets_equal_brute_force(spark):
    random.seed(7)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    token = lambda n, of=alnum: "".join(random.choice(of) for _ in range(n))
    texts = AWKWARD + [
        'é\U0001f600 TOKEN = "%s" x' % token(40), "secret:token:%s" % token(12), "password=short api-key:x apikey='%s'" % token(14),
        "AKIA" + token(16, "ABC123") + " AKIA123 AKIAAKIA" + token(9, "XYZ9"), token(15, "0123456789abcdef") + " " + token(40, "0123456789abcdef"),
        token(40, "0123456789ABCDEF"), "123e4567-e89b-12d3-a456-426614174000", "chpfheitschverheitenundsoweiter", "path/to/some/file/with0/Name.txt",
        "eyJ" + token(300), "example" + token(40), "a1" * 30, token(19), token(20), "token==" + token(12) + "\n" + token(64),
    ] + [" ".join(random.choice(["secret", ":", "=", '"', token(random.randrange(5, 50)), "é", "token="]) for _ in range(30)) for _ in range(60)]
    df, rows = make(spark, texts)
    got = secrets.scan(df)
    want = sorted((str(r[0]), *brute_spans(r[1])) for r in rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"], r["spans"]) for r in got.collect()) == want
    assert sum("entropy" in w[2] for w in want) > 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    for i, text in enumerate(texts):
        _, spans = brute_spans(text)
        out, at = "", 0
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
            if a >= at:
                out += text[at:a] + secrets.MARKER
            at = max(at, b)
        assert clean[i] == (None if text is None else out + text[at:])
    assert secrets.scan(df.limit(0)).count() == 0


def test_languages_held_out(spark):
    random.seed(8)
    syllables = {"aa": "the and ing tion er".split(), "bb": "der sch ung ein ü".split(), "cc": "que ment aux é le".split()}
    text = lambda lang: " ".join("".join(random.choices(syllables[lang], k=3)) for _ in range(40))
    rows = [(i, text(lang := random.choice(list(syllables))), lang, "clash", "clash") for i in range(300)]
    rows += [(1000, None, "aa", None, None), (1001, "12 34 ...", "bb", None, None), (1002, "", None, None, None), (None, text("cc"), None, None, None)]
    rows += [(1003, "a", None, None, None), (1004, ("the anding " * 120_000), None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    prototypes = langid.train(df.where(~langid.held_out()))
    got = {r["doc_id"]: r for r in langid.predict(df, prototypes).collect()}
    assert len(got) == len(rows)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1004)] == ["und"] * 3 + ["aa"] and got[1000]["score"] == 0
    held = [r["doc_id"] for r in df.where(langid.held_out()).where("lang IS NOT NULL AND doc_id < 1000").collect()]
    assert len(held) > 50 and all(got[i]["lang_pred"] == rows[i][2] and 0 <= got[i]["score"] <= 1 for i in held)
    none = langid.predict(df, langid.train(df.limit(0))).collect()
    assert len(none) == len(rows) and {r["lang_pred"] for r in none} == {"und"}
    assert langid.predict(df.limit(0), prototypes).count() == 0


def test_many_short_texts_take_bounded_memory():
    """100,000 texts of ten letters: no table of all texts by all n-grams, and pieces of bounded rows."""
    random.seed(8)
    texts = ["".join(random.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(10)) for _ in range(100_000)]
    pieces = list(slices(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), "text", langid.SEGMENT))
    assert sum(p.num_rows for p in pieces) == len(texts) and max(p.num_rows for p in pieces) <= 4096
    tracemalloc.start()
    owner, symbols = langid.segments(texts_of(pieces[0]))
    first = langid.bundles(owner, symbols, pieces[0].num_rows)
    owner, symbols = langid.segments(texts)
    whole = langid.bundles([0] * len(owner), symbols, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6 and (first[:3] == langid.bundles(*langid.segments(texts[:3]), 3)).all()
    assert np.abs(whole).sum() > 0


def test_bundle_is_the_sum_of_bound_vectors():
    owner, pieces = langid.segments(["Ab, ab!", "xyz"])
    got = langid.bundles(owner, pieces, 2)
    vectors = {c: langid.letter_vectors(langid.np.array([ord(c) if c != " " else 0]))[0].astype(int) for c in "ab xyz"}
    for row, text in zip(got, [" ab ab ", " xyz "], strict=True):
        want = sum(
            langid.np.roll(vectors[a], 2) * langid.np.roll(vectors[b], 1) * vectors[c] for a, b, c in zip(text, text[1:], text[2:], strict=False)
        )
        assert (row == want).all()


def test_predictions_follow_from_plain_vectors(spark):
    """Prototypes, cosines, winners and margins, n-gram by n-gram."""
    random.seed(12)
    letters = {"aa": "aeioutn", "bb": "krszwyk", "cc": "дежзийк"}
    texts = [("".join(random.choice(letters[lang] + "  .") for _ in range(random.randrange(1, 90))), lang) for lang in random.choices(list(letters), k=120)]
    texts += [("Zé ß1x", None), ("a", "aa"), ("12 !", "bb"), (None, "cc"), ("", None), ("ab" * 400, None)]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")

    def bundle(text):
        line = " " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " "
        total = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(line, line[1:], line[2:]):
            v = [langid.letter_vectors(np.array([0 if x == " " else ord(x)]))[0].astype(int) for x in (a, b, c)]
            total += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return total if line.strip() else None

    held = {r["doc_id"] for r in df.where(langid.held_out()).collect()}
    bundles = {i: bundle(t) for i, (t, _) in enumerate(texts)}
    prototypes = {
        lang: sum(b for i, b in bundles.items() if b is not None and texts[i][1] == lang and i not in held) for lang in letters
    }
    got = {r["doc_id"]: r for r in langid.predict(df, langid.train(df.where(~langid.held_out()))).collect()}
    for i, b in bundles.items():
        if b is None:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        norm = np.linalg.norm(b)
        cosines = sorted(((round(float(b @ p / np.linalg.norm(p) / norm) if norm else 0.0, 9), -ord(lang[0]), lang) for lang, p in prototypes.items()), reverse=True)
        assert got[i]["lang_pred"] == cosines[0][2] and abs(got[i]["score"] - min(1, max(0, cosines[0][0]))) < 1e-8
        assert abs(got[i]["margin"] - (cosines[0][0] - cosines[1][0])) < 1e-8


def test_ids_are_packed_little_endian():
    assert byte_bpe.unpack(struct.pack("<2I", 1, 50255)) == [1, 50255]
