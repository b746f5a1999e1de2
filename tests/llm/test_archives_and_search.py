"""Packages, suffix arrays, bit-sliced search and license alignment against brute force."""

import collections
import hashlib
import io
import itertools
import math
import random
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from themeloom.llm import bitsliced, licenses, suffix_dedup, warc_zip
from themeloom.runtime import cut

# --- packages


def test_packages_give_back_every_record(spark, tmp_path):
    random.seed(1)
    body = lambda n: "".join(random.choice("ab é\n<\U0001f600") for _ in range(n))
    big, limit, small = body(1500), "x" * 1000, "y" * 999
    rows = [(i, "http://a.b/%d?q=ä b\n" % i, body(random.randrange(3000))) for i in range(40)]
    rows += [(100, None, big), (105, "u", big), (103, "u", big), (200, "u", limit), (201, "u", limit), (300, "u", small), (301, "u", small)]
    rows += [(400, "u", None), (401, "u", ""), (None, "u", big), (None, None, "z" * 2000), (None, None, "z" * 2000), (500, "u", body(400_000))]
    rows += [(105, "u", big)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, payload string, size int")
    got = warc_zip.archive(df, str(tmp_path / "out")).collect()
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        keeper = max(same, default=None) if len(raw) >= 1000 else None
        revisit = keeper is not None and page != keeper
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(str, (tuple(r[f] for f in fields) for r in got))) == sorted(map(str, want))
    for path in (tmp_path / "out").iterdir():
        with zipfile.ZipFile(path) as pack:
            assert pack.testzip() is None and {i.compress_type for i in pack.infolist()} == {zipfile.ZIP_STORED}
    assert warc_zip.archive(df.limit(0), str(tmp_path / "none")).count() == 0


def test_directory_with_many_members_and_a_misleading_comment():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as pack:
        for i in range(66_000):  # more than the plain end record can count
            pack.writestr(f"m{i}", b"%d" % i)
        pack.writestr("packed", b"z" * 100, zipfile.ZIP_DEFLATED)
        pack.comment = b"PK\x05\x06 not the end"
    body = raw.getvalue()
    file = pa.BufferReader(body)
    found = warc_zip.members(file, len(body))
    assert len(found) == 66_000
    assert all(body[m.offset : m.offset + m.size] == m.name[1:].encode() for m in found[::997])


def test_wide_fields_of_a_member():
    data = b"hello records"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + b"a" + struct.pack("<HHQQ", 1, 16, 13, 13)
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
    entry += b"a" + extra
    at = len(local) + len(data)
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    body = local + data + entry + wide + locator + end
    (member,) = warc_zip.members(pa.BufferReader(body), len(body))
    assert body[member.offset : member.offset + member.size] == data
    with pytest.raises(ValueError):
        warc_zip.members(pa.BufferReader(b"nothing here" * 9), 108)


# --- suffix arrays


def test_suffix_array_sorts_all_suffixes():
    random.seed(2)
    for size, letters in itertools.product((0, 1, 2, 7, 60, 1200), (b"a", b"ab", b"a\0b", bytes(range(200)))):
        raw = bytearray(random.choice(letters) for _ in range(size))
        if size > 1000:
            raw[100:400] = raw[600:900]
            raw[-150:] = raw[:1] * 150
        raw = bytes(raw)
        got = suffix_dedup.suffix_array(suffix_dedup.closed(raw), 4 * size + 1)
        assert got.tolist() == [size, *sorted(range(size), key=lambda i: raw[i:])]


def brute_repeats(texts, length=suffix_dedup.LENGTH):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, _ in itertools.groupby(gone) if k)
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeating_texts():
    random.seed(3)
    noise = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    passages = [noise(n) for n in (300, 398, 399, 400, 401, 402, 700, 1500)]
    texts = [None, "", "short", "z" * 399, "z" * 400, "z" * 405, "ab" * 700, noise(50) * 30, noise(3000)]
    for _ in range(40):
        texts.append("".join(random.choice([noise(random.randrange(300)), random.choice(passages)]) for _ in range(4)))
    whole = passages[-1]
    texts += [whole[a : a + 600] + noise(100) + whole[b : b + 450] for a in (0, 100, 377) for b in (0, 333, 900)]
    texts += ["same text " * 5 + passages[2]] * 3
    for _ in range(6):
        copy = list(whole)
        copy[random.randrange(1500)] = "#"
        texts.append("".join(copy))
    return texts


@pytest.mark.parametrize("group_rows", [suffix_dedup.GROUP_ROWS, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, group_rows):
    """The smaller bound sends contested anchors through the longer ones, down to whole strings."""
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", group_rows)
    texts = repeating_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (3, "other text")]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, k1 int, first string")
    got = suffix_dedup.remove_repeats(df).collect()
    want = brute_repeats([t for _, t in rows])
    mine = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got]
    assert sorted(map(str, mine)) == sorted(str((k, *w)) for (k, _), w in zip(rows, want, strict=True))
    assert any(w[2] > 1 for w in want)
    if group_rows > 2:
        assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_rows_of_a_common_key_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 50)
    rows = [(7, 7, i) for i in range(4000)] + [(i, 1, i) for i in range(100)]
    table = cut(spark.createDataFrame(rows, "h long, c long, first int"))
    counted = table.groupBy("h", "c").agg(F.count(F.lit(1)).alias("rows")).where("h <> 99")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = suffix_dedup._joined(table, counted, ["h", "c"]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sorted((r["h"], r["c"], r["first"]) for r in found) == sorted(r for r in rows if r[0] != 99)
    tasks = collections.Counter(r["task"] for r in found)
    assert len(tasks) == 4 and max(tasks.values()) < 2000


def test_repeats_of_common_passages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 2)
    texts = repeating_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_anchor_ranges_cover_every_string_once():
    random.seed(4)
    raw = bytes(random.randrange(256) for _ in range(3000)) + b"q" * 900
    place, first, end, _, _ = suffix_dedup.anchored(raw)
    assert first[0] == 0 and end[-1] == len(raw) - suffix_dedup.LENGTH + 1 and (first[1:] == end[:-1]).all()
    assert (place >= end - 1).all() and (place + suffix_dedup.GRAM <= first + suffix_dedup.LENGTH).all()


# --- top-k


def test_top_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_COMPONENTS", 700)
    monkeypatch.setattr(bitsliced, "QUERY_ROWS", 3)
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(0, 0.1, 8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # a large group of copies, with ties
    rows += [(2000, None), (2020, [1.0, None] * 4), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (None, rows[0][1])]
    rows += [(3000, [0.5, -0.25]), (3001, [1.0, 1.0]), (3020, []), (3021, []), (4000, [0.0] * 8), (rows[20][0], rows[20][1])]
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], "vec_id long, embedding array<double>, label int, score string")
    got = bitsliced.search(bitsliced.build_index(df), df.where("vec_id % 20 = 0")).collect()
    usable = [(k, np.floor(64 * np.array(v)).astype(int)) for k, v in rows if k is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for key, query in {k: v for k, v in usable if k % 20 == 0}.items():
        scores = sorted((-int(query @ v), k) for k, v in usable if k != key and len(v) == len(query))[:20]
        want += [(key, rank, k, -s) for rank, (s, k) in enumerate(scores, 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert bitsliced.search(bitsliced.build_index(df.limit(0)), df).count() == 0
    assert bitsliced.search(bitsliced.build_index(df), df.limit(0)).count() == 0


def test_slices_add_up():
    rng = np.random.default_rng(6)
    stacks = [rng.integers(0, 2**63, (n, 3), dtype=np.uint64) for n in (1, 7, 0, 12)]
    bits = lambda x: np.unpackbits(x.view(np.uint8), bitorder="little").astype(int)
    want = sum(bits(row) << w for w, stack in enumerate(stacks) for row in stack)
    planes = bitsliced.add_slices(stacks)
    assert (sum(bits(p[0]) << w for w, p in enumerate(planes) if len(p)) == want).all()


# --- licenses


def subsequence(part, whole):
    rest = iter(whole)
    return all(any(x == y for y in rest) for x in part)


def test_notices_beside_each_other_are_found_each():
    """Two notices in either order, next to each other or apart, each at its own words."""
    short = {"mit": "Released under the MIT License.", "cc-by-4.0": "Licensed under CC BY 4.0.", "apache-2.0": licenses.TEMPLATES["apache-2.0"][1], "isc": licenses.TEMPLATES["isc"][0]}
    for one, two in itertools.permutations(short, 2):
        for gap in ("", " and so on ", " word" * 120 + " "):
            found = {f[0]: f for f in licenses.find(f"so {short[one]} {gap}{short[two]} end")}
            assert set(found) == {one, two}, (one, two, gap)
            first, second = len(licenses.tokens(short[one])), len(licenses.tokens(short[two]))
            assert found[one][3:] == (1, 1 + first)
            start = 1 + first + len(licenses.tokens(gap))
            assert found[two][3:] == (start, start + second)
    assert licenses.find("it is Licensed under the MIT license")[0][0] == "mit"


def test_alignment_parts_against_brute_force():
    random.seed(7)
    for _ in range(200):
        values = random.sample(range(30), random.randrange(9))
        best = max((len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n) if list(c) == sorted(c)), default=0)
        picked = [values[i] for i in licenses.longest_rising(values)]
        assert len(picked) == best and picked == sorted(picked)
        a, b = (random.choices("abcdef", k=random.randrange(9)) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        places = licenses.common_places(a, b)
        assert len(places) == table[-1][-1] and subsequence([a[i] for i in places], b)
        at = licenses.aligned(a, b)
        assert at == sorted(set(at)) and subsequence([a[i] for i in at], b) and licenses.aligned(a, a) == list(range(len(a)))


def test_planted_licenses_are_found(spark):
    random.seed(8)
    noise = lambda n: " ".join(random.choice(["thaner", "onre", "the", "of", "license", "stated", "version"]) for _ in range(n))
    rows, want = [(0, None), (1, ""), (2, noise(4000)), (3, "a license under the sun"), (None, "x Released under the MIT License.")], {}
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            words = text.split()
            if len(words) > 20:  # changed, dropped and added words
                words[7], words[15] = "altered", "words here"
            spoiled = " ".join(words).upper() if len(rows) % 2 else "\n".join(words)
            rows.append((len(rows) + 10, f"{noise(random.randrange(600))}\n{spoiled} {noise(50)} {spoiled} {noise(random.randrange(9))}"))
            want[rows[-1][0]] = name
    rows += [rows[-1], rows[-1]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, license string")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r["license"] for r in got}
    assert {k: found[k] for k in want} == want and [found[k] for k in (0, 1, 2, 3)] == [None] * 4 and found[None] == "mit"
    assert licenses.scan(df.limit(0)).count() == 0


def test_near_misses_of_notices_are_no_license():
    misses = (
        "Released under the Apache License", "Released under the BSD License.", "It was released under the license of the town",
        "Licensed under CC BY-ND 4.0.", "Licensed under CC BY 3.0.", "Licensed under the Apache License, Version 1.1.",
        "Released under the guidance of MIT staff, all on a license",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        licenses.TEMPLATES["gpl-3.0"][1].replace("version 3", "version 2"),
        licenses.TEMPLATES["mpl-2.0"][0].replace("2.0", "1.1"),
    )
    assert [licenses.find(f"so it is {text} as of now") for text in misses] == [[]] * len(misses)
    for name, texts in licenses.TEMPLATES.items():
        assert [[f[0] for f in licenses.find(f"so it is {text} as of now")] for text in texts] == [[name]] * len(texts)
    assert licenses.find("Released under the terms of the MIT License.")[0][:3] == ("mit", 1.0, 5)


def test_wide_components_are_exact(spark):
    """Components so wide that sums of slices pass 63 bits, though scores do not, against Python integers."""
    random.seed(9)
    for dims, top in ((64, 2.0**22), (16, 2.0**23), (3, 2.0**24 + 0.5)):
        rows = [(i, [random.choice([-1, 1]) * (top - random.randrange(1000)) for _ in range(dims)]) for i in range(60)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = bitsliced.search(bitsliced.build_index(df), df.where("vec_id % 20 = 0")).collect()
        whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
        want = []
        for i in (0, 20, 40):
            scores = sorted((-sum(a * b for a, b in zip(whole[i], v)), k) for k, v in whole.items() if k != i)[:20]
            want += [(i, rank, k, -s) for rank, (s, k) in enumerate(scores, 1)]
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    rows = [(0, [2.0**40] * 2), (1, [2.0**40] * 2), (2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds 64 bits"):
        bitsliced.search(bitsliced.build_index(df), df).collect()
