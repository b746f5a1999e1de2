"""The pipeline's stages, each on what the one before kept, and its whole run."""

import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp  # noqa: E402
from themeloom.llm import byte_bpe, langid, mixing, secrets  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    random.seed(1)
    odd = [(9001, None, "en", "src1", 0), (9002, "12 34", None, None, 5), (None, "the and " * 60, None, None, 1), (None, "the and " * 60, None, None, 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def shingles(text):
    """The sets of five-word shingles that the near-copy stage compares."""
    words = re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_every_stage_follows_its_rule(stages):
    start, known, single, clean, mixed, tokens = map(rows, stages)
    columns = set(cp.COLUMNS)
    assert all(set(r) == columns for part in (known, single, clean, mixed) for r in part)

    kept = {r["doc_id"] for r in known}
    assert 9001 not in kept and 9002 not in kept and len(known) > 0.97 * len(start)
    texts = {r["doc_id"]: r["text"] for r in start}
    assert all(r["text"] == texts[r["doc_id"]] for r in known if r["doc_id"] is not None)

    marks = [shingles(r["text"]) for r in known]
    parent = list(range(len(known)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(known)):
        for j in range(i):
            if 5 * len(marks[i] & marks[j]) >= 4 * len(marks[i] | marks[j]):  # Jaccard 0.8; two without a word are alike
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, r in enumerate(known):
        groups.setdefault(find(i), []).append((r["doc_id"] is None, r["doc_id"] or 0))
    assert sorted(min(g) for g in groups.values()) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in single)
    assert len(single) < len(known)

    before = {r["doc_id"]: r["text"] for r in single}
    changed = [r for r in clean if r["text"] != before[r["doc_id"]]]
    assert len(clean) == len(single) and changed and all(secrets.MARKER in r["text"] for r in changed)
    assert all(r["n_chars"] == len(r["text"]) for r in clean)

    size = lambda t: len((t or "").encode().split())
    by_source = lambda part: {s: sum(size(r["text"]) for r in part if r["source"] == s) for s in {r["source"] for r in part}}
    have, want = by_source(clean), by_source(mixed)
    assert abs(sum(want.values()) - 1.5 * sum(have.values())) <= len(have)
    assert all(n <= 2 * have[s] for s, n in want.items())

    assert len(tokens) == len(mixed) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in tokens)
    words = byte_bpe.vocabulary(open(cp.public_tokenizers.path(cp.VOCABULARY), "rb").read())
    assert sorted(words.decode(bytes(r["ids"])) for r in tokens) == sorted(r["text"].encode() for r in mixed)


def test_empty_documents(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES])
def test_a_stage_alone_takes_small_batches(spark, stages, stage):
    """The driver calls the stages one by one, in a session of its own."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "10000")
        stage(spark, stages[0].limit(0), SF)
        assert int(spark.conf.get(setting)) <= 1024
    finally:
        spark.conf.set(setting, was)


def test_run_gives_the_rows_of_the_last_stage(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "ids", "n_tokens"] and got.count() > 200
    assert langid.UNDETERMINED == "und" and mixing.EPOCHS == 2
