"""What the jobs leave on disk while they run."""

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from themeloom import runtime
from themeloom.operators import blocks as B, community, knn

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tables(spark):
    folder = Path(runtime.app_folder(spark))
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def test_rows_go_once_to_every_two_tiles(as_vectors):
    """A row meets the rows of another tile in one task, both ways."""
    blocks = B.make_blocks(as_vectors(unit(np.random.default_rng(3).normal(size=(400, 5)))), 4)
    sent = B.pair_up(blocks, blocks.pairs(lambda c, gap: np.arange(len(gap)))).select("qt", "mt", "row_id").collect()
    assert all(r.qt <= r.mt for r in sent)
    assert len(sent) == len({tuple(r) for r in sent}) == blocks.n_tiles * 400


def test_one_sided_rules_hold_either_way():
    """Cell 0 asks cell 1, which asks nobody: of the two tiles only one row gets a neighbour."""
    table = pa.table({
        "qt": [0, 0], "mt": [1, 1], "side": [0, 1], "cell": [0, 1], "row_id": [5, 4], "embedding": [[1.0, 0.0], [0.6, 0.8]], "floor": [-np.inf] * 2,
    })
    for c, rows in ((0, [(5, 4)]), (1, [(4, 5)])):
        found = knn._nearest(3, lambda cell, c=c: np.array([1 - c] if cell == c else [], np.int64))(table)
        assert list(zip(found["src"].to_pylist(), found["dst"].to_pylist())) == rows


def test_communities_keep_few_tables(spark, as_vectors):
    """Of many rounds in many blocks only what the result reads stays."""
    random = np.random.default_rng(8)
    table = as_vectors(unit(np.repeat(random.normal(size=(6, 5)), 40, axis=0) + random.normal(0, 0.2, (240, 5))))
    edges = runtime.cut(knn.knn_graph(table, 8))
    before = tables(spark)
    found = community.communities(edges, table.select("row_id"), [0.5, 1.0], 60)
    assert len(tables(spark) - before) <= 6
    assert found.count() == 480 and found.select("trial_ord", "row_id").distinct().count() == 480


def test_communities_are_computed_once(spark, as_vectors, monkeypatch):
    """Numbering reads the communities more than once; they are written before."""
    plain, seen = community.renumber, []
    monkeypatch.setattr(community, "renumber", lambda labels, *by: seen.append(labels._jdf.queryExecution().toString()) or plain(labels, *by))
    table = as_vectors(unit(np.random.default_rng(2).normal(size=(30, 4))))
    assert len(community.community_sweep(table, 30, (1.0,))) == 1 and community.leiden(table, 1.0).count() == 30
    assert len(seen) == 2 and all("FlatMapCoGroups" not in plan for plan in seen)


def test_shuffle_files_go_within_a_job_only(spark):
    assert spark.conf.get(SETTING, None) is None
    with runtime.lean_shuffles(spark):
        with runtime.lean_shuffles(spark):
            pass
        assert spark.conf.get(SETTING) == "true"
    assert spark.conf.get(SETTING, None) is None
    spark.conf.set(SETTING, "false")
    try:
        with runtime.lean_shuffles(spark):
            assert spark.conf.get(SETTING) == "false"
    finally:
        spark.conf.unset(SETTING)


def test_only_written_tables_are_discarded(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/input")
    kept = spark.read.parquet(f"{tmp_path}/input")
    written = runtime.cut(kept)
    runtime.discard(kept.where("id > 0"))
    assert kept.count() == 3 and written.count() == 3
    before = tables(spark)
    runtime.discard(written.select("id"))
    assert len(before - tables(spark)) == 1


def test_tables_of_nodes_are_not_sent_to_the_driver(spark):
    """However small their files: a few MB of them can hold more rows than a driver has room for."""
    links = runtime.cut(spark.createDataFrame([(0, i, j, 1.0) for i in range(6) for j in range(6) if i != j], "trial_ord int, src long, dst long, w double"))
    state = runtime.cut(spark.createDataFrame([(0, i, 5.0, 0.0, i, i // 2) for i in range(6)], "trial_ord int, node long, degree double, inner double, community long, part long"))
    reach = runtime.cut(community._reach(links, 2))
    dealt = community._dealt(links, [1.0], 2)
    members = runtime.cut(state.select("trial_ord", F.col("node").alias("row_id"), "node"))
    labels = state.select(F.col("node").alias("row_id"), F.col("part").alias("cluster_id"))
    plans = [
        community._round(dealt, reach, state, [1.0], 30.0, 0, 2), community._next_level(state, dealt, reach, 4, 2)[0],
        community._placed(members, labels.select(F.lit(0).alias("trial_ord"), F.col("row_id").alias("node"), "cluster_id")),
    ]
    assert all("Join" in p and "Broadcast" not in p for p in (df._jdf.queryExecution().executedPlan().toString() for df in plans))
    assert community.communities(links.where("src < dst").drop("trial_ord"), labels, [1.0], 3).count() == 6


def test_nodes_listed_twice_are_met_twice():
    at, place = community._joined(np.array([7, 3, 9, 3]), np.array([3, 7, 3]))
    assert list(zip(at.tolist(), place.tolist())) == [(0, 1), (1, 0), (1, 2), (3, 0), (3, 2)]
    at, place = community._joined(np.array([7]), np.empty(0, np.int64))
    assert not len(at) and not len(place)
