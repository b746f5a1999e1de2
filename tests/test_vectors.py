import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import by_row, unit
from themeloom.operators import blocks as B
from themeloom.operators import clusters as C, knn, ranking, reduction, silhouette as sil


def test_zero_vectors_become_the_first_axis(as_vectors):
    got = by_row(C.unit_vectors(as_vectors([[0, 0, 0], [3, 4, 0]])), "embedding")
    assert np.allclose(got, [[1, 0, 0], [0.6, 0.8, 0]])


def brute_neighbours(x, k):
    similarity = np.round(x @ x.T, 10)
    np.fill_diagonal(similarity, -9)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(-similarity[i], kind="stable")[:k]}


@pytest.mark.parametrize("block_rows", [1000, 5])
def test_knn_is_exact_with_a_third_of_the_rows_identical(as_vectors, block_rows, monkeypatch):
    monkeypatch.setattr(knn, "FEW_CELLS", 6)
    random = np.random.default_rng(1)
    x = unit(np.concatenate([random.normal(size=(80, 6)), np.tile(random.normal(size=(1, 6)), (40, 1))]))
    got = knn.knn_join(as_vectors(x), 7, block_rows).collect()
    assert {(r.src, r.dst) for r in got} == brute_neighbours(x, 7)


def test_knn_prunes_but_stays_exact(as_vectors, blobs, monkeypatch):
    monkeypatch.setattr(knn, "FEW_CELLS", 2)
    x = unit(blobs)
    got = knn.knn_join(as_vectors(x), 5, block_rows=10).collect()
    assert {(r.src, r.dst) for r in got} == brute_neighbours(x, 5)


def test_first_round_alone_misses_little(as_vectors, blobs, monkeypatch):
    monkeypatch.setattr(knn, "FEW_CELLS", 2)
    x = unit(blobs)
    got = {(r.src, r.dst) for r in knn.knn_join(as_vectors(x), 5, block_rows=20, exact=False).collect()}
    assert len(got & brute_neighbours(x, 5)) >= 0.85 * 5 * len(x)


def test_graph_has_no_loops_and_no_negative_weights(as_vectors):
    x = unit(np.random.default_rng(0).normal(size=(30, 3)))
    edges = knn.knn_graph(as_vectors(x), 15).collect()
    assert all(e.src < e.dst and e.w >= 0 for e in edges)
    assert len({(e.src, e.dst) for e in edges}) == len(edges)


def brute_silhouette(x, labels):
    keep = labels != -1
    x, labels = x[keep], labels[keep]
    distance = 1 - x @ x.T
    scores = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = distance[i][own].sum() / (own.sum() - 1)
        b = min(distance[i][labels == c].mean() for c in set(labels) - {labels[i]})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


@pytest.mark.parametrize("budget", [sil.TILE_BYTES, 100])
def test_silhouette_equals_the_pairwise_one(spark, as_vectors, budget):
    random = np.random.default_rng(3)
    x = unit(random.normal(size=(60, 5)))
    labels = [random.integers(-1, 4, 60), random.integers(0, 2, 60), np.zeros(60, int), np.arange(60), np.full(60, -1)]
    labels[0][0] = 9  # a cluster of one row
    table = spark.createDataFrame(
        [(t, i, int(c)) for t, column in enumerate(labels) for i, c in enumerate(column)], "trial_ord int, row_id long, cluster_id int"
    )
    got = {r.trial_ord: r.silhouette for r in sil.silhouettes(as_vectors(x), table, budget).collect()}
    assert set(got) == {0, 1}
    assert got[0] == pytest.approx(brute_silhouette(x, labels[0])) and got[1] == pytest.approx(brute_silhouette(x, labels[1]))


def test_pca_axes_and_unit_length(as_vectors):
    x = np.random.default_rng(5).normal(size=(200, 60)) * np.linspace(3, 0.1, 60)
    x = unit(x)
    got = reduction.reduce_dimensions(as_vectors(x), 200)
    assert (got.dim_before, got.dim_after) == (60, 30)
    y = np.stack(by_row(got.vectors, "embedding"))
    assert np.allclose(np.linalg.norm(y, axis=1), 1)
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    expected = unit(centred @ vt[:30].T)
    assert np.allclose(np.abs((y * expected).sum(0)), (expected**2).sum(0), atol=1e-6)  # same axes up to sign
    assert np.allclose(got.explained, (s**2 / (s**2).sum())[:30])


def test_pca_is_skipped_for_short_vectors(as_vectors, blobs):
    table = as_vectors(blobs)
    assert reduction.reduce_dimensions(table, 120).vectors is table


def test_representatives(spark, as_vectors):
    vectors = as_vectors([[1, 0], [0.9, 0.1], [0.8, 0.2], [0, 1], [0.1, 0.9], [0.2, 0.8]])
    labels = spark.createDataFrame([(i, i // 3) for i in range(5)] + [(5, -1)], "row_id long, cluster_id int")
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "row_id long, _normalized_text string")
    got = {r.cluster_id: r for r in C.summarize_clusters(texts, vectors, labels, 2).collect()}
    assert [r.text for r in got[0].reps] == ["t1", "t0"] and got[0]["size"] == 3
    assert [r.row_id for r in got[1].reps] == [3, 4]
    assert got[-1].reps == [] and got[-1]["size"] == 1
    ordered = C.cluster_sizes(labels).orderBy(*C.id_order()).collect()
    assert [r.cluster_id for r in ordered] == [0, 1, -1]
    with pytest.raises(ValueError):
        C.require_aligned(texts.where("row_id < 5"), vectors, labels)


def test_opposed_vectors_keep_row_order(spark, as_vectors):
    points = as_vectors([[1, 0], [-1, 0], [0, 1], [0, -1]]).withColumn("cluster_id", F.lit(0))
    assert [r.row_id for r in C.representatives(points, 2).orderBy("rank").collect()] == [0, 1]


def test_rank_by_size_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ID_BUCKET", 7)
    random = np.random.default_rng(2)
    table = [(int(c), int(random.integers(1, 5))) for c in range(100)]
    got = ranking.rank_by_size(spark.createDataFrame(table, "cluster_id int, size long")).orderBy("rank").collect()
    expected = sorted(table, key=lambda t: (-t[1], t[0]))
    assert [(r.cluster_id, r["size"]) for r in got] == expected
    assert [r["rank"] for r in got] == list(range(1, 101))
    assert [r.running for r in got] == np.cumsum([s for _, s in expected]).tolist()


def test_sample_does_not_depend_on_partitions(spark):
    a = {r.row_id for r in ranking.hash_sample(spark.range(500).withColumnRenamed("id", "row_id"), 50, 42).collect()}
    b = {r.row_id for r in ranking.hash_sample(spark.range(500).repartition(7).withColumnRenamed("id", "row_id"), 50, 42).collect()}
    assert a == b and len(a) == 50


def test_representatives_by_salted_join_are_the_same(as_vectors):
    random = np.random.default_rng(8)
    points = C.unit_vectors(as_vectors(random.normal(size=(90, 4)))).withColumn(
        "cluster_id", F.when(F.col("row_id") % 3 == 0, 0).otherwise((F.col("row_id") % 11).cast("int"))
    )

    def rows(**join):
        return sorted(tuple(r) for r in C.representatives(points, 3, **join).collect())

    assert rows() == rows(budget=0, salts=4)


def test_cells_grow_with_the_root_of_the_table():
    assert [B.cell_count(n, 1024) for n in (1, 5000, 2**20, 10**8, 10**10)] == [1, 5, 1024, 10_000, 100_000]
    random = np.random.default_rng(8)
    x, centers = unit(random.normal(size=(500, 6))), unit(random.normal(size=(400, 6)))
    true = ((x[:, None, :] - centers[None, :, :]) ** 2).sum(2)
    cell, squared = B.nearest_center(x, centers, 400)
    assert (cell == true.argmin(1)).all() and np.allclose(squared, true.min(1))
    cell, squared = B.nearest_center(x, centers, 20)
    assert np.allclose(squared, true[np.arange(500), cell]) and (cell == true.argmin(1)).mean() > 0.8


def test_probing_cells(as_vectors):
    """All cells give the exact neighbours, as many as a sample asks for about nine tenths, and one cell is tied to one."""
    random = np.random.default_rng(9)
    x = unit(np.repeat(random.normal(size=(30, 8)), 20, axis=0) + random.normal(0, 0.15, (600, 8)))
    table = as_vectors(x)
    near = lambda df: {(r.src, r.dst) for r in df.collect()}
    true = near(knn.knn_join(table, 6))
    assert near(knn.knn_join(table, 6, block_rows=12)) == true and len(true) == 3600
    assert near(knn.knn_join(table, 6, block_rows=12, exact=False, nprobe=50)) == true
    probes, measured = knn.probes_needed(B.make_blocks(table, 12), 6)
    found = near(knn.knn_join(table, 6, block_rows=12, exact=False))
    assert 1 <= probes < 50 and measured >= 0.9 and len(found & true) >= 0.87 * len(true)
    plan = B.pair_up(B.make_blocks(table, 12), B.make_blocks(table, 12).pairs(lambda c, gap: np.array([c])))._jdf.queryExecution().toString()
    assert "cell" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_rows_go_to_tiles_not_to_every_block(as_vectors, monkeypatch):
    """However small the blocks, a row is sent to as many tasks as there are tiles, at most twice."""
    random = np.random.default_rng(10)
    x = unit(random.normal(size=(400, 5)))
    blocks = B.make_blocks(as_vectors(x), 4)
    sent = B.pair_up(blocks, blocks.pairs(lambda c, gap: np.arange(len(gap))))
    assert len(blocks.centers) == 100 and blocks.n_tiles <= B.TILES + 1
    assert sent.count() <= 2 * blocks.n_tiles * 400
    monkeypatch.setattr(knn, "ROWS", 7)
    monkeypatch.setattr(knn, "COLUMNS", 9)
    monkeypatch.setattr(knn, "TRIAL_COLUMNS", 5)
    near = lambda size: sorted(tuple(r) for r in knn.knn_join(as_vectors(x), 6, size).collect())
    sim = np.round(x @ x.T, 10)
    np.fill_diagonal(sim, -np.inf)
    assert [r[:2] for r in near(4)] == sorted((i, int(j)) for i in range(400) for j in np.lexsort((np.arange(400), -sim[i]))[:6])


def test_a_group_of_copies_larger_than_a_tile(as_vectors):
    """Copies are split over tiles; each still finds the lowest ids among them."""
    x = np.tile([0.6, 0.8], (300, 1))
    got = {}
    for r in knn.knn_join(as_vectors(x), 3, block_rows=5).collect():
        got.setdefault(r.src, []).append((r.rank, r.dst))
    assert all([d for _, d in sorted(got[i])] == [j for j in range(4) if j != i][:3] for i in range(300))
