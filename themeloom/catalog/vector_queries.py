"""Vectors, clusters, graphs and trials."""

from pyspark.sql import functions as F

from themeloom import settings as S
from themeloom.catalog.inputs import (
    RECORDS, SUMMARIES, TRIALS, VECTORS, document_labels, document_summaries, given_labels, line_labels, run_row,
    trial_labels, trials, vectors,
)
from themeloom.catalog.registry import query, r6, table
from themeloom.operators import blocks, clusters as C, community, density, kmeans, knn, ranking, reduction, silhouette as sil
from themeloom.plans import search, trials as tr
from themeloom.runtime import cut

_LINES = "lab AS (SELECT CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE l_suppkey END AS INTEGER) AS c FROM lineitem)"


@query("c4_noise_exclusion", f"WITH {_LINES} SELECT c AS cluster_id, count(*) AS n FROM lab WHERE c <> -1 GROUP BY c")
def without_noise(spark, sf):
    return line_labels(spark, sf).where(~C.is_noise()).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query("e3_cluster_counts", f"WITH {_LINES} SELECT count(DISTINCT c) FILTER (c <> -1) AS n_clusters, count(*) FILTER (c = -1) AS n_noise FROM lab")
def cluster_counts(spark, sf):
    return C.count_clusters(line_labels(spark, sf)).select("n_clusters", "n_noise")


@query(
    "e4_max_cluster_share",
    f"WITH {_LINES}, n AS (SELECT c, count(*) AS size FROM lab GROUP BY c) SELECT round(max(size) FILTER (c <> -1) / sum(size), 6) AS max_cluster_share FROM n",
)
def max_share(spark, sf):
    return C.count_clusters(line_labels(spark, sf)).select(r6("max_cluster_share").alias("max_cluster_share"))


@query("e6_cluster_sizes", f"WITH {_LINES} SELECT c AS cluster_id, count(*) AS size FROM lab GROUP BY c")
def sizes(spark, sf):
    return C.cluster_sizes(line_labels(spark, sf))


@query("h2_cluster_ids", f"WITH {_LINES} SELECT DISTINCT c AS cluster_id FROM lab WHERE c <> -1")
def ids(spark, sf):
    return C.cluster_ids(line_labels(spark, sf))


@query(
    "g2_clusters_by_size",
    f"WITH {_LINES} SELECT row_number() OVER (ORDER BY (c = -1), count(*) DESC, c) AS place, c AS cluster_id, count(*) AS size FROM lab GROUP BY c",
)
def by_size(spark, sf):
    """The position each cluster has in that order; noise comes after all ranked ones."""
    sized = cut(C.cluster_sizes(line_labels(spark, sf)))
    ranked = ranking.rank_by_size(sized.where(~C.is_noise())).select(F.col("rank").alias("place"), "cluster_id", "size")
    noise = sized.where(C.is_noise()).select(F.lit(sized.count()).cast("bigint").alias("place"), "cluster_id", "size")
    return ranked.unionByName(noise)


@query(
    "g3_clusters_by_id",
    f"WITH {_LINES} SELECT row_number() OVER (ORDER BY (c = -1), c) AS place, c AS cluster_id, count(*) AS size, CAST(c = -1 AS BOOLEAN) AS is_noise FROM lab GROUP BY c",
)
def by_id(spark, sf):
    """The place each cluster has in the order of ids: ranks of equal sizes go by id, noise comes last."""
    sized = cut(C.cluster_sizes(line_labels(spark, sf)))
    ranked = ranking.rank_by_size(sized.where(~C.is_noise()).withColumn("one", F.lit(1).cast("bigint")), "one")
    noise = sized.where(C.is_noise()).select(F.lit(sized.count()).cast("bigint").alias("place"), "cluster_id", "size")
    placed = ranked.select(F.col("rank").alias("place"), "cluster_id", "size").unionByName(noise)
    return placed.withColumn("is_noise", C.is_noise()).orderBy(*C.id_order())


def _components(df, *keys):
    return df.select(*keys, F.posexplode("embedding").alias("i", "x"))


@query("j1_l2_normalize", f"WITH {VECTORS} SELECT vec_id AS row_id, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM parts")
def normalize(spark, sf):
    return _components(vectors(spark, sf), "row_id").select("row_id", "i", r6("x").alias("x"))


@query(
    "e5_centroids",
    f"""WITH {VECTORS}, m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM parts GROUP BY label, i)
    SELECT label AS cluster_id, n AS size, CAST(i - 1 AS INTEGER) AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM m""",
)
def centroids(spark, sf):
    points = vectors(spark, sf).join(given_labels(spark, sf), "row_id")
    got = C.centroids(points).withColumnRenamed("centroid", "embedding")
    return _components(got, "cluster_id", "size").select("cluster_id", "size", "i", r6("x").alias("x"))


@query(
    "f2_representatives",
    f"""WITH {VECTORS}, m AS (SELECT label, i, avg(x) AS m FROM parts GROUP BY label, i),
    c AS (SELECT label, list(m / s ORDER BY i) AS c FROM (SELECT label, i, m, sqrt(sum(m * m) OVER (PARTITION BY label)) AS s FROM m) GROUP BY label),
    r AS (SELECT u.label, u.vec_id, round(list_dot_product(u.v, c.c), 9) AS sim FROM unit u JOIN c USING (label)),
    k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rk FROM r)
    SELECT label AS cluster_id, CAST(rk AS INTEGER) AS rank, vec_id AS row_id, round(sim, 6) AS similarity FROM k WHERE rk <= 5""",
)
def representatives(spark, sf):
    points = vectors(spark, sf).join(given_labels(spark, sf), "row_id")
    return C.representatives(points).select("cluster_id", "rank", "row_id", r6("similarity").alias("similarity"))


@query(
    "d9_summaries",
    f"WITH {SUMMARIES} SELECT s.cid AS cluster_id, s.size, CAST(coalesce(r.rk, 0) AS INTEGER) AS rank, r.vec_id AS row_id, r.txt AS text FROM csize s LEFT JOIN reps r USING (cid)",
)
def summaries(spark, sf):
    got = document_summaries(spark, sf).select("cluster_id", "size", F.explode_outer("reps").alias("r"))
    return got.select("cluster_id", "size", F.coalesce("r.rank", F.lit(0)).alias("rank"), "r.row_id", "r.text")


@query("e7_silhouette", f"WITH {TRIALS} SELECT round(silhouette, 6) AS silhouette FROM sil WHERE trial = 2")
def silhouette(spark, sf):
    labels = given_labels(spark, sf).withColumn("trial_ord", F.lit(2))
    return sil.silhouettes(vectors(spark, sf), labels).select(r6("silhouette").alias("silhouette"))


_NEAR = f"""WITH {VECTORS}, s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.v, b.v), 10) AS sim FROM unit a JOIN unit b ON a.vec_id <> b.vec_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rk FROM s), near AS (SELECT * FROM k WHERE rk <= 14)"""


@query("d7_knn_join", f"{_NEAR} SELECT src, dst, CAST(rk AS INTEGER) AS rank, round(sim, 6) AS similarity FROM near")
def neighbours(spark, sf):
    return knn.knn_join(vectors(spark, sf), S.GRAPH_NEIGHBOURS - 1).select("src", "dst", "rank", r6("similarity").alias("similarity"))


@query("d7_probed_recall", "SELECT count(*) AS n_rows, TRUE AS most_found, TRUE AS fewer_than_all_cells FROM embeddings")
def probed(spark, sf):
    """Neighbours in as many cells as a sample asks for, against all of them."""
    rows = cut(vectors(spark, sf))
    k, size = S.GRAPH_NEIGHBOURS - 1, 8
    near = cut(knn.knn_join(rows, k, block_rows=size, exact=False))
    true = knn.knn_join(rows, k).select("src", "dst")
    share = near.join(true, ["src", "dst"]).count() / true.count()
    probes, _ = knn.probes_needed(blocks.make_blocks(rows, size), k)
    measured = near.agg(F.count_distinct("src").alias("n_rows"))
    cells = blocks.cell_count(rows.count(), size)
    return measured.select("n_rows", F.lit(share >= 0.85).alias("most_found"), F.lit(probes < cells).alias("fewer_than_all_cells"))


@query(
    "j7_knn_graph",
    f"{_NEAR} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(greatest(sim, 0)), 6) AS w FROM near GROUP BY 1, 2",
)
def graph(spark, sf):
    return knn.knn_graph(vectors(spark, sf)).select("src", "dst", r6("w").alias("w"))


@query("j2_pca")
def pca(spark, sf):
    rows = vectors(spark, sf)
    return reduction.reduce_dimensions(rows, rows.count()).vectors


@query("j3_kmeans")
def k_means(spark, sf):
    return kmeans.kmeans(vectors(spark, sf), 10)


@query("j4_kmeans_sweep")
def k_means_sweep(spark, sf):
    rows = cut(vectors(spark, sf))
    ks = kmeans.k_candidates(rows.count(), S.MIN_CLUSTERS_DEFAULT, S.MAX_CLUSTERS_DEFAULT)
    found = tr.stack_labels([labels for _, labels in kmeans.kmeans_sweep(rows, ks)])
    return tr.trial_sizes(found)


@query(
    "j5_core_distances",
    f"""WITH {VECTORS}, s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.v, b.v), 10) AS sim FROM unit a JOIN unit b ON a.vec_id <> b.vec_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rk FROM s)
    SELECT src AS row_id, round(sqrt(greatest(2 - 2 * sim, 0)), 6) AS core FROM k WHERE rk = 5""",
)
def core_distances(spark, sf):
    near = knn.knn_join(vectors(spark, sf), S.MIN_SAMPLES)
    return density.core_distances(near).select("row_id", r6("core").alias("core"))


@query("j5_density")
def density_labels(spark, sf):
    return density.density(cut(vectors(spark, sf)), 5)


@query("j6_density_sweep")
def density_sweep(spark, sf):
    rows = cut(vectors(spark, sf))
    n = rows.count()
    found = density.density_sweep(rows, n, density.size_candidates(n))
    return tr.trial_sizes(tr.stack_labels([labels for _, labels in found]))


@query("j8_communities")
def community_labels(spark, sf):
    return community.leiden(cut(vectors(spark, sf)), 1.0)


@query("j9_community_sweep")
def community_sweep(spark, sf):
    rows = cut(vectors(spark, sf))
    found = community.community_sweep(rows, rows.count())
    return tr.trial_sizes(tr.stack_labels([labels for _, labels in found]))


@query(
    "j10_trial_table",
    f"WITH {TRIALS} SELECT trial AS trial_ord, algorithm, round(silhouette, 6) AS silhouette, n_clusters, CAST(n_noise AS BIGINT) AS n_noise, round(share, 6) AS max_cluster_share FROM trials",
)
def trial_table(spark, sf):
    return trials(spark, sf).select(
        "trial_ord", "algorithm", r6("silhouette").alias("silhouette"), "n_clusters", "n_noise", r6("max_cluster_share").alias("max_cluster_share")
    )


@query("h1_stacked_sweeps", f"WITH {TRIALS} SELECT trial AS trial_ord, vec_id AS row_id, c AS cluster_id FROM lab")
def stacked(spark, sf):
    return trial_labels(spark, sf)


@query(
    "c5_scored_trials",
    f"WITH {TRIALS} SELECT trial AS trial_ord, round(silhouette, 6) AS silhouette FROM trials WHERE silhouette IS NOT NULL AND silhouette > -1",
)
def scored(spark, sf):
    return trials(spark, sf).where(tr.has_score()).select("trial_ord", r6("silhouette").alias("silhouette"))


@query(
    "c6_noise_budget",
    f"WITH {TRIALS} SELECT trial AS trial_ord, round(ratio, 6) AS noise_ratio, CAST(ratio <= 0.5 AS BOOLEAN) AS in_budget FROM trials",
)
def budget(spark, sf):
    n = table(spark, sf, "embeddings").count()
    return trials(spark, sf).select(
        "trial_ord", r6(tr.noise_ratio(n)).alias("noise_ratio"), (tr.noise_ratio(n) <= S.MAX_NOISE_RATIO).alias("in_budget")
    )


@query("g4_winner", f"WITH {TRIALS} SELECT trial AS trial_ord, algorithm, params, round(silhouette, 6) AS silhouette, n_clusters FROM winner")
def winner(spark, sf):
    from themeloom.functions.text import format_params

    return run_row(spark, sf, trials(spark, sf)).select(
        "trial_ord", "algorithm", format_params(F.col("params")).alias("params"), r6("silhouette").alias("silhouette"), "n_clusters"
    )


@query("h4_trial_status", f"WITH {TRIALS} SELECT trial AS trial_ord, status FROM scored")
def trial_status(spark, sf):
    n = table(spark, sf, "embeddings").count()
    return trials(spark, sf).select("trial_ord", tr.status(n).alias("status"))


@query(
    "g6_hash_sample",
    "SELECT o_orderkey AS row_id, o_totalprice FROM orders ORDER BY sha256(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey LIMIT 5000",
)
def sample(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    return ranking.hash_sample(rows, 5000, S.SEED)


@query("j11_refit_full")
def refit(spark, sf):
    """The winner of the read-off sweep, fitted to all rows."""
    won = run_row(spark, sf, trials(spark, sf)).first()
    return search.fit(cut(vectors(spark, sf)), won["algorithm"], won["params"])


@query("j12_find_best_clustering")
def best(spark, sf):
    found = search.find_best_clustering(vectors(spark, sf))
    return found.trials.select("trial_ord", "algorithm", "silhouette", "n_clusters", "n_noise", "max_cluster_share")


@query("j13_chosen_methods")
def chosen_methods(spark, sf):
    return search.find_best_clustering(vectors(spark, sf), target="insight", methods=("leiden",)).labels


@query(
    "c7_annotatable_clusters",
    f"WITH {SUMMARIES} SELECT s.cid AS cluster_id, s.size FROM csize s WHERE s.cid <> -1 AND s.cid IN (SELECT cid FROM reps)",
)
def annotatable(spark, sf):
    from themeloom.inference.annotate import annotatable as keep

    return keep(document_summaries(spark, sf)).select("cluster_id", "size")


@query(
    "a10_classified_rows",
    f"""WITH {SUMMARIES} SELECT r.row_id, r.txt AS normalized, r.dup AS duplicate_count, d.lang, d.source, l.cid AS cluster_id,
      CASE WHEN l.cid = -1 THEN '' ELSE coalesce(g.r_name, '') END AS cluster_name
    FROM recs r JOIN lab l ON l.vec_id = r.row_id JOIN documents d ON d.doc_id = r.row_id LEFT JOIN region g ON g.r_regionkey = l.cid""",
)
def classified(spark, sf):
    from themeloom.catalog.inputs import records
    from themeloom.sinks.tables import classified_rows

    names = table(spark, sf, "region").select(F.col("r_regionkey").alias("cluster_id"), F.col("r_name").alias("label"))
    recs = cut(records(spark, sf))
    got = classified_rows(recs, document_labels(recs), names)
    return got.select(
        "row_id", F.col("_normalized_text").alias("normalized"), F.col("_duplicate_count").alias("duplicate_count"), "lang", "source", "cluster_id", "cluster_name"
    )
