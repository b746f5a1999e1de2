"""Report tables and the run digest."""

from pyspark.sql import functions as F

from themeloom import settings as S
from themeloom.catalog.inputs import LINE_NAMES, SIZES, SUMMARIES, TRIALS, document_summaries, line_annotations, line_sizes, run_row, trials
from themeloom.catalog.registry import query, r6, table
from themeloom.inference.providers import lead_words
from themeloom.operators.clusters import cluster_order, is_noise
from themeloom.operators.ranking import rank_by_size
from themeloom.plans import job, report, trials as tr
from themeloom.runtime import cut, only_row
from themeloom.sinks import tables


def _tried(spark, sf):
    """Trials, their sample size, and the winner's number as a column."""
    tried = trials(spark, sf)
    run = cut(run_row(spark, sf, tried))
    return tried, table(spark, sf, "embeddings").count(), only_row(run.select("trial_ord"))["trial_ord"], run


@query(
    "f1_cumulative_coverage",
    f"WITH {SIZES} SELECT rank, cluster_id, size, CAST(running AS BIGINT) AS running, round(running * 100.0::DOUBLE / total, 6) AS cum_pct, round(running * 100.0::DOUBLE / clustered, 6) AS cum_pct_clustered FROM cov",
)
def coverage(spark, sf):
    return report.coverage(line_sizes(spark, sf)).select(
        "rank", "cluster_id", "size", "running", r6("cum_pct").alias("cum_pct"), r6("cum_pct_clustered").alias("cum_pct_clustered")
    )


@query("f7_coverage_milestones", f"WITH {SIZES} SELECT rank, CAST(running AS BIGINT) AS running FROM cov WHERE rank IN (1, 5, 10, 20, 50, 100)")
def milestones(spark, sf):
    return report.at_ranks(report.coverage(line_sizes(spark, sf)), S.COVERAGE_RANKS).select("rank", "running")


@query(
    "e9_size_thresholds",
    f"""WITH {SIZES} SELECT count(*) FILTER (cluster_id <> -1 AND size >= 50) AS n_large, count(*) FILTER (cluster_id <> -1 AND size >= 20) AS n_medium,
    CAST(max(noise) AS BIGINT) AS noise_rows, round(max(noise) * 100.0::DOUBLE / max(total), 6) AS noise_pct FROM sz, tot""",
)
def thresholds(spark, sf):
    return report.faq_thresholds(line_sizes(spark, sf)).withColumn("noise_pct", r6("noise_pct"))


@query(
    "l1_faq_coverage",
    f"WITH {SIZES} SELECT rank AS top_n, CAST(running AS BIGINT) AS rows_covered, round(running * 100.0::DOUBLE / total, 6) AS pct_of_total FROM cov WHERE rank IN (3, 5, 10, 20, 50) OR rank = k",
)
def faq(spark, sf):
    return report.faq_coverage(line_sizes(spark, sf)).withColumn("pct_of_total", r6("pct_of_total"))


@query(
    "l2_pareto",
    f"WITH {SIZES} SELECT rank, size, round(running * 100.0::DOUBLE / total, 6) AS cum_pct, CAST(rank IN (1, 5, 10, 20, 50) OR rank = k AS BOOLEAN) AS highlight FROM cov",
)
def pareto(spark, sf):
    return report.pareto(line_sizes(spark, sf)).withColumn("cum_pct", r6("cum_pct"))


@query("f4_chart_rank", f"WITH {TRIALS} SELECT trial AS trial_ord, CAST(chart_rank AS INTEGER) AS chart_rank FROM charted")
def chart_rank(spark, sf):
    return tr.chart_ranks(trials(spark, sf)).select("trial_ord", "chart_rank")


_ACCEPTED = "acc AS (SELECT *, row_number() OVER (ORDER BY faq DESC, trial) AS rank FROM scored WHERE status = 'accepted')"


@query("f5_selection_rank", f"WITH {TRIALS}, {_ACCEPTED} SELECT CAST(rank AS INTEGER) AS rank, algorithm, params FROM acc")
def selection_rank(spark, sf):
    tried, n, won, _ = _tried(spark, sf)
    return report.accepted(tried, n, S.DEFAULT_TARGET, won).select("rank", "algorithm", "params")


@query(
    "l3_accepted",
    f"""WITH {TRIALS}, {_ACCEPTED} SELECT CAST(rank AS INTEGER) AS rank, coalesce(CAST(c.chart_rank AS VARCHAR), '—') AS chart_no, algorithm, params, n_clusters,
    CAST(n_noise AS BIGINT) AS n_noise, round(ratio, 6) AS noise_ratio, round(share, 6) AS max_cluster_share, round(silhouette, 6) AS silhouette, round(faq, 6) AS faq_score,
    round(chatbot, 6) AS chatbot_score, round(insight, 6) AS insight_score, CAST(acc.trial = (SELECT trial FROM winner) AS BOOLEAN) AS selected
    FROM acc LEFT JOIN charted c USING (trial)""",
)
def accepted(spark, sf):
    tried, n, won, _ = _tried(spark, sf)
    got = report.accepted(tried, n, S.DEFAULT_TARGET, won)
    return got.withColumns({c: r6(c) for c in ("noise_ratio", "max_cluster_share", "silhouette", "faq_score", "chatbot_score", "insight_score")})


@query(
    "l4_rejected_noise",
    f"""WITH {TRIALS} SELECT CAST(chart_rank AS INTEGER) AS chart_rank, algorithm, params, n_clusters, CAST(n_noise AS BIGINT) AS n_noise, round(ratio, 6) AS noise_ratio,
    round(silhouette, 6) AS silhouette FROM scored LEFT JOIN charted USING (trial) WHERE status = 'rejected_noise'""",
)
def rejected_noise(spark, sf):
    tried, n, _, _ = _tried(spark, sf)
    return report.rejected_noise(tried, n).withColumns({c: r6(c) for c in ("noise_ratio", "silhouette")})


@query(
    "l5_rejected_degenerate",
    f"WITH {TRIALS} SELECT algorithm, params, n_clusters, CAST(n_noise AS BIGINT) AS n_noise, round(ratio, 6) AS noise_ratio FROM scored WHERE status = 'rejected_degenerate'",
)
def rejected_degenerate(spark, sf):
    tried, n, _, _ = _tried(spark, sf)
    return report.rejected_degenerate(tried, n).withColumn("noise_ratio", r6("noise_ratio"))


@query(
    "l6_progression",
    f"WITH {TRIALS} SELECT algorithm, CAST(row_number() OVER (PARTITION BY algorithm ORDER BY trial) AS INTEGER) AS step, params, n_clusters, CAST(n_noise AS BIGINT) AS n_noise, round(silhouette, 6) AS silhouette FROM trials",
)
def progression(spark, sf):
    return report.progression(trials(spark, sf)).withColumn("silhouette", r6("silhouette"))


@query(
    "l7_search_chart",
    f"""WITH {TRIALS} SELECT CAST(chart_rank AS INTEGER) AS chart_rank, round(silhouette, 6) AS silhouette, n_clusters,
    CAST(trial = (SELECT trial FROM winner) AS BOOLEAN) AS is_winner, tick FROM charted JOIN scored USING (trial)""",
)
def search_chart(spark, sf):
    tried, _, won, _ = _tried(spark, sf)
    return report.search_chart(tried, won).withColumn("silhouette", r6("silhouette"))


def _region_names(spark, sf):
    """Names for some of the document clusters: regions."""
    return table(spark, sf, "region").select(
        F.col("r_regionkey").alias("cluster_id"), F.col("r_name").alias("label"), F.concat(F.lit("about "), "r_name").alias("summary")
    )


_SHORT = "CASE WHEN length(txt) > 200 THEN substr(txt, 1, 200) || '…' ELSE txt END"


@query(
    "l8_cluster_detail",
    f"""WITH {SUMMARIES} SELECT s.cid AS cluster_id, s.size,
      CASE WHEN s.cid = -1 THEN 'Unassigned (noise · ' || s.size || ' rows)' WHEN g.r_name IS NULL THEN 'Cluster #' || s.cid || ' (' || s.size || ' rows)'
           ELSE 'Cluster #' || s.cid || ': ' || g.r_name || ' (' || s.size || ' rows)' END AS heading,
      CASE WHEN s.cid = -1 THEN '{S.NOISE_SUMMARY}' WHEN g.r_name IS NULL THEN '{S.NO_SUMMARY_GENERATED}' ELSE 'about ' || g.r_name END AS representative_text,
      coalesce((SELECT string_agg({_SHORT}, chr(10) ORDER BY rk) FROM reps WHERE reps.cid = s.cid), '') AS raw_lines
    FROM csize s LEFT JOIN region g ON g.r_regionkey = s.cid""",
)
def cluster_detail(spark, sf):
    got = report.cluster_detail(document_summaries(spark, sf), _region_names(spark, sf))
    return got.withColumn("raw_lines", F.array_join("raw_lines", "\n"))


@query(
    "a11_cluster_list",
    f"""WITH {SUMMARIES} SELECT row_number() OVER (ORDER BY (s.cid = -1), s.size DESC, s.cid) AS place,
      s.cid AS cluster_id, CASE WHEN s.cid = -1 THEN 'Unassigned' ELSE coalesce(g.r_name, '') END AS cluster_name, s.size,
      coalesce('about ' || g.r_name, '') AS summary,
      coalesce((SELECT max(txt) FROM reps WHERE reps.cid = s.cid AND rk = 1), '') AS rep_1,
      coalesce((SELECT max(txt) FROM reps WHERE reps.cid = s.cid AND rk = 2), '') AS rep_2,
      coalesce((SELECT max(txt) FROM reps WHERE reps.cid = s.cid AND rk = 3), '') AS rep_3
    FROM csize s LEFT JOIN region g ON g.r_regionkey = s.cid""",
)
def cluster_list(spark, sf):
    listed = cut(tables.cluster_list(document_summaries(spark, sf), _region_names(spark, sf), top=3))
    places = rank_by_size(listed.where(~is_noise()).select("cluster_id", "size")).select("cluster_id", F.col("rank").alias("place"))
    last = F.lit(listed.count()).cast("bigint")  # noise closes the list
    return listed.join(places, "cluster_id", "left").withColumn("place", F.coalesce("place", last)).orderBy("place")


@query("m4_clustered_documents")
def clustered_documents(spark, sf):
    """The cluster list of a real run over all documents, each whole: hashed words, every method, offline labels."""
    rows = table(spark, sf, "documents").withColumnRenamed("doc_id", "row_id")
    result = job.classify(rows, text_col="text", chat=lead_words, max_length=None)
    return tables.cluster_list(result.summaries, result.annotations, top=3)


@query(
    "g5_top_labels",
    f"WITH {LINE_NAMES} SELECT cluster_id, label, size FROM sized ORDER BY size DESC, cluster_id LIMIT 15",
)
def top_labels(spark, sf):
    named = line_annotations(spark, sf).join(line_sizes(spark, sf), "cluster_id")
    return named.orderBy(*cluster_order()).limit(S.TOP_LABELS).select("cluster_id", "label", "size")


@query(
    "a12_run_metadata",
    f"""WITH {TRIALS} SELECT 'documents' AS input, 'text' AS text_col, w.algorithm AS algorithm, round(w.silhouette, 6) AS silhouette_score,
      CASE WHEN w.silhouette >= 0.4 THEN 'good' WHEN w.silhouette >= 0.2 THEN 'warn' ELSE 'poor' END AS quality, w.n_clusters, w.total AS n_rows,
      CAST(t.trial AS INTEGER) AS trial_ord, t.algorithm AS trial_algorithm, t.params AS trial_params, round(t.silhouette, 6) AS trial_silhouette, round(t.share, 6) AS trial_share
    FROM winner w, trials t""",
)
def run_metadata(spark, sf):
    tried, _, _, run = _tried(spark, sf)
    meta = report.run_metadata(run, tried, "documents", "text")
    flat = meta.select("*", F.posexplode("trials").alias("trial_ord", "t"))
    return flat.select(
        "input", "text_col", "algorithm", r6("silhouette_score").alias("silhouette_score"), "quality", "n_clusters",
        F.col("sweep_sample_size").alias("n_rows"), "trial_ord", F.col("t.algorithm").alias("trial_algorithm"),
        F.col("t.params").alias("trial_params"), r6("t.silhouette").alias("trial_silhouette"), r6("t.max_cluster_share").alias("trial_share"),
    )


@query(
    "l9_run_summary",
    f"""WITH {TRIALS}, w AS (SELECT *, (SELECT max(len(embedding)) FROM embeddings) AS dims FROM winner),
    items AS (SELECT unnest([
      {{'position': 0, 'item': 'Input', 'value': 'documents'}}, {{'position': 1, 'item': 'Text column', 'value': 'text'}},
      {{'position': 2, 'item': 'Effective rows', 'value': CAST(total AS VARCHAR)}}, {{'position': 3, 'item': 'Chosen algorithm', 'value': algorithm}},
      {{'position': 4, 'item': 'Parameters', 'value': params}},
      {{'position': 5, 'item': 'Silhouette score', 'value': printf('%.4f', silhouette) || ' (' || (CASE WHEN silhouette >= 0.4 THEN 'Good' WHEN silhouette >= 0.2 THEN 'Acceptable (with caveats)' ELSE 'Needs review' END) || ')'}},
      {{'position': 6, 'item': 'Cluster count', 'value': CAST(n_clusters AS VARCHAR)}}, {{'position': 7, 'item': 'Noise count', 'value': CAST(CAST(n_noise AS BIGINT) AS VARCHAR)}},
      {{'position': 8, 'item': 'Optimisation target', 'value': 'faq'}}, {{'position': 9, 'item': 'Sweep sample size', 'value': CAST(total AS VARCHAR)}},
      {{'position': 10, 'item': 'Dimensionality reduction', 'value': 'no reduction (' || dims || ' dims)'}},
      {{'position': 11, 'item': 'Noise-ratio filter', 'value': 'trials with at most 50% noise'}},
      {{'position': 12, 'item': 'Review recommended', 'value': CASE WHEN silhouette < 0.2 THEN 'yes' ELSE 'no' END}}]) AS r FROM w)
    SELECT CAST(r.position AS INTEGER) AS position, r.item AS item, r.value AS value FROM items""",
)
def run_summary(spark, sf):
    _, _, _, run = _tried(spark, sf)
    return report.run_summary(run, "documents", "text")


def _digest(spark, sf):
    """Digest of the supplier clusters under the read-off sweep's winner."""
    _, _, _, run = _tried(spark, sf)
    return report.run_digest(run, line_sizes(spark, sf), line_annotations(spark, sf))


_DIGEST = f"""WITH {TRIALS}, {LINE_NAMES.replace('base AS', 'base2 AS')},
  tops AS (SELECT string_agg(rank || '=' || printf('%.4f', running * 100.0::DOUBLE / total), ' ' ORDER BY rank) AS cover,
                  string_agg(rank || '=' || printf('%.4f', running * 100.0::DOUBLE / clustered), ' ' ORDER BY rank) AS cover_clustered
           FROM cov WHERE rank IN (1, 5, 10, 20, 50, 100)),
  named AS (SELECT string_agg(label || '=' || size, ' ' ORDER BY size DESC, cluster_id) AS names FROM
            (SELECT s.cluster_id, s.size, a.label FROM sz s LEFT JOIN ann a USING (cluster_id) WHERE s.cluster_id <> -1 ORDER BY s.size DESC, s.cluster_id LIMIT 15))"""


@query(
    "e10_run_digest",
    f"""{_DIGEST} SELECT 'faq' AS target, w.algorithm, w.params AS params_text, round(w.silhouette, 6) AS silhouette, w.n_clusters, CAST(t.total AS BIGINT) AS total_rows,
      round(w.n_noise * 100.0::DOUBLE / t.total, 6) AS noise_ratio_pct, round(t.largest * 100.0::DOUBLE / t.total, 6) AS max_share_pct, cover, cover_clustered, names
    FROM winner w, tot t, tops, named""",
)
def run_digest(spark, sf):
    def shown(c):
        return F.array_join(F.transform(c, lambda p: F.format_string("%d=%.4f", p["n"], p["pct"])), " ")

    names = F.array_join(F.transform("top_cluster_labels", lambda t: F.concat(t["label"], F.lit("="), t["size"].cast("string"))), " ")
    return _digest(spark, sf).select(
        "target", "algorithm", "params_text", r6("silhouette").alias("silhouette"), "n_clusters", "total_rows",
        r6("noise_ratio_pct").alias("noise_ratio_pct"), r6("max_share_pct").alias("max_share_pct"),
        shown("coverage_top_n").alias("cover"), shown("coverage_top_n_ex_noise").alias("cover_clustered"), names.alias("names"),
    )


# The digest's lines, spelled out from the same figures.
_BLOCK = f"""{_DIGEST},
  ranked AS (SELECT string_agg(rank || ' -> ' || printf('%.1f', running * 100.0::DOUBLE / total) || ' / ' || printf('%.1f', running * 100.0::DOUBLE / clustered), '; ' ORDER BY rank) AS x
             FROM cov WHERE rank IN (1, 5, 10, 20, 50, 100)),
  called AS (SELECT string_agg(coalesce(label, 'Cluster #' || cluster_id) || ' [' || size || ']', '; ' ORDER BY size DESC, cluster_id) AS x FROM
             (SELECT s.cluster_id, s.size, a.label FROM sz s LEFT JOIN ann a USING (cluster_id) WHERE s.cluster_id <> -1 ORDER BY s.size DESC, s.cluster_id LIMIT 15))"""


@query(
    "b12_digest_text",
    f"""{_BLOCK} SELECT concat_ws(chr(10), 'aim: {S.TARGET_PURPOSES["faq"]}',
      'rows: ' || CAST(t.total AS BIGINT) || ', in clusters: ' || CAST(t.total - w.n_noise AS BIGINT),
      'clusters: ' || w.n_clusters || ' by ' || w.algorithm || ' (' || w.params || '), silhouette ' || printf('%.3f', w.silhouette),
      'percent of rows: noise ' || printf('%.1f', w.n_noise * 100.0::DOUBLE / t.total) || ', largest cluster ' || printf('%.1f', t.largest * 100.0::DOUBLE / t.total),
      'largest clusters -> percent of all / of clustered rows: ' || ranked.x, 'labels [rows]: ' || called.x) AS block
    FROM winner w, tot t, ranked, called""",
)
def digest_text(spark, sf):
    return report.digest_text(_digest(spark, sf))
