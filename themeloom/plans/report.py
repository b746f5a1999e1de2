"""The tables of the two reports, as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom import settings as S
from themeloom.functions import scoring, text as T
from themeloom.operators.clusters import cluster_order, is_noise
from themeloom.operators.ranking import rank_by_size
from themeloom.plans import trials as tr
from themeloom.runtime import only_row


def total_rows(sizes: DataFrame) -> DataFrame:
    """One row: all rows, those in clusters, noise, and how many clusters there are."""
    real = ~is_noise()
    return sizes.agg(
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.coalesce(F.sum(F.when(real, F.col("size"))), F.lit(0)).cast("bigint").alias("clustered_rows"),
        F.coalesce(F.sum(F.when(~real, F.col("size"))), F.lit(0)).cast("bigint").alias("noise_rows"),
        F.count_if(real).alias("n_clusters"),
        F.coalesce(F.max(F.when(real, F.col("size"))), F.lit(0)).cast("bigint").alias("largest"),
        F.count_if(real & (F.col("size") >= S.LARGE_CLUSTER)).alias("n_large"),
        F.count_if(real & (F.col("size") >= S.MEDIUM_CLUSTER)).alias("n_medium"),
    )


def coverage(sizes: DataFrame) -> DataFrame:
    """Clusters by size with the running share, in percent, of all rows and of clustered rows.

    Noise counts towards all rows but has no rank.
    """
    totals = only_row(total_rows(sizes))
    ranked = rank_by_size(sizes.where(~is_noise())).withColumn("totals", totals)
    return ranked.select(
        "rank", "cluster_id", "size", "running", "totals.total_rows", "totals.n_clusters",
        (F.col("running") * 100.0 / F.col("totals.total_rows")).alias("cum_pct"),
        (F.col("running") * 100.0 / F.col("totals.clustered_rows")).alias("cum_pct_clustered"),
    )


def at_ranks(covered: DataFrame, ranks: tuple[int, ...], last: bool = False) -> DataFrame:
    wanted = F.col("rank").isin(*ranks)
    return covered.where(wanted | (F.col("rank") == F.col("n_clusters")) if last else wanted)


def faq_coverage(sizes: DataFrame) -> DataFrame:
    """Rows covered by the top N clusters at the milestones and at the last cluster."""
    marks = at_ranks(coverage(sizes), S.FAQ_MILESTONES, last=True)
    return marks.select(F.col("rank").alias("top_n"), F.col("running").alias("rows_covered"), F.col("cum_pct").alias("pct_of_total"))


def faq_thresholds(sizes: DataFrame) -> DataFrame:
    """One row: clusters worth a template, and what noise there is; none without clusters."""
    return total_rows(sizes).where("total_rows > 0 and n_clusters > 0").select(
        "n_large", "n_medium", "noise_rows", (F.col("noise_rows") * 100.0 / F.col("total_rows")).alias("noise_pct")
    )


def pareto(sizes: DataFrame) -> DataFrame:
    """The curve's points; a few ranks and the last one are highlighted."""
    marked = F.col("rank").isin(*S.PARETO_MARKS) | (F.col("rank") == F.col("n_clusters"))
    return coverage(sizes).select("rank", "size", "cum_pct", marked.alias("highlight"))


def accepted(trials: DataFrame, sample_size: Column | int, target: str, winner_ord: Column | int) -> DataFrame:
    """Accepted trials in order of choice, with their place on the chart and what-if scores."""
    scored = tr.with_scores(trials, target).where(tr.status(sample_size) == "accepted")
    chart = tr.chart_ranks(trials).select("algorithm", T.param_key(F.col("params")).alias("key"), "chart_rank")
    order = Window.orderBy(F.desc("score"), "trial_ord")  # a sweep has a few dozen trials
    return (
        scored.withColumn("key", T.param_key(F.col("params")))
        .withColumn("rank", F.row_number().over(order))
        .join(chart, ["algorithm", "key"], "left")
        .select(
            "rank", F.coalesce(F.col("chart_rank").cast("string"), F.lit("—")).alias("chart_no"), "algorithm",
            T.format_params(F.col("params")).alias("params"), "n_clusters", "n_noise",
            tr.noise_ratio(sample_size).alias("noise_ratio"), "max_cluster_share", "silhouette",
            "faq_score", "chatbot_score", "insight_score", (F.col("trial_ord") == winner_ord).alias("selected"),
        )
    )


def rejected_noise(trials: DataFrame, sample_size: Column | int) -> DataFrame:
    chart = tr.chart_ranks(trials).select("trial_ord", "chart_rank")
    return (
        trials.where(tr.status(sample_size) == "rejected_noise")
        .join(chart, "trial_ord", "left")
        .select(
            "chart_rank", "algorithm", T.format_params(F.col("params")).alias("params"), "n_clusters", "n_noise",
            tr.noise_ratio(sample_size).alias("noise_ratio"), "silhouette",
        )
        .orderBy(F.desc("silhouette"))
    )


def rejected_degenerate(trials: DataFrame, sample_size: Column | int) -> DataFrame:
    return trials.where(tr.status(sample_size) == "rejected_degenerate").orderBy("trial_ord").select(
        "algorithm", T.format_params(F.col("params")).alias("params"), "n_clusters", "n_noise",
        tr.noise_ratio(sample_size).alias("noise_ratio"),
    )


def progression(trials: DataFrame) -> DataFrame:
    """Every trial under its method, in the order tried."""
    place = F.array_position(F.array(*[F.lit(m) for m in S.METHODS]), F.col("algorithm"))
    order = Window.partitionBy("algorithm").orderBy("trial_ord")
    return (
        trials.withColumn("step", F.row_number().over(order))
        .orderBy(place, "trial_ord")
        .select("algorithm", "step", T.format_params(F.col("params")).alias("params"), "n_clusters", "n_noise", "silhouette")
    )


def search_chart(trials: DataFrame, winner_ord: Column | int) -> DataFrame:
    tags = F.create_map(*[F.lit(x) for item in S.METHOD_TAGS.items() for x in item])
    tag = F.coalesce(tags[F.col("algorithm")], F.substring("algorithm", 1, 2))
    return tr.chart_ranks(trials).orderBy("chart_rank").select(
        "chart_rank", "silhouette", "n_clusters", (F.col("trial_ord") == winner_ord).alias("is_winner"),
        F.concat(tag, F.lit(":"), T.compact_params(F.col("params"))).alias("tick"),
    )


def cluster_detail(summaries: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """Heading, summary and shortened representatives of each cluster, largest first, noise last."""
    out = summaries
    if annotations is None:
        out = out.withColumn("label", F.lit(None).cast("string")).withColumn("summary", F.lit(None).cast("string"))
    else:
        out = out.join(annotations.select("cluster_id", "label", "summary"), "cluster_id", "left")
    rows = F.concat(F.lit(" ("), F.col("size").cast("string"), F.lit(" rows)"))
    number = F.concat(F.lit("Cluster #"), F.col("cluster_id").cast("string"))
    heading = (
        F.when(is_noise(), F.concat(F.lit("Unassigned (noise · "), F.col("size").cast("string"), F.lit(" rows)")))
        .when(F.coalesce("label", F.lit("")) == "", F.concat(number, rows))
        .otherwise(F.concat(number, F.lit(": "), F.col("label"), rows))
    )
    text = (
        F.when(is_noise(), S.NOISE_SUMMARY)
        .when(F.size("reps") == 0, "_No representative text available._")
        .when(F.coalesce("summary", F.lit("")) == "", S.NO_SUMMARY_GENERATED)
        .otherwise(F.col("summary"))
    )
    lines = F.transform("reps", lambda r: T.report_line(r["text"]))
    return out.orderBy(*cluster_order()).select(
        "cluster_id", "size", heading.alias("heading"), text.alias("representative_text"), lines.alias("raw_lines")
    )


def run_summary(best: DataFrame, source: str, text_col: str) -> DataFrame:
    """`position, item, value` rows that open both reports, from a one-row run table."""
    flag = scoring.quality_flag(F.col("silhouette"))
    pca = F.when(
        F.col("dim_before") != F.col("dim_after"), F.format_string("PCA %d → %d dims", "dim_before", "dim_after")
    ).otherwise(F.format_string("no reduction (%d dims)", "dim_before"))
    items = {
        "Input": F.lit(source),
        "Text column": F.lit(text_col),
        "Effective rows": F.col("n_rows").cast("string"),
        "Chosen algorithm": F.col("algorithm"),
        "Parameters": T.format_params(F.col("params")),
        "Silhouette score": F.concat(
            F.format_string("%.4f", "silhouette"), F.lit(" ("), scoring.quality_label(flag), F.lit(")")
        ),
        "Cluster count": F.col("n_clusters").cast("string"),
        "Noise count": F.col("n_noise").cast("string"),
        "Optimisation target": F.col("target"),
        "Sweep sample size": F.col("sweep_sample_size").cast("string"),
        "Dimensionality reduction": pca,
        "Noise-ratio filter": F.format_string("trials with at most %.0f%% noise", F.col("max_noise_ratio") * 100),
        "Review recommended": F.when(flag == "poor", "yes").otherwise("no"),
    }
    rows = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(k).alias("item"), v.alias("value")) for i, (k, v) in enumerate(items.items())]
    )
    return best.select(F.explode(rows).alias("r")).select("r.*").orderBy("position")


def run_metadata(best: DataFrame, trials: DataFrame, source: str, text_col: str) -> DataFrame:
    """One row with what a program needs to know of a run, the trials nested.

    The trial log keeps each trial's largest share. Cluster names are a table of their
    own: there may be too many to nest in one row.
    """
    entry = F.struct(
        "trial_ord", "algorithm", T.format_params(F.col("params")).alias("params"),
        F.when(~F.isnan("silhouette"), F.col("silhouette")).alias("silhouette"),
        "n_clusters", "n_noise", "max_cluster_share",
    )
    log = trials.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda t: t.dropFields("trial_ord")).alias("trials"))
    return best.select(
        F.lit(source).alias("input"), F.lit(text_col).alias("text_col"), "algorithm", "params",
        F.round("silhouette", 6).alias("silhouette_score"), scoring.quality_flag(F.col("silhouette")).alias("quality"),
        "n_clusters", "n_noise", "target", "sweep_sample_size", F.col("dim_before").alias("dim_before_pca"),
        F.col("dim_after").alias("dim_after_pca"), F.col("max_noise_ratio").alias("max_noise_ratio_filter"),
        only_row(log)["trials"].alias("trials"),
    )


def run_digest(
    best: DataFrame, sizes: DataFrame, annotations: DataFrame | None = None, context: DataFrame | None = None,
    converged: bool = True,
) -> DataFrame:
    """One row of figures about a run, for advice.

    Coverage arrays have at most six entries and the label list fifteen, so the lists
    that are collected are short.
    """
    top = at_ranks(coverage(sizes), S.COVERAGE_RANKS)

    def points(column: str) -> Column:
        return F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("n"), F.col(column).alias("pct"))))

    covered = top.agg(
        points("cum_pct").alias("coverage_top_n"), points("cum_pct_clustered").alias("coverage_top_n_ex_noise")
    )
    largest = sizes.where(~is_noise()).orderBy(F.desc("size"), "cluster_id").limit(S.TOP_LABELS)
    if annotations is None:
        largest = largest.withColumn("label", F.lit(None).cast("string"))
    else:
        largest = largest.join(annotations.select("cluster_id", "label"), "cluster_id", "left")
    number = F.concat(F.lit("Cluster #"), F.col("cluster_id").cast("string"))
    labelled = largest.select(
        F.struct((-F.col("size")).alias("o"), "cluster_id", F.coalesce("label", number).alias("label"), "size").alias("s")
    ).agg(
        F.transform(F.array_sort(F.collect_list("s")), lambda s: F.struct(s["label"].alias("label"), s["size"].alias("size"))).alias(
            "top_cluster_labels"
        )
    )
    totals = total_rows(sizes).select("total_rows", "noise_rows", "largest")
    hint = F.struct(F.lit("").alias("domain"), F.lit("").alias("granularity_hint"))
    if context is not None:
        hint = only_row(context.select("domain", "granularity_hint"))
    whole = F.col("totals.total_rows")
    return best.select(
        "*", only_row(totals).alias("totals"), only_row(covered).alias("covered"),
        only_row(labelled)["top_cluster_labels"].alias("top_cluster_labels"), hint.alias("hint"),
    ).select(
        "target", "algorithm", T.format_params(F.col("params")).alias("params_text"), "silhouette", "n_clusters", "n_noise",
        whole.alias("total_rows"),
        F.when(whole > 0, F.col("n_noise") * 100.0 / whole).otherwise(0.0).alias("noise_ratio_pct"),
        F.when(whole > 0, F.col("totals.largest") * 100.0 / whole).otherwise(0.0).alias("max_share_pct"),
        "covered.coverage_top_n", "covered.coverage_top_n_ex_noise", "top_cluster_labels",
        F.col("hint.domain").alias("dataset_domain"), F.col("hint.granularity_hint").alias("dataset_hint"),
        F.lit(converged).alias("dedup_converged"),
    )


def digest_text(digest: DataFrame) -> DataFrame:
    """One row `block`: what an adviser must know about a run, as `name: value` lines.

    Lists are cut nowhere: a digest has at most six coverage ranks and fifteen labels. Figures that a run does
    not have (no labels, no clusters) give no line.
    """
    purposes = F.create_map(*[F.lit(x) for item in S.TARGET_PURPOSES.items() for x in item])
    ranks = F.arrays_zip(
        F.col("coverage_top_n.n").alias("n"), F.col("coverage_top_n.pct").alias("a"), F.col("coverage_top_n_ex_noise.pct").alias("c")
    )
    covered = F.transform(ranks, lambda r: F.format_string("%d -> %.1f / %.1f", r["n"], r["a"], r["c"]))
    names = F.transform("top_cluster_labels", lambda t: F.format_string("%s [%d]", t["label"], t["size"]))
    listed = lambda name, values: F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: "), F.array_join(values, "; ")))
    lines = [
        F.format_string("aim: %s", F.coalesce(purposes[F.col("target")], F.col("target"))),
        F.format_string("rows: %d, in clusters: %d", "total_rows", F.col("total_rows") - F.col("n_noise")),
        F.format_string("clusters: %d by %s (%s), silhouette %.3f", "n_clusters", "algorithm", "params_text", "silhouette"),
        F.format_string("percent of rows: noise %.1f, largest cluster %.1f", "noise_ratio_pct", "max_share_pct"),
        listed("largest clusters -> percent of all / of clustered rows", covered),
        listed("labels [rows]", names),
        F.when(~F.col("dedup_converged"), F.lit("some labels are shared by several clusters")),
        F.when(F.col("dataset_domain") != "", F.format_string("domain: %s", "dataset_domain")),
        F.when(F.col("dataset_hint") != "", F.format_string("wanted detail: %s", "dataset_hint")),
    ]
    return digest.select(F.concat_ws("\n", *lines).alias("block"))
