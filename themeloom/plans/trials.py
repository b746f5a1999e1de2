"""The trial table of a sweep, and the choice of a winner."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom import settings as S
from themeloom.functions import scoring
from themeloom.operators.clusters import summarize_sizes
from themeloom.operators.silhouette import silhouettes


def stack_labels(sweeps: list[DataFrame]) -> DataFrame:
    """Label tables of one sweep as `trial_ord, row_id, cluster_id`, in trial order."""
    numbered = [
        labels.select(F.lit(i).alias("trial_ord"), "row_id", F.col("cluster_id").cast("int").alias("cluster_id"))
        for i, labels in enumerate(sweeps)
    ]
    return reduce(DataFrame.unionByName, numbered)


def trial_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("trial_ord", "cluster_id").agg(F.count(F.lit(1)).alias("size"))


def build_trials(vectors: DataFrame, labels: DataFrame, specs: DataFrame) -> DataFrame:
    """Counts, largest share and silhouette of every labelling, joined to `specs`.

    `specs` is `trial_ord, algorithm, params`; the labels themselves stay out.
    """
    counts = summarize_sizes(trial_sizes(labels), "trial_ord")
    scores = silhouettes(vectors, labels)
    return (
        specs.join(counts, "trial_ord")
        .join(scores, "trial_ord", "left")
        .select("trial_ord", "algorithm", "params", "silhouette", "n_clusters", "n_noise", "max_cluster_share")
    )


def has_score() -> Column:
    return F.col("silhouette").isNotNull() & (F.col("silhouette") > -1)


def noise_ratio(sample_size: Column | int) -> Column:
    return F.col("n_noise") / sample_size


def with_scores(trials: DataFrame, target: str) -> DataFrame:
    """Score under the run's target and under each target in turn."""

    def score(name: str) -> Column:
        return scoring.target_score(F.col("silhouette"), F.col("n_clusters"), F.col("max_cluster_share"), name)

    what_if = {f"{name}_score": score(name) for name in S.TARGETS}
    return trials.withColumns({"score": score(target), **what_if})


def select_winner(trials: DataFrame, sample_size: int | Column, target: str) -> DataFrame:
    """The best scored trial within the noise budget, or failing that the best scored one.

    One ordering does both: trials in budget come first. Ties go to the earlier trial.
    The result is empty when no trial has a score.
    """
    fits = (noise_ratio(sample_size) <= S.MAX_NOISE_RATIO).alias("in_budget")
    return (
        with_scores(trials, target)
        .where(has_score())
        .select("*", fits)
        .orderBy(F.desc("in_budget"), F.desc("score"), "trial_ord")
        .limit(1)
    )


def status(sample_size: Column | int) -> Column:
    """accepted, rejected_noise or rejected_degenerate; the last is tested first."""
    return (
        F.when(F.col("silhouette").isNull() | (F.col("n_clusters") < 2), "rejected_degenerate")
        .when(noise_ratio(sample_size) > S.MAX_NOISE_RATIO, "rejected_noise")
        .otherwise("accepted")
    )


def chart_ranks(trials: DataFrame) -> DataFrame:
    """Scored trials numbered by descending silhouette. A sweep has a few dozen trials."""
    order = Window.orderBy(F.desc("silhouette"), "trial_ord")
    return trials.where(F.col("silhouette").isNotNull()).withColumn("chart_rank", F.row_number().over(order))
