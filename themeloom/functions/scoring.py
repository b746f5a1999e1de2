"""Score expressions for column candidates and clustering trials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom import settings as S

NUMERIC = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf(inity)?)\s*$"


def looks_numeric(c: Column) -> Column:
    return c.rlike(NUMERIC)


def id_penalty(unique_ratio: Column) -> Column:
    """Columns whose values hardly repeat look like identifiers."""
    return F.when(unique_ratio >= 0.9, 0.3).when(unique_ratio >= 0.8, 0.6).otherwise(1.0)


def candidate_score(avg_length: Column, non_empty_ratio: Column, unique_ratio: Column) -> Column:
    return avg_length * non_empty_ratio * (0.5 + 0.5 * unique_ratio) * id_penalty(unique_ratio)


def quality_flag(silhouette: Column) -> Column:
    return F.when(silhouette >= S.SCORE_GOOD, "good").when(silhouette >= S.SCORE_WARN, "warn").otherwise("poor")


def quality_label(flag: Column) -> Column:
    pairs = [F.lit(x) for item in S.QUALITY_LABELS.items() for x in item]
    return F.create_map(*pairs)[flag]


def _by_target(target: Column | str, value) -> Column:
    """Pick `value(range, budget)` of the named target; a column may name a different one per row."""
    if isinstance(target, str):
        return value(*S.TARGETS[target])
    branches = [(target == name, value(*profile)) for name, profile in S.TARGETS.items()]
    first, *rest = branches
    return reduce(lambda chain, branch: chain.when(*branch), rest, F.when(*first))


def granularity_fit(n_clusters: Column, target: Column | str) -> Column:
    def fit(span, _budget):
        if span is None:
            return F.lit(1.0)
        low, high = span
        above = F.greatest(F.lit(0.3), 1.0 - (n_clusters - high) / (2.5 * high))
        return (
            F.when(n_clusters < low, F.greatest(F.lit(0.1), n_clusters / low))
            .when(n_clusters > high, above)
            .otherwise(1.0)
        )

    return _by_target(target, fit)


def share_penalty(share: Column, target: Column | str) -> Column:
    def penalty(_span, budget):
        return F.when(share <= budget, 1.0).otherwise(F.greatest(F.lit(0.2), 1.0 - 3.0 * (share - budget)))

    return _by_target(target, penalty)


def target_score(silhouette: Column, n_clusters: Column, share: Column, target: Column | str) -> Column:
    base = F.greatest(F.coalesce(silhouette, F.lit(0.0)), F.lit(S.SILHOUETTE_FLOOR))
    return base * granularity_fit(n_clusters, target) * share_penalty(share, target)
