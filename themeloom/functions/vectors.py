"""Vector column expressions over `array<float>` or `array<double>`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit length as doubles; a zero vector becomes the first basis vector."""
    # The norm is bound once as a lambda variable, not worked out again per element.
    scaled = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]
    basis = F.transform(v, lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))
    return F.when(norm(v) == 0, basis).otherwise(scaled)
