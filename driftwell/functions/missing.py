"""Missing metric values are NULL here, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(c: Column) -> Column:
    """NULL instead of NaN, so that aggregates skip the value."""
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def perplexity(nll: Column) -> Column:
    """exp of the mean loss, with the loss capped at 20."""
    n = known(nll)
    return F.when(n.isNotNull(), F.exp(F.least(n, F.lit(20.0))))


def jain_index(x: Column) -> Column:
    """Aggregate: Jain's fairness index of the known values, NULL if they are all zero."""
    v = known(x)
    return F.pow(F.sum(v), F.lit(2.0)) / F.nullif(F.count(v) * F.sum(v * v), F.lit(0.0))
