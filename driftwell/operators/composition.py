"""What the sample table is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def availability_totals(stream: DataFrame) -> DataFrame:
    """One row: counts of all, available and unavailable samples with their shares."""
    n = F.count(F.lit(1))
    a = F.count_if(F.col("available") == 1)
    share = F.greatest(n, F.lit(1)).cast("double")
    return stream.agg(
        n.alias("total_rows"), a.alias("available_rows"), (n - a).alias("unavailable_rows"),
        (a / share).alias("available_share"), ((n - a) / share).alias("unavailable_share"),
    )


def persona_counts(stream: DataFrame) -> DataFrame:
    return stream.filter(F.col("persona").isNotNull()).groupBy("persona").agg(
        F.count(F.lit(1)).alias("all_samples"), F.count_if(F.col("available") == 1).alias("available_samples")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, most frequent first."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def first_rounds(per_round: DataFrame, n: int = 10) -> DataFrame:
    return per_round.orderBy("round_id").limit(n)
