"""Spells without any available client, and what they do to a metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.missing import known

#: A mean of equal values may differ from them in its last digits, by the order of its sum; less than this share is no difference.
EQUAL = 1e-12


def suppression_windows(availability: DataFrame, min_absent_rounds: int = 2, group: str = "persona") -> DataFrame:
    """``group, window_start, window_end`` of the runs of rounds without an available client
    that are long enough and have ended. A group has one row per round once summed up."""
    per_round = (
        availability.filter(F.col(group).isNotNull()).groupBy(group, "round_id").agg(F.sum("available").alias("_a"))
    )
    ahead = Window.partitionBy(group).orderBy("round_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        per_round.withColumn("_next", F.min(F.when(F.col("_a") > 0, F.col("round_id"))).over(ahead))
        .filter((F.col("_a") == 0) & F.col("_next").isNotNull())
        .groupBy(group, "_next").agg(F.min("round_id").alias("window_start"))
        .filter(F.col("_next") - F.col("window_start") >= min_absent_rounds)
        .select(group, "window_start", (F.col("_next") - 1).alias("window_end"))
    )


def windows_between(active: DataFrame, min_absent_rounds: int = 2, group: str = "persona", first: int = 0) -> DataFrame:
    """The same from the rounds in which a group was there at all, ``group, round_id``, where it could have been
    in every round from ``first`` on. Rounds of absence have no rows, so the work is that of the presence."""
    there = active.filter(F.col(group).isNotNull() & (F.col("round_id") >= first))
    rounds = there.groupBy(group).agg(F.array_sort(F.collect_set("round_id")).alias("_r"))
    before = F.concat(F.array(F.lit(first - 1)), F.slice("_r", 1, F.size("_r") - 1))
    spells = rounds.select(group, F.inline(F.arrays_zip(before.alias("a"), F.col("_r").alias("b"))).alias("_a", "_b"))
    return spells.filter(F.col("_b") - F.col("_a") - 1 >= F.greatest(F.lit(min_absent_rounds), F.lit(1))).select(
        group, (F.col("_a") + 1).alias("window_start"), (F.col("_b") - 1).alias("window_end")
    )


def suppression_effect(
    windows: DataFrame, history: DataFrame, group: str = "persona", metric: str = "perplexity", by: Sequence[str] = ()
) -> DataFrame:
    """Mean of the metric before, during and after each window, and how many rounds after it
    the metric was first no worse than before. A value that equals the mean but for the order of its sum is no worse.

    A history holds few rows per group and round, so it travels as one array per group and no
    (window, round) pairs are laid out.
    """
    keys = [*by, group]
    m = known(F.col(metric))
    series = history.groupBy(*keys, "round").agg(F.sum(m).alias("_s"), F.count(m).alias("_n"), F.min(m).alias("_min"))
    packed = series.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("round", "_s", "_n", "_min"))).alias("_h")
    )
    if by:
        # Every window for every method that has a history of the group.
        joined = packed.join(windows, group)
    else:
        joined = windows.join(packed, group, "left")

    def mean(keep) -> Column:
        part = F.filter("_h", keep)
        total = F.aggregate(part, F.lit(0.0), lambda a, x: a + F.coalesce(x["_s"], F.lit(0.0)))
        n = F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x["_n"])
        return total / F.nullif(n, F.lit(0))

    start, end = F.col("window_start"), F.col("window_end")
    out = joined.withColumns(
        {
            "pre_window_metric": mean(lambda x: x["round"] < start),
            "during_window_metric": mean(lambda x: (x["round"] >= start) & (x["round"] <= end)),
            "post_window_metric": mean(lambda x: x["round"] > end),
        }
    )
    bound = F.col("pre_window_metric") + F.abs("pre_window_metric") * F.lit(EQUAL)
    first_good = F.get(F.filter("_h", lambda x: (x["round"] > end) & (x["_min"] <= bound)), F.lit(0))["round"]
    return out.withColumn("recovery_rounds", (first_good - end).cast("int")).select(
        *keys, "window_start", "window_end", "pre_window_metric", "during_window_metric", "post_window_metric",
        "recovery_rounds",
    )


def presence(rows: DataFrame) -> DataFrame:
    """``persona, region, round_id, available, n``: sums that stand for the rows in both functions here."""
    return rows.groupBy("persona", "region", "round_id").agg(F.sum("available").alias("available"), F.count(F.lit(1)).alias("n"))


def modal_region(rows: DataFrame, default: str = "GLOBAL", weight: str | None = None) -> DataFrame:
    """Most frequent region per persona, ties to the smallest name."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = rows.filter(F.col("persona").isNotNull()).groupBy("persona", "region").agg(n.alias("_n"))
    best = F.min(F.when(F.col("region").isNotNull(), F.struct((-F.col("_n")).alias("n"), "region")))["region"]
    return counts.groupBy("persona").agg(F.coalesce(best, F.lit(default)).alias("region"))
