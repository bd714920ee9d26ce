"""Global time order and equal-frequency rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.session import durable

_TASK_ROWS_BITS = 33  # monotonically_increasing_id() keeps the task number above these bits


def global_positions(df: DataFrame, order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """The ``order`` columns with the 0-based position of each row in their total order, and
    ``total_rows``.

    ``order`` must identify a row, so give a unique id last. Sorting by the whole key spreads
    even a timestamp shared by a third of the rows over many tasks. The sorted keys are kept
    durably because the row count per task and the place within the task must come from one
    and the same split.
    """
    ordered = df.select(*order).orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    ordered = durable(ordered).select(
        *order,
        F.shiftright("_at", _TASK_ROWS_BITS).alias("_task"),
        F.col("_at").bitwiseAND(F.lit((1 << _TASK_ROWS_BITS) - 1)).alias("_place"),
    )
    # One row per sort task; the only window without partitions in this library.
    per_task = ordered.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    offsets = per_task.select(
        "_task",
        (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("total_rows"),
    )
    return ordered.join(F.broadcast(offsets), "_task").select(
        *order, (F.col("_before") + F.col("_place")).alias(name), "total_rows"
    )


def with_position(df: DataFrame, order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """``df`` plus its position; only the key columns are sorted, the rest moves once."""
    at = global_positions(df, order, name)
    return df.join(at.drop(*order[:-1]), order[-1])


def quantile_round(num_rounds: int, position: str = "row_idx", total: str = "total_rows") -> Column:
    """Round of a position when ``total`` positions are cut into equal-frequency rounds.

    The edges lie at quantiles of 0..total-1, right-inclusive, so this is not ``ntile``; fewer
    rows than rounds leave gaps in the ids.
    """
    return F.expr(
        f"cast(greatest(({position} * {num_rounds}L + {total} - 2) "
        f"div greatest({total} - 1, 1L) - 1, 0L) as int)"
    )


def add_temporal_rounds(
    df: DataFrame, num_rounds: int, ts: str = "ts", key: str = "sample_id"
) -> DataFrame:
    """Add ``row_idx``, ``round_id`` and its alias ``round`` by time order, ties by ``key``."""
    return add_rounds_by_position(with_position(df, [ts, key]), num_rounds)


def add_rounds_by_position(df: DataFrame, num_rounds: int) -> DataFrame:
    """The same cut for rows that already carry ``row_idx`` and ``total_rows``."""
    rid = quantile_round(num_rounds)
    return df.withColumn("round_id", rid).withColumn("round", F.col("round_id")).drop("total_rows")


def round_edges(df: DataFrame, num_rounds: int, order: Sequence[str]) -> DataFrame:
    """First key of every round: at most ``num_rounds`` rows."""
    return (
        global_positions(df, order)
        .groupBy(quantile_round(num_rounds).alias("round_id"))
        .agg(F.min(F.struct(*order)).alias("edge"))
        .select("round_id", *[F.col(f"edge.{c}") for c in order])
    )


def assign_rounds_by_edges(
    df: DataFrame, num_rounds: int, order: Sequence[str], keys: DataFrame | None = None
) -> DataFrame:
    """``round_id`` without moving ``df``: the at most ``num_rounds`` edges become a literal
    and every row finds its round in place. Use it when the position itself is not needed.
    ``keys`` may give the ``order`` columns of ``df`` from a cheaper scan."""
    edges = (
        round_edges(df if keys is None else keys, num_rounds, order)
        .select("round_id", *[F.col(c).cast("string") for c in order])
        .collect()
    )
    return df.withColumn("round_id", _find_round(df, edges, order)).withColumn("round", F.col("round_id"))


def _find_round(df: DataFrame, edges: Sequence, order: Sequence[str]) -> Column:
    """Nested comparisons that halve the edges at each step."""
    if not edges:
        return F.lit(None).cast("int")
    edges = sorted(edges, key=lambda e: e["round_id"])
    here = F.struct(*order)

    def at(e) -> Column:
        return F.struct(*[F.lit(e[c]).cast(df.schema[c].dataType).alias(c) for c in order])

    def within(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(edges[lo]["round_id"])
        mid = (lo + hi) // 2
        return F.when(here < at(edges[mid]), within(lo, mid)).otherwise(within(mid, hi))

    return within(0, len(edges))
