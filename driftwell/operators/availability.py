"""When clients are available, and samples of available clients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell import fixed_values as fv
from driftwell.operators.normalize import first_existing


def expected_availability(timezone_group: Column, round_id: Column, num_rounds: int) -> Column:
    """Chance by time zone and simulated hour; the rounds span one day."""
    hour = (round_id * F.lit(24.0) / F.lit(float(max(1, num_rounds)))) % F.lit(24.0)
    out = None
    for group, lo, hi in fv.LIKELY_HOURS:
        p = F.when(hour.between(float(lo), float(hi)), F.lit(fv.LIKELY)).otherwise(F.lit(fv.UNLIKELY))
        out = F.when(timezone_group == group, p) if out is None else out.when(timezone_group == group, p)
    return out.otherwise(F.lit(fv.ALWAYS))


def event_round(ts: Column, start: str, hours: int) -> Column:
    """Number of the ``hours``-long round since ``start`` (a full hour) that a time falls into."""
    begin = F.lit(start).cast("timestamp_ntz")
    passed = F.date_diff(ts, begin) * F.lit(24) + F.hour(ts) - F.hour(begin)
    return F.floor(passed / F.lit(hours)).cast("int")


def observed_activity(events: DataFrame, start: str, hours: int, num_rounds: int | None = None) -> DataFrame:
    """Distinct (client_id, round_id) with at least one event in the rounds of the study."""
    seen = events.select(F.col("user_id").alias("client_id"), event_round(F.col("ts"), start, hours).alias("round_id"))
    if num_rounds is not None:
        seen = seen.filter(F.col("round_id").between(0, num_rounds - 1))
    return seen.distinct()


def bounded_probability(timezone_group: Column, round_id: Column, share: Column, num_rounds: int) -> Column:
    """The expected availability scaled by the client's share of active rounds, within bounds."""
    lo, hi = fv.PROBABILITY_RANGE
    p = expected_availability(timezone_group, round_id, num_rounds) * F.coalesce(share, F.lit(0.0))
    return F.greatest(F.lit(lo), F.least(F.lit(hi), p))


def lookup_availability(samples: DataFrame, activity: DataFrame, num_rounds: int) -> DataFrame:
    """What a join with the dense grid would give, from the sparse activity: the grid of all
    clients and rounds is never laid out. ``samples`` carry ``timezone_group``, null without a
    client."""
    key = round_key(samples)
    seen = activity.select("client_id", F.col("round_id").alias(key), F.lit(1).alias("available"))
    share = activity.groupBy("client_id").agg((F.count(F.lit(1)) / F.lit(float(num_rounds))).alias("_share"))
    joined = samples.join(seen, ["client_id", key], "left").join(share, "client_id", "left")
    p = bounded_probability(F.col("timezone_group"), F.col(key), F.col("_share"), num_rounds)
    return joined.withColumns({
        "available": F.coalesce("available", F.lit(0)).cast("int"),
        "availability_probability": F.when(F.col("timezone_group").isNotNull(), p),
    }).drop("_share")


def availability_matrix(clients: DataFrame, activity: DataFrame, num_rounds: int) -> DataFrame:
    """Dense client x round grid: seen or not, and the chance of being seen, which is the
    expected availability scaled by the client's share of active rounds, within bounds."""
    # The share comes from the sparse activity, before the grid is unfolded.
    share = activity.groupBy("client_id").agg(
        (F.count(F.lit(1)) / F.lit(float(num_rounds))).alias("_share"), F.collect_set("round_id").alias("_seen")
    )
    # A few clients become many rows, so they are spread over all tasks first, by a key that the join has not put in few.
    tasks = int(clients.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = clients.join(share, "client_id", "left").repartition(tasks, F.xxhash64("client_id")).withColumn(
        "round_id", F.explode(F.sequence(F.lit(0), F.lit(num_rounds - 1)))
    )
    p = bounded_probability(F.col("timezone_group"), F.col("round_id"), F.col("_share"), num_rounds)
    return grid.select(
        "client_id", "persona", "region", "timezone_group", "round_id", F.col("round_id").alias("round"),
        p.alias("availability_probability"), p.alias("availability_prob"),
        F.coalesce(F.array_contains("_seen", F.col("round_id")), F.lit(False)).cast("int").alias("available"),
    )


def round_key(df: DataFrame) -> str:
    return "round_id" if "round_id" in df.columns else "round"


def attach_availability(samples: DataFrame, availability: DataFrame) -> DataFrame:
    """Left join on client and round; a missing entry means not available."""
    key = round_key(samples)
    cols = [c for c in ("available", "availability_probability") if c in availability.columns]
    side = availability.select("client_id", key, *cols)
    joined = samples.drop(*cols).join(side, ["client_id", key], "left")
    return joined.withColumn("available", F.coalesce(F.col("available"), F.lit(0)).cast("int"))


def split_by_availability(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    return stream.filter(F.col("available") == 1), stream.filter(F.col("available") == 0)


def resolve_available(df: DataFrame, candidates: Sequence[str] = fv.AVAILABLE_COLUMNS) -> DataFrame:
    """``available`` from whichever variant a join left behind, 0 if there is none."""
    name = first_existing(df, candidates)
    value = F.coalesce(F.col(name).cast("int"), F.lit(0)) if name else F.lit(0)
    return df.withColumn("available", value)


def rejoin_availability(full: DataFrame, availability: DataFrame) -> DataFrame:
    """Join availability to a table that may carry such a column already (it then wins)."""
    side = availability.select(
        "client_id", "round_id",
        *[
            F.col(c).alias(f"{c}_avail" if c in full.columns else c)
            for c in ("available", "availability_probability")
        ],
    )
    return resolve_available(full.join(side, ["client_id", "round_id"], "left"))


def client_round_tuples(df: DataFrame) -> DataFrame:
    return df.select("client_id", "round_id", "available", "persona", "region").distinct()


def client_round_max(df: DataFrame) -> DataFrame:
    """One row per client and round: the largest flag, unreadable ones count as 0."""
    flag = F.coalesce(F.expr("try_cast(cast(available as string) as double)"), F.lit(0.0))
    return df.groupBy("client_id", "round_id").agg(F.max(flag).alias("available"))


def available_per_round(df: DataFrame) -> DataFrame:
    return df.groupBy("round_id").agg(F.sum("available").cast("bigint").alias("available_clients"))


def availability_heatmap(df: DataFrame, num_rounds: int) -> DataFrame:
    """One row per client, one column per round; the caller names the number of rounds, so no
    extra job looks for them."""
    wide = client_round_max(df).groupBy("client_id").pivot("round_id", list(range(num_rounds))).max("available")
    return wide.select("client_id", *[F.coalesce(F.col(f"`{r}`"), F.lit(0.0)).alias(f"r{r}") for r in range(num_rounds)])


def mean_by_timezone(availability: DataFrame) -> DataFrame:
    return (
        availability.groupBy("timezone_group").agg(F.avg("available").alias("mean_available"))
        .orderBy("mean_available", "timezone_group")
    )
