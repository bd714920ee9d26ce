"""Availability while events arrive: Structured Streaming over a folder of event files.

Every job takes new files when it runs and then stops (``availableNow``), so it can be scheduled; what it
has seen lies in its checkpoint folder, so a run after a crash or the next day goes on where the last one
ended and adds nothing twice. State is kept per client and round for as long as events may be
late, never for the whole history.

Late events: an event whose round began more than ``delay`` before the newest round seen by earlier
batches is left out of the live tables. :func:`add_missing` finds such rounds from the full log.
Events without a time are in no round and are left out, here and there.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwell.operators.availability import event_round, observed_activity

DELAY = "1 day"


def arriving(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet files of a folder, or those that a pattern names, and those that will be added."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def round_start(round_id: Column, start: str, hours: int) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + round_id.cast("bigint") * F.lit(hours * 3600))


def live_activity(events: DataFrame, start: str, hours: int, delay: str = DELAY) -> DataFrame:
    """``client_id, round_id, round_start``: each pair once, as soon as the first of its events arrives.

    A pair is remembered until the watermark has passed its round; events of such rounds are late.
    """
    seen = events.filter(F.col("ts").isNotNull()).select(F.col("user_id").alias("client_id"), event_round(F.col("ts"), start, hours).alias("round_id"))
    timed = seen.withColumn("round_start", round_start(F.col("round_id"), start, hours)).withWatermark("round_start", delay)
    return timed.dropDuplicates(["client_id", "round_id", "round_start"])


def live_counts(events: DataFrame, start: str, hours: int, delay: str = DELAY) -> DataFrame:
    """``client_id, round_id, events`` of closed rounds: a round is closed, and final, once an event came
    that is ``delay`` younger than its end. An event that is delivered again within ``delay`` counts once."""
    timed = events.filter(F.col("ts").isNotNull()).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    once = timed.dropDuplicatesWithinWatermark(["event_id"])
    # Windows begin at multiples of their length since 1970, shifted to the start of the study.
    seconds = int(datetime.fromisoformat(start).replace(tzinfo=timezone.utc).timestamp()) % (hours * 3600)
    counted = once.groupBy(F.window("at", f"{hours} hours", startTime=f"{seconds} seconds").alias("w"), F.col("user_id").alias("client_id"))
    number = event_round(F.col("w.start").cast("timestamp_ntz"), start, hours)
    return counted.agg(F.count(F.lit(1)).alias("events")).select("client_id", number.alias("round_id"), "events")


def follow(live: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Add what has arrived to the Parquet ``table``, and stop. The sink lists files of whole
    batches only, so a batch that is tried again counts once."""
    writer = live.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    job = writer.outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return job


def add_missing(live: DataFrame, events: DataFrame, start: str, hours: int) -> DataFrame:
    """Pairs of the full log that came too late for the live table, with the same columns."""
    known = events.filter(F.col("ts").isNotNull())
    full = observed_activity(known, start, hours).withColumn("round_start", round_start(F.col("round_id"), start, hours))
    seen = live.select(F.col("client_id").alias("_client"), F.col("round_id").alias("_round"))
    return full.join(seen, F.col("client_id").eqNullSafe(F.col("_client")) & (F.col("round_id") == F.col("_round")), "left_anti")
