"""Templated rows over a topic table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell import fixed_values as fv
from driftwell.operators.normalize import fill


def topic_table(spark: SparkSession, topics: list[str] = fv.PRIOR_TOPICS) -> DataFrame:
    return spark.createDataFrame(list(enumerate(topics)), "topic_no int, topic string")


def prior_corpus(topics: DataFrame) -> DataFrame:
    """One generic text per topic. ``topics`` holds ``topic_no, topic``."""
    return topics.select(
        "topic", F.lit("neutral").alias("label"), fill(fv.PRIOR_TEXT, topic=F.col("topic")).alias("text"),
        F.lit(fv.PRIOR_SOURCE).alias("source"), F.col("topic_no").alias("prior_id"),
    )


def prompt_grid(topics: DataFrame, days: int, samples: int, now: str, num_topics: int) -> DataFrame:
    """Every topic asked ``samples`` times for each of ``days`` days, newest first, one hour
    apart going back from ``now``."""
    cells = topics.withColumn("day_no", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn(
        "sample_no", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    )
    hours = F.col("day_no") * (num_topics * samples) + F.col("topic_no") * samples + F.col("sample_no")
    end = F.lit(now).cast("timestamp_ntz")
    day = F.date_format(end - F.expr("interval '1' day") * F.col("day_no"), "yyyy-MM-dd")
    return cells.select(
        "day_no", "topic_no", "sample_no", "topic",
        fill(fv.GRID_PROMPT, day=day, topic=F.col("topic")).alias("prompt"),
        (end - F.expr("interval '1' hour") * hours).alias("timestamp"),
    )
