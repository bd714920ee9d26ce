"""Writing samples per round and client, and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell import fixed_values as fv
from driftwell.functions.text import to_one_line
from driftwell.operators.availability import round_key
from driftwell.operators.normalize import label_column, prompt_column

EXPORT_COLUMNS = ["prompt", "text", "label", "timestamp", "persona", "region"]


def client_round_rows(df: DataFrame) -> DataFrame:
    """The export columns plus ``round_id`` and ``client_id``."""
    time = "timestamp" if "timestamp" in df.columns else "ts"
    return df.select(
        F.col(round_key(df)).alias("round_id"), "client_id", prompt_column(df).alias("prompt"), "text",
        label_column(df, fv.EXPORT_LABEL_COLUMNS).alias("label"), F.col(time).alias("timestamp"), "persona", "region",
    )


def planned_files(df: DataFrame, keys: Sequence[str], max_rows_per_file: int) -> DataFrame:
    """``df`` dealt out so that each group of ``keys`` is written as one file, and one of more than
    ``max_rows_per_file`` rows as so many files as that takes, of about the same size.

    Only the groups that are too large are looked up; each of their parts goes to a task of its own, and the
    other groups are hashed to tasks whole. Rows find their part by their content, so a task that
    is run again writes the same rows.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows_per_file)
    large = sizes.select(*keys, F.ceil(F.col("_n") / max_rows_per_file).cast("int").alias("_parts"))
    most = large.agg(F.max("_parts")).first()[0] or 1
    tasks = max(most, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = F.coalesce("_parts", F.lit(1)) if most > 1 else F.lit(1)
    placed = df.join(large, keys, "left") if most > 1 else df
    part = F.pmod(F.xxhash64(*df.columns), parts)
    return placed.repartitionById(tasks, F.pmod(F.xxhash64(*keys) % tasks + part, F.lit(tasks)).cast("int")).select(*df.columns)


def export_client_rounds(df: DataFrame, path: str, fmt: str = "csv", max_rows_per_file: int = 1_000_000, one_line: bool = False) -> None:
    """One folder per round and client with one file, or several where there are more rows than a file may have.
    ``one_line`` as in :func:`write_table`."""
    keys = ["round_id", "client_id"]
    spread = planned_files(client_round_rows(df), keys, max_rows_per_file).sortWithinPartitions(*keys, "timestamp")
    if one_line:
        spread = strings_on_one_line(spread, keys)
    writer = spread.write.mode("overwrite").partitionBy(*keys).format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, escape='"', quoteAll=True)
    writer.save(path)


def strings_on_one_line(df: DataFrame, but: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({c: to_one_line(F.col(c)) for c, t in df.dtypes if t == "string" and c not in but})


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, one_line: bool = False) -> None:
    """``one_line`` replaces line breaks in strings by codes, so that large CSV files can be read
    by many tasks; read such files with ``one_line`` too."""
    if one_line:
        df = strings_on_one_line(df, partition_by or ())
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, escape='"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
