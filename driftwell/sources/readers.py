"""Reading tables, raw sources and JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell import fixed_values as fv
from driftwell.functions.text import from_one_line
from driftwell.sources.writers import EXPORT_COLUMNS


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, one_line: bool = False, **options) -> DataFrame:
    """A dataset of any format Spark reads. Give CSV and JSON a schema: inferring one costs a
    pass over the data. CSV may hold line breaks, so one task reads a file; ``one_line`` says that it
    was written without (:func:`~driftwell.sources.writers.write_table`), and many tasks share a file."""
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        # Texts hold line breaks and quotes.
        reader = reader.options(header=True, multiLine=not one_line, escape='"').options(**options)
    read = (reader.schema(schema) if schema is not None else reader).load(path)
    return read.withColumns({c: from_one_line(F.col(c)) for c, t in read.dtypes if t == "string"}) if one_line else read


FULL_DATASET_SCHEMA = (
    "sample_id bigint, prompt string, text string, label string, timestamp timestamp_ntz, persona string, "
    "client_id string, persona_client string, region string, timezone_group string, round_id int, round int, "
    "drift_concept string, drift_first_round int, drift_private_code string, drift_answer string, drift_sector string, "
    "available int, availability_probability double"
)
AVAILABILITY_SCHEMA = (
    "client_id string, round_id int, round int, availability_probability double, availability_prob double, available int"
)


def read_typed_csv(spark: SparkSession, path: str, schema: str, one_line: bool = False) -> DataFrame:
    """Columns of ``schema`` that the files have, found by name whatever their order."""
    return _typed(read_table(spark, path, "csv", one_line=one_line), schema)


def _typed(raw: DataFrame, schema: str) -> DataFrame:
    fields = T.StructType.fromDDL(schema).fields
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields if f.name in raw.columns])


def read_client_rounds(spark: SparkSession, path: str, schema: str, one_line: bool = False) -> DataFrame:
    """What ``export_client_rounds`` wrote as CSV, with the columns and types of ``schema``. The names and their order are known, so
    no file is looked for to read them from: that would list all files, one per round and client, once more."""
    folders = [f for f in T.StructType.fromDDL(schema).fields if f.name not in EXPORT_COLUMNS]
    columns = T.StructType([*[T.StructField(c, T.StringType()) for c in EXPORT_COLUMNS], *folders])
    return _typed(read_table(spark, path, "csv", columns, one_line), schema)


def read_full_dataset(spark: SparkSession, path: str, schema: str = FULL_DATASET_SCHEMA, one_line: bool = False) -> DataFrame:
    """The prepared samples from CSV; empty strings come back as missing and are restored."""
    df = read_typed_csv(spark, path, schema, one_line)
    empty = [c for c in ("prompt", "drift_concept", "drift_private_code", "drift_answer", "drift_sector") if c in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in empty})


def source_bodies(requested: DataFrame, loaded: DataFrame, max_chars: int | None = None) -> DataFrame:
    """``source_url, text``: every requested body (its first ``max_chars`` characters if given),
    or an error row where nothing was loaded. ``requested`` holds ``source_url``, ``loaded``
    holds ``url, body``."""
    body = F.col("body") if max_chars is None else F.substring("body", 1, max_chars)
    start = loaded.select(F.col("url").alias("source_url"), body.alias("_start"))
    return requested.join(start, "source_url", "left").select(
        "source_url", F.coalesce("_start", F.concat(F.lit(fv.SOURCE_ERROR), "source_url")).alias("text")
    )


def payload_rows(df: DataFrame, payload: str, row_schema: str, keep: list[str] | None = None) -> DataFrame:
    """Rows of JSON payloads: the elements of ``data`` if the payload has it, else the payload
    itself, be it one record or a list of them."""
    rows_of = T.ArrayType(T.StructType.fromDDL(row_schema))
    # An array schema also reads a single record.
    data = F.get_json_object(payload, "$.data")
    rows = F.from_json(F.coalesce(data, F.col(payload)), rows_of)
    return df.select(*(keep or []), F.inline(rows))


def json_field(column: str, path: str, dtype: str) -> Column:
    return F.get_json_object(column, path).cast(dtype)
