"""Queries for whole jobs and for what they write and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import drift, normalize as nz
from driftwell.plans import checks_scoring as cs, datasets as ds, prepare as pr
from driftwell.plans.datasets import table
from driftwell.plans.registry import query
from driftwell.session import stored, work_path
from driftwell.sources import readers, writers


@query("b1_first_column", "SELECT doc_id, text AS picked, source AS other FROM documents")
def first_column(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.col("source").alias("output"), F.col("text").alias("headline"))
    picked, other = nz.first_existing(df, ["sentence", "headline", "output"]), nz.first_existing(df, ["target", "output"])
    return df.select("doc_id", F.col(picked).alias("picked"), F.col(other).alias("other"))


@query(
    "b4_prompt",
    """SELECT conv_id, turn, text AS prompt FROM conversations UNION ALL SELECT doc_id, -1, '' FROM documents""",
)
def prompt(spark, sf):
    given = table(spark, sf, "conversations").withColumnRenamed("text", "prompt")
    without = table(spark, sf, "documents")
    return given.select("conv_id", "turn", nz.prompt_column(given).alias("prompt")).union(
        without.select("doc_id", F.lit(-1).cast("bigint"), nz.prompt_column(without))
    )


@query("b12_public_columns", "SELECT doc_id, text, source FROM documents")
def public_columns(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", "source", F.col("lang").alias("persona"), F.col("doc_id").alias("client_id"), F.lit(1).alias("available")
    )
    return nz.public_columns(docs)


@query(
    "d5_empty_drift_columns",
    """SELECT doc_id, '' AS drift_concept, CAST(NULL AS INTEGER) AS drift_first_round, '' AS drift_private_code, '' AS drift_answer,
      '' AS drift_sector FROM documents""",
)
def empty_drift_columns(spark, sf):
    return drift.empty_drift_columns(table(spark, sf, "documents").select("doc_id"))


@query("a2_csv_round_trip", "SELECT doc_id, text, lang, n_chars FROM documents")
def csv_round_trip(spark, sf):
    path = work_path(spark, "csv")
    writers.write_table(table(spark, sf, "documents"), path, "csv")
    return readers.read_typed_csv(spark, path, "doc_id bigint, text string, lang string, n_chars bigint")


@query(
    "a2_csv_one_line",
    r"""SELECT doc_id, text || chr(10) || '\n \s' || chr(13) || '\\"' AS text, lang, n_chars FROM documents""",
)
def csv_one_line(spark, sf):
    """The same in files that many tasks can share, with line breaks, quotes and backslashes in every text."""
    path = work_path(spark, "csv")
    odd = F.concat("text", F.lit("\n\\n \\s\r\\\\\""))
    writers.write_table(table(spark, sf, "documents").withColumn("text", odd), path, "csv", one_line=True)
    return readers.read_typed_csv(spark, path, "doc_id bigint, text string, lang string, n_chars bigint", one_line=True)


@query("a6_table_round_trip", "SELECT event_id, ts, user_id, event_type, value FROM events")
def table_round_trip(spark, sf):
    path = work_path(spark, "table")
    writers.write_table(table(spark, sf, "events").repartition("event_type"), path, "parquet", ["event_type"])
    return spark.read.parquet(path).select("event_id", "ts", "user_id", "event_type", "value")


@query(
    "a5_export_round_trip",
    f"""WITH {ds.SQL_STREAM} SELECT round_id, client_id, text, label, CAST(ts AS VARCHAR) AS timestamp, persona, region
    FROM stream WHERE available = 1""",
)
def export_round_trip(spark, sf):
    path = work_path(spark, "export")
    # Stored, since the export counts the rows of each folder before it writes them.
    writers.export_client_rounds(stored(ds.stream(spark, sf).filter("available = 1"), "available"), path)
    schema = "prompt string, text string, label string, timestamp timestamp_ntz, persona string, region string, round_id int, client_id bigint"
    back = readers.read_client_rounds(spark, path, schema)
    return back.select("round_id", "client_id", "text", "label", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "persona", "region")


def prepared(spark, sf) -> pr.Prepared:
    """Documents, one in nine without a text, through the whole prepare job."""
    text = F.when(F.col("doc_id") % 9 != 4, F.col("text"))
    raw = table(spark, sf, "documents").select("doc_id", text.alias("text"), F.col("source").alias("label"))
    return pr.prepare(raw, "doc_id", ds.clients(spark, sf), ds.availability(spark, sf), ds.EVENT_ROUNDS, ds.PERSONAS, ds.CONCEPTS, ds.NOW, activity=ds.activity(spark, sf))


def sql_prepared() -> str:
    """The stream over documents of which one in nine has no text."""
    sql = cs.SQL_DRIFT_STREAM.replace("FROM documents", "FROM (SELECT * REPLACE (CASE WHEN doc_id % 9 <> 4 THEN text END AS text) FROM documents)", 1)
    return sql.replace("contains(lower(text), ", "contains(lower(coalesce(text, '')), ")


SHOWN = "sample_id, md5(text) AS text, label, round_id, persona, client_id, persona_client, available, round(availability_probability, 9) AS availability_probability, drift_concept, drift_first_round"


@query("prepare_full", f"WITH {sql_prepared()} SELECT {SHOWN} FROM drifted")
def prepare_full(spark, sf):
    out = work_path(spark, "prepared")
    pr.write_prepared(prepared(spark, sf), out, export=False)
    full = pr.read_prepared(spark, out)
    return full.selectExpr(*SHOWN.split(", ")[:8], "round(availability_probability, 9) AS availability_probability", "drift_concept", "drift_first_round")


@query(
    "prepare_tables",
    f"""WITH {sql_prepared()} SELECT 'available' AS name, count(*) AS rows FROM drifted WHERE available = 1
    UNION ALL SELECT 'unavailable', count(*) FROM drifted WHERE available = 0
    UNION ALL SELECT 'manifest ' || drift_concept || ' ' || drift_first_round, count(DISTINCT drift_concept) FROM drifted
      WHERE drift_concept <> '' GROUP BY drift_concept, drift_first_round
    UNION ALL SELECT 'clients', count(*) FROM people UNION ALL SELECT 'availability', count(*) FROM grid""",
)
def prepare_tables(spark, sf):
    """The other tables of the prepare job, as written."""
    out = work_path(spark, "prepared")
    pr.write_prepared(prepared(spark, sf), out, export=False)
    counted = {"available": "available_train_dataset", "unavailable": "unavailable_train_dataset", "clients": "client_metadata", "availability": "availability_matrix"}
    parts = [spark.read.parquet(f"{out}/metadata/{p}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, p in counted.items()]
    manifest = spark.read.parquet(f"{out}/metadata/semantic_drift_manifest")
    parts.append(manifest.select(F.concat(F.lit("manifest "), "drift_concept", F.lit(" "), "drift_first_round").alias("name"), F.lit(1).cast("bigint").alias("rows")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole
