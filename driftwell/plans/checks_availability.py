"""Queries for availability and composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import availability as av, composition as co
from driftwell.plans import datasets as ds
from driftwell.plans.datasets import table
from driftwell.plans.registry import query


@query(
    "e1_expected_availability",
    f"""WITH {ds.SQL_CLIENTS}, cells AS (SELECT client_id, timezone_group, CAST(r AS INTEGER) AS round_id FROM clients, range(50) t(r))
    SELECT client_id, round_id, {ds.sql_expected(50)} AS p FROM cells""",
)
def expected(spark, sf):
    cells = ds.clients(spark, sf).withColumn("round_id", F.explode(F.sequence(F.lit(0), F.lit(49))))
    return cells.select(
        "client_id", "round_id", av.expected_availability(F.col("timezone_group"), F.col("round_id"), 50).alias("p")
    )


@query(
    "e2_availability_matrix",
    f"""WITH {ds.SQL_GRID} SELECT client_id, round_id, round_id AS round, availability_probability,
      availability_probability AS availability_prob, available FROM grid""",
)
def matrix(spark, sf):
    return ds.availability(spark, sf).drop("persona", "region", "timezone_group")


@query(
    "e3_stream",
    f"WITH {ds.SQL_STREAM} SELECT sample_id, client_id, round_id, available, availability_probability FROM stream",
)
def stream(spark, sf):
    return ds.stream_facts(spark, sf).select("sample_id", "client_id", "round_id", "available", "availability_probability")


@query(
    "e4_split",
    f"WITH {ds.SQL_STREAM} SELECT sample_id, CASE WHEN available = 1 THEN 'available' ELSE 'unavailable' END AS part FROM stream",
)
def split(spark, sf):
    yes, no = av.split_by_availability(ds.stream_facts(spark, sf))
    return yes.select("sample_id", F.lit("available").alias("part")).unionByName(
        no.select("sample_id", F.lit("unavailable").alias("part"))
    )


@query("e5_rejoined", f"WITH {ds.SQL_STREAM} SELECT sample_id, available FROM stream")
def rejoined(spark, sf):
    # Clients and rounds without an event have no row: the join reads them as not available.
    seen = ds.activity(spark, sf).select("*", F.lit(1).alias("available"), F.lit(None).cast("double").alias("availability_probability"))
    return av.rejoin_availability(ds.sample_facts(spark, sf), seen).select("sample_id", "available")


@query("e6_client_round_tuples", f"WITH {ds.SQL_STREAM} SELECT DISTINCT client_id, round_id, available, persona, region FROM stream")
def tuples(spark, sf):
    return av.client_round_tuples(ds.stream_facts(spark, sf))


RAW_FLAGS = """raw AS (SELECT user_id AS client_id, CAST(date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) // 6 AS INTEGER) AS round_id,
  CASE event_type WHEN 'error' THEN 'n/a' WHEN 'view' THEN '0' ELSE '1' END AS available FROM events)"""


def _raw_flags(spark, sf):
    flag = F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "view", "0").otherwise("1")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("client_id"), av.event_round(F.col("ts"), ds.START, ds.HOURS).alias("round_id"), flag.alias("available")
    )


@query(
    "e6_client_round_max",
    f"WITH {RAW_FLAGS} SELECT client_id, round_id, max(coalesce(try_cast(available AS DOUBLE), 0)) AS available FROM raw GROUP BY ALL",
)
def round_max(spark, sf):
    return av.client_round_max(_raw_flags(spark, sf))


@query(
    "e7_available_per_round",
    f"WITH {ds.SQL_GRID} SELECT round_id, CAST(sum(available) AS BIGINT) AS available_clients FROM grid GROUP BY 1",
)
def per_round(spark, sf):
    return av.available_per_round(ds.availability(spark, sf))


@query(
    "e8_heatmap",
    f"WITH {RAW_FLAGS}, m AS (SELECT client_id, round_id, max(coalesce(try_cast(available AS DOUBLE), 0)) AS a FROM raw GROUP BY ALL) "
    "SELECT client_id, " + ", ".join(f"coalesce(max(a) FILTER (WHERE round_id = {r}), 0) AS r{r}" for r in range(ds.EVENT_ROUNDS))
    + " FROM m GROUP BY 1",
)
def heatmap(spark, sf):
    return av.availability_heatmap(_raw_flags(spark, sf), ds.EVENT_ROUNDS)


@query(
    "e9_mean_by_timezone",
    f"WITH {ds.SQL_GRID} SELECT timezone_group, round(avg(available), 9) AS mean_available FROM grid GROUP BY 1",
)
def by_timezone(spark, sf):
    return av.mean_by_timezone(ds.availability(spark, sf)).withColumn("mean_available", F.round("mean_available", 9))


@query(
    "f1_totals",
    f"""WITH {ds.SQL_STREAM} SELECT count(*) AS total_rows, count(*) FILTER (WHERE available = 1) AS available_rows,
      count(*) FILTER (WHERE available = 0) AS unavailable_rows,
      round(count(*) FILTER (WHERE available = 1) / greatest(count(*), 1), 9) AS available_share,
      round(count(*) FILTER (WHERE available = 0) / greatest(count(*), 1), 9) AS unavailable_share FROM stream""",
)
def totals(spark, sf):
    out = co.availability_totals(ds.stream_facts(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in ("available_share", "unavailable_share")})


@query(
    "f2_persona_counts",
    f"""WITH {ds.SQL_STREAM}, a AS (SELECT persona, count(*) AS n FROM stream GROUP BY 1),
    b AS (SELECT persona, count(*) AS n FROM stream WHERE available = 1 GROUP BY 1)
    SELECT coalesce(a.persona, b.persona) AS persona, coalesce(a.n, 0) AS all_samples, coalesce(b.n, 0) AS available_samples
    FROM a FULL JOIN b ON a.persona = b.persona""",
)
def persona_counts(spark, sf):
    return co.persona_counts(ds.stream_facts(spark, sf))


@query("f3_timezone_counts", f"WITH {ds.SQL_CLIENTS} SELECT timezone_group, count(*) AS n FROM clients GROUP BY 1")
def timezone_counts(spark, sf):
    return co.value_counts(ds.clients(spark, sf), "timezone_group")


@query(
    "f4_first_rounds",
    f"""WITH {ds.SQL_GRID} SELECT round_id, CAST(sum(available) AS BIGINT) AS available_clients FROM grid GROUP BY 1
    ORDER BY round_id LIMIT 10""",
)
def first_rounds(spark, sf):
    return co.first_rounds(av.available_per_round(ds.availability(spark, sf)))
