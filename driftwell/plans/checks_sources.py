"""Queries for readers and generated grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators.rounds import global_positions
from driftwell.plans.datasets import NOW, table
from driftwell.plans.registry import query
from driftwell.sources import grids, readers


@query("a1_load_table", "SELECT * FROM documents")
def load_table(spark, sf):
    return readers.read_table(spark, f"{sf}/documents.parquet")


@query(
    "a3_source_bodies",
    """WITH requested AS (SELECT url AS source_url FROM pages UNION ALL SELECT url || '#gone' FROM pages)
    SELECT source_url, coalesce(html, 'ERROR_LOADING_SOURCE: ' || source_url) AS text
    FROM requested LEFT JOIN pages ON url = source_url""",
)
def source_bodies(spark, sf):
    pages = table(spark, sf, "pages")
    urls = pages.select(F.explode(F.array("url", F.concat("url", F.lit("#gone")))).alias("source_url"))
    return readers.source_bodies(urls, pages.select("url", F.col("html").alias("body")))


@query("a4_payload_rows", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def payload_rows(spark, sf):
    return readers.payload_rows(table(spark, sf, "events"), "props", "k int", ["event_id"])


@query(
    "a4_payload_data_array",
    """SELECT event_id, unnest([CAST(json_extract(props, '$.k') AS INTEGER), CAST(user_id AS INTEGER)]) AS k FROM events""",
)
def payload_data_array(spark, sf):
    wrapped = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit('{"data": ['), "props", F.lit(', {"k": '), "user_id", F.lit("}]}")).alias("payload")
    )
    return readers.payload_rows(wrapped, "payload", "k int", ["event_id"])


def _topics(spark, sf, column):
    distinct = table(spark, sf, "part").select(F.col(column).alias("topic")).distinct()
    return global_positions(distinct, ["topic"], "topic_no").select("topic", F.col("topic_no").cast("int").alias("topic_no"))


@query(
    "a7_prior_corpus",
    """SELECT topic, 'neutral' AS label,
      'Historical public finance prior. Discuss general risk, diversification, and valuation considerations for ' || topic
      || '. Avoid client-local events, round-specific facts, and newly emerging market terms.' AS text,
      'static_stale_llm_prior' AS source, CAST(row_number() OVER (ORDER BY topic) - 1 AS INTEGER) AS prior_id
    FROM (SELECT DISTINCT p_name AS topic FROM part)""",
)
def prior_corpus(spark, sf):
    return grids.prior_corpus(_topics(spark, sf, "p_name"))


@query(
    "a8_prompt_grid",
    f"""WITH topics AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS t, count(*) OVER () AS n
      FROM (SELECT DISTINCT p_brand AS topic FROM part)),
    cells AS (SELECT topics.*, d, s FROM topics, range(30) a(d), range(6) b(s))
    SELECT CAST(d AS INTEGER) AS day_no, CAST(t AS INTEGER) AS topic_no, CAST(s AS INTEGER) AS sample_no, topic,
      'Given this recent market seed text, write a concise financial assistant note (3-5 sentences). Stay factual, '
      || 'include one potential market implication, and end with exactly one label token: [positive], [neutral], or [negative].'
      || chr(10) || chr(10) || 'Date: ' || strftime(TIMESTAMP '{NOW}' - to_days(CAST(d AS INTEGER)), '%Y-%m-%d') || chr(10)
      || 'Seed: ' || topic AS prompt,
      TIMESTAMP '{NOW}' - to_hours(CAST(d * n * 6 + t * 6 + s AS INTEGER)) AS timestamp
    FROM cells""",
)
def prompt_grid(spark, sf):
    topics = _topics(spark, sf, "p_brand")
    return grids.prompt_grid(topics, 30, 6, NOW, topics.count())
