"""Queries for the streaming form of availability: each runs a stream over the event files to its end."""

from __future__ import annotations

from driftwell.plans import datasets as ds
from driftwell.plans.datasets import table
from driftwell.plans.registry import query
from driftwell.session import work_path
from driftwell.streaming import live


def _followed(spark, sf, job, name):
    """The table that the stream has written when it ends."""
    events = live.arriving(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema)
    done = job(events, ds.START, ds.HOURS)
    out = work_path(spark, name)
    live.follow(done, out, work_path(spark, f"{name}-checkpoint"))
    return spark.read.schema(done.schema).parquet(out)


SQL_ROUND = f"CAST(floor(date_diff('second', TIMESTAMP '{ds.START}', date_trunc('second', ts)) / {ds.HOURS * 3600}) AS INTEGER)"


@query("l1_live_activity", f"SELECT DISTINCT user_id AS client_id, {SQL_ROUND} AS round_id FROM events WHERE ts IS NOT NULL")
def live_activity(spark, sf):
    return _followed(spark, sf, live.live_activity, "live-activity").select("client_id", "round_id")


@query(
    "l2_live_counts",
    f"""WITH counted AS (SELECT user_id AS client_id, {SQL_ROUND} AS round_id, count(DISTINCT event_id) AS events FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)
    SELECT * FROM counted WHERE TIMESTAMP '{ds.START}' + to_hours({ds.HOURS} * (round_id + 1)) <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def live_counts(spark, sf):
    return _followed(spark, sf, live.live_counts, "live-counts")
