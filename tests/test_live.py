"""Availability as a stream: restarts, repeated and late events."""

import datetime as dt

import pytest

from driftwell.operators.availability import observed_activity
from driftwell.streaming import live

START, HOURS = "2024-01-01 03:00:00", 6
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint"


def at(hours):
    return dt.datetime(2024, 1, 1, 3) + dt.timedelta(hours=hours)


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / n) for n in ("events", "out", "checkpoint")]


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folders, job):
    events, out, checkpoint = folders
    stream = job(live.arriving(spark, events, EVENTS, 1), START, HOURS)
    done = live.follow(stream, out, checkpoint)
    assert done.exception() is None
    return spark.read.schema(stream.schema).parquet(out)


def test_activity_equals_the_batch_and_restarts_add_nothing(spark, rows, folders):
    days = [[(d * 100 + k, at(24 * d + 2 * k), k % 4) for k in range(12)] for d in range(4)]
    days[1] += days[1][:5] + [(999, None, 1), (998, at(25), None), (998, at(25), None)]
    expected = None
    for day in days:
        deliver(spark, folders[0], day)
        got = rows(run(spark, folders, live.live_activity).select("client_id", "round_id"))
        log = spark.read.schema(EVENTS).parquet(folders[0])
        expected = rows(observed_activity(log.filter("ts is not null"), START, HOURS))
        assert got == expected
    assert rows(run(spark, folders, live.live_activity).select("client_id", "round_id")) == expected  # nothing new
    assert any(r[0] is None for r in expected)


def test_late_events_are_left_out_and_can_be_added(spark, rows, folders):
    deliver(spark, folders[0], [(1, at(1), 1), (2, at(60), 1)])
    run(spark, folders, live.live_activity)
    deliver(spark, folders[0], [(3, at(2), 7), (4, at(2), 1), (5, at(45), 7), (6, at(61), 7)])  # rounds 0, 0, 7, 10; the newest was 10
    table = run(spark, folders, live.live_activity)
    assert rows(table.select("client_id", "round_id")) == [(1, 0), (1, 10), (7, 10), (7, 7)]
    log = spark.read.schema(EVENTS).parquet(folders[0])
    missing = live.add_missing(table, log, START, HOURS)
    assert missing.columns == table.columns and rows(missing.select("client_id", "round_id")) == [(7, 0)]
    assert live.add_missing(table.union(missing), log, START, HOURS).count() == 0


def test_counts_of_closed_rounds_take_each_event_once(spark, rows, folders):
    deliver(spark, folders[0], [(1, at(1), 1), (2, at(2), 1), (1, at(1), 1), (3, at(7), 2)])
    assert rows(run(spark, folders, live.live_counts)) == []  # all rounds are open
    deliver(spark, folders[0], [(2, at(2), 1), (4, at(3), 1), (5, at(31), 2)])
    assert rows(run(spark, folders, live.live_counts)) == [(1, 0, 3)]  # 31 hours are a day after the end of round 0
    deliver(spark, folders[0], [(6, at(4), 1), (7, at(80), 3)])  # an event for a closed round
    assert rows(run(spark, folders, live.live_counts)) == [(1, 0, 3), (2, 1, 1), (2, 5, 1)]
    assert rows(run(spark, folders, live.live_counts)) == [(1, 0, 3), (2, 1, 1), (2, 5, 1)]


def test_state_is_kept_by_round(spark, folders):
    deliver(spark, folders[0], [(1, at(1), 1)])
    plan = live.live_activity(live.arriving(spark, folders[0], EVENTS), START, HOURS)._jdf.queryExecution().analyzed().toString()
    assert "EventTimeWatermark" in plan and "Deduplicate" in plan
