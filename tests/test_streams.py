"""Streams over several batches: state carried, late rows, bad rows, lost requests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import aggregates, monitoring
from corpusflow.session import fresh_path
from corpusflow.sources.tables import events
from corpusflow.streaming import jobs, stateful


@pytest.fixture(scope="module")
def parts(spark, root):
    """The events table in four files, by time."""
    folder = fresh_path(spark, "parts")
    frame = spark.read.parquet(f"{root}/events.parquet")
    for i in range(4):
        frame.filter(F.expr(f"event_id div 250 = {i}")).coalesce(1).write.parquet(f"{folder}/p{i}")
    return folder


def stream(spark, folder):
    raw = spark.readStream.schema(jobs.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    return jobs.metric_roles(raw).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")


def batches(spark, path):
    return spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data/batch=*")


def grown(spark, root, folder, build):
    """Run ``build`` over one more file at a time, each run a restart from the checkpoint; the rows written."""
    path = fresh_path(spark, "out")
    for i in range(4):
        frame = spark.read.parquet(f"{root}/events.parquet")
        frame.filter(F.expr(f"event_id div 250 = {i}")).coalesce(1).write.parquet(f"{folder}/p{i}")
        jobs.drain(build(stream(spark, folder)), "restarted", path=path)
    return spark.read.parquet(f"{path}/data")


text = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)


@pytest.mark.parametrize("restarts", [False, True])
def test_limiter_state_outlives_batches_and_restarts(spark, root, parts, restarts):
    build = lambda events_: stateful.limited(events_, ["service"], 3, 86400)
    rows = grown(spark, root, fresh_path(spark, "parts"), build) if restarts else spark.read.parquet(f"{jobs.drain(build(stream(spark, parts)), 'limiter')}/data")
    want = monitoring.fixed_window_limit(events(spark, root), ["service"], 3, 86400)
    columns = ["service", "event_id", "window_start", "allowed", "remaining", "reset_time", "retry_after"]
    assert text(rows.select(*columns).collect()) == text(want.select(*columns).collect())


@pytest.mark.parametrize("restarts", [False, True])
def test_cache_state_outlives_batches_and_restarts(spark, root, parts, restarts):
    kind = F.col("event_type")
    build = lambda events_: stateful.cached(events_, 72000, kind == "view", kind == "click")
    rows = grown(spark, root, fresh_path(spark, "parts"), build) if restarts else spark.read.parquet(f"{jobs.drain(build(stream(spark, parts)), 'cache')}/data")
    ev = events(spark, root)
    want = aggregates.latest_before(ev.filter(kind == "click").select(F.col("event_id").alias("read_id"), "k", "sec"),
                                    ev.filter(kind == "view").select("k", "sec", F.col("event_id").alias("order"), "value"), "k", "sec", 72000, "value")
    columns = ["read_id", "cached_at", "payload", "hit"]
    assert text(rows.select(*columns).collect()) == text(want.select(*columns).collect())
    assert {r.hit for r in rows.collect()} == {True, False}


def test_state_follows_the_keys_touched_and_expires(spark):
    """A batch writes the state of its own keys only, and a timer removes what the watermark has passed."""
    folder, path = fresh_path(spark, "keys"), fresh_path(spark, "out")
    day = dt.datetime(2024, 1, 1)

    def run(number, made):
        rows = [(number * 100 + i, day + dt.timedelta(hours=h), 1, kind, 1.0, f'{{"k": {k}}}') for i, (k, h, kind) in enumerate(made)]
        spark.createDataFrame(rows, jobs.EVENT_SCHEMA).coalesce(1).write.parquet(f"{folder}/p{number}")
        kind = F.col("event_type")
        out = stateful.cached(stream(spark, folder), 7200, kind == "view", kind == "click")
        with stateful.keyed_state(spark):
            query = out.writeStream.option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).format("parquet").start(f"{path}/data")
            query.awaitTermination()
        return [p.stateOperators[0] for p in query.recentProgress]

    assert run(0, [(k, 0, "view") for k in range(40)])[0].numRowsTotal >= 40
    before = run(1, [(3, 1, "click"), (50, 1, "view")])
    # a key's list has one entry and its length; forty untouched keys are not written again
    assert sum(p.numRowsUpdated for p in before) < 40
    later = run(2, [(99, 30, "view")]) + run(3, [(99, 31, "click")])
    assert later[-1].numRowsTotal < before[0].numRowsTotal / 4  # the state of all earlier keys is gone
    assert sorted((r.k, r.hit) for r in spark.read.parquet(f"{path}/data").collect()) == [(3, True), (99, True)]


def test_alerts_hold_fire_and_resolve_in_the_stream(spark, root, parts):
    """Gauge rules over four batches: changes are those of the batch job, up to the watermark."""
    ev = stream(spark, parts)
    rules = monitoring.rule_table(spark)
    sample = lambda e: e.select(F.when(F.col("event_id") % 2 == 0, "cpu_rate").otherwise("restart_rate").alias("rule"), F.col("service").alias("series"), F.col("sec").alias("tick"),
                                F.when(F.col("event_id") % 2 == 0, F.col("value") / 50).otherwise(F.col("value") - 10).alias("value"), *[c for c in e.columns if c == "at"])
    rows = spark.read.parquet(f"{jobs.drain(stateful.alert_changes(monitoring.judged_samples(sample(ev), rules)), 'alerts')}/data").collect()
    want = monitoring.held_alerts(monitoring.judged_samples(sample(events(spark, root)), rules)).filter("state <> 'pending'").collect()
    fired = {(r.rule, r.series, r.started, r.tick) for r in rows if r.state == "firing"}
    assert fired == {(r.rule, r.series, r.started, r.fired_at) for r in want} and len(fired) > 20
    assert {(r.rule, r.series, r.started, r.tick) for r in rows if r.state == "resolved"} == {(r.rule, r.series, r.started, r.resolved_at) for r in want if r.resolved_at is not None}


def test_a_timer_fires_without_another_sample(spark):
    folder, path = fresh_path(spark, "alerts"), fresh_path(spark, "out")

    def run(number, series, minute):
        spark.createDataFrame([(number, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), series, "view", 60.0, '{"k": 1}')], jobs.EVENT_SCHEMA).coalesce(1).write.parquet(f"{folder}/p{number}")
        judged = monitoring.judged_samples(stream(spark, folder).select(F.lit("cpu_rate").alias("rule"), F.col("service").alias("series"), F.col("sec").alias("tick"), "value", "at"), monitoring.rule_table(spark))
        jobs.drain(stateful.alert_changes(judged), "alerts", path=path)

    run(0, 1, 0)
    run(1, 2, 200)  # the watermark goes past the hold time of series 1
    got = [(r.series, r.state) for r in spark.read.parquet(f"{path}/data").collect()]
    assert got == [(1, "firing")]


def test_counts_over_batches(spark, root, parts):
    path = jobs.drain(jobs.daily_counts(stream(spark, parts)), "daily", jobs.by_batch, "update")
    got = jobs.latest_updates(spark, path, ["day", "event_type"]).select("day", "event_type", "n")
    want = events(spark, root).groupBy("day", "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped(spark):
    folder = fresh_path(spark, "late")
    make = lambda i, ts: spark.createDataFrame([(i, ts, 1, "view", 1.0, '{"k": 1}')], jobs.EVENT_SCHEMA).coalesce(1).write.parquet(f"{folder}/p{i}")
    make(1, dt.datetime(2024, 1, 1))
    path = fresh_path(spark, "out")
    run = lambda: jobs.drain(stream(spark, folder).groupBy(F.window("at", "1 hour")).count().select("window.start", "count"), "late", path=path)
    run()
    make(2, dt.datetime(2024, 1, 20))
    run()
    make(3, dt.datetime(2024, 1, 2))  # weeks behind the watermark
    run()
    make(4, dt.datetime(2024, 1, 25))
    run()
    got = {str(r.start)[:10]: r["count"] for r in spark.read.parquet(f"{path}/data").collect()}
    assert got == {"2024-01-01": 1, "2024-01-20": 1}


def test_bad_messages_are_kept_aside(spark):
    folder = fresh_path(spark, "messages")
    spark.createDataFrame([('{"query_id": "a", "analysis": {"original_query": "q"}}',), ("not json",)], "value string").coalesce(1).write.text(f"{folder}/data")
    good = jobs.drain(jobs.history_rows(jobs.messages(spark, folder)), "good")
    bad = jobs.drain(jobs.unreadable(jobs.messages(spark, folder)), "bad")
    row = spark.read.parquet(f"{good}/data").first()
    assert (row.query_id, row.user_id, row.session_id, row.processing_time_ms) == ("a", "anonymous", "", 0.0)
    assert [r.value for r in spark.read.parquet(f"{bad}/data").collect()] == ["not json"]


def test_lost_requests_are_reported(spark, parts):
    path = jobs.drain(jobs.completions(stream(spark, parts), "2 hours", "left_outer"), "lost")
    rows = spark.read.parquet(f"{path}/data")
    assert rows.filter("completed_id is null").count() > 0
    # A submission is either lost or completed, never both.
    both = rows.groupBy("submitted_id").agg(F.count_distinct(F.col("completed_id").isNull()).alias("kinds")).filter("kinds > 1")
    assert both.count() == 0
