"""Balanced statistics against plain computations, with one key holding most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import aggregates, ranking


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    keys = ["hot"] * 700 + [f"k{i % 9}" for i in range(300)]
    return [(k, i, int(rng.integers(0, 5000)), round(float(rng.gamma(2, 30)), 2)) for i, k in enumerate(keys)]


def test_percentiles(spark, rows):
    frame = spark.createDataFrame(rows, "key string, id long, sec long, value double")
    for r in aggregates.percentiles(frame, ["key"], "value", (0.1, 0.5, 0.99)).collect():
        values = [v for k, _, _, v in rows if k == r.key]
        assert r.n == len(values)
        assert np.allclose([r.p10, r.p50, r.p99], np.quantile(values, [0.1, 0.5, 0.99]))


def test_percentiles_of_one_value_and_no_key(spark):
    frame = spark.createDataFrame([(3.0,)] * 5, "value double")
    row = aggregates.percentiles(frame, [], "value", (0.5,)).first()
    assert (row.n, row.p50) == (5, 3.0)


def test_running_total_and_previous_value(spark, rows):
    frame = spark.createDataFrame(rows, "key string, id long, sec long, value double").withColumn("b", F.expr("id div 37"))
    total = {r.id: r.t for r in ranking.running_total(frame, ["key"], "b", ["id"], "sec", "t").collect()}
    before = {r.id: r.p for r in aggregates.previous_value(frame, ["key"], "b", ["id"], "sec", "p").collect()}
    seen, last = {}, {}
    for k, i, sec, _ in rows:
        assert total[i] == seen.get(k, 0) and before[i] == last.get(k)
        seen[k], last[k] = seen.get(k, 0) + sec, sec


def test_latest_before(spark, rows):
    writes = [(k, s, i, v) for k, i, s, v in rows if i % 2]
    reads = [(i, k, s) for k, i, s, _ in rows if not i % 2]
    got = aggregates.latest_before(spark.createDataFrame(reads, "read_id long, key string, sec long"),
                                   spark.createDataFrame(writes, "key string, sec long, order long, value double"), "key", "sec", 60, "value")
    for r in got.collect():
        known = [(s, i, v) for k, s, i, v in writes if k == r.key and r.sec - 60 < s <= r.sec]
        assert r.hit == bool(known) and (not known or (r.cached_at, r.payload) == (max(known)[0], max(known)[2]))


def test_overlapping_intervals(spark):
    rng = np.random.default_rng(2)
    make = lambda n: [(int(a), int(a + w)) for a, w in zip(rng.integers(0, 900, n), rng.integers(1, 200, n))]
    left, right = make(60), make(40)
    lf = spark.createDataFrame([(1, s, e) for s, e in left], "key long, ls long, le long")
    rf = spark.createDataFrame([(1, s, e) for s, e in right], "key long, rs long, re long")
    got = sorted(tuple(r) for r in aggregates.overlapping(lf, rf, "key", 64).select("ls", "le", "rs", "re").collect())
    assert got == sorted((a, b, c, d) for a, b in left for c, d in right if max(a, c) < min(b, d))


def test_sessions(spark, rows):
    frame = spark.createDataFrame(rows, "key string, id long, sec long, value double")
    got = sorted((r.key, r.started, r.ended, r.n) for r in aggregates.sessions(frame, "key", "sec", 20).collect())
    want = []
    for key in {r[0] for r in rows}:
        times = sorted(s for k, _, s, _ in rows if k == key)
        start = prev = times[0]
        n = 1
        for t in times[1:]:
            if t - prev > 20:
                want.append((key, start, prev, n))
                start, n = t, 0
            prev, n = t, n + 1
        want.append((key, start, prev, n))
    assert got == sorted(want)
