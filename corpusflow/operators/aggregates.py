"""Exact statistics and neighbour lookups that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusflow.operators.ranking import running_total

BINS = 1024


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], prefix: str = "p") -> DataFrame:
    """Exact interpolated percentiles per group: (keys, n, p50, p95, ...).

    Equal values are counted first. Counts are then summed up over the value
    order in two levels (bins of the group's range, then inside a bin), so no task
    holds a whole group; the two values around each position are picked out.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranges = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("n"))
    if keys:
        ranged = counts.join(ranges, keys)
    else:
        ranged = counts.withColumns({c: ranges.select(c).scalar() for c in ("_lo", "_hi", "n")})
    binned = ranged.withColumn(
        "_bin", F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS)).otherwise(0))
    placed = running_total(binned, keys, "_bin", ["_v"], "_n", "_before")
    picks = []
    for p in probs:
        low = F.floor(F.lit(p) * (F.col("n") - 1))
        high = F.ceil(F.lit(p) * (F.col("n") - 1))
        inside = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
        picks += [F.max(F.when(inside(low), F.col("_v"))).alias(f"_l{p}"), F.max(F.when(inside(high), F.col("_v"))).alias(f"_h{p}")]
    picked = placed.groupBy(*keys, "n").agg(*picks)
    out = []
    for p in probs:
        share = F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
        out.append((F.col(f"`_l{p}`") + (F.col(f"`_h{p}`") - F.col(f"`_l{p}`")) * share).alias(f"{prefix}{round(p * 100)}"))
    return picked.select(*keys, "n", *out)


def previous_value(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Value of the row before, per group, by blocks of the order column.

    Inside a block a window looks back; the first row of a block takes the last
    value of the nearest earlier block.
    """
    keys = list(keys)
    inner = W.partitionBy(*keys, block).orderBy(*order)
    last = df.groupBy(*keys, block).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    last = last.withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy(block))).drop("_last")
    looked = df.withColumn("_prev", F.lag(value).over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
    return looked.join(last, [*keys, block]).withColumn(
        out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))).drop("_prev", "_first", "_carry")


def latest_before(reads: DataFrame, writes: DataFrame, key: str, time: str, ttl: int, payload: str) -> DataFrame:
    """As-of lookup with expiry: for each read the latest write of its key at most ``ttl`` ago.

    ``reads`` is (read_id, key, time), ``writes`` (key, time, order, payload), time
    in whole units. Time is cut into blocks of one ``ttl``; the wanted write is in
    the read's block or the one before. So one window per (key, block) and one
    equi-join on the previous block replace a join of all reads with all writes.
    """
    block = lambda c: F.floor(F.col(c) / ttl)
    stamp = F.struct(F.col(time).alias("t"), F.col("order").alias("o"), F.col(payload).alias("p"))
    written = writes.withColumn("_block", block(time)).withColumn("_w", stamp)
    carried = written.groupBy(key, (F.col("_block") + 1).alias("_block")).agg(F.max("_w").alias("_carry"))
    rows = written.select(key, "_block", time, "_w", F.lit(None).cast("long").alias("read_id")).unionByName(
        reads.select(key, block(time).alias("_block"), time, F.lit(None).cast(written.schema["_w"].dataType).alias("_w"), "read_id"))
    seen = F.max("_w").over(W.partitionBy(key, "_block").orderBy(time).rangeBetween(W.unboundedPreceding, 0))
    found = rows.withColumn("_seen", seen).filter("read_id is not null").join(carried, [key, "_block"], "left")
    best = F.coalesce("_seen", "_carry")
    fresh = best["t"] > F.col(time) - ttl
    return found.select("read_id", key, time, F.when(fresh, best["t"]).alias("cached_at"), F.when(fresh, best["p"]).alias("payload"), F.coalesce(fresh, F.lit(False)).alias("hit"))


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of intervals [ls, le) and [rs, re) of one key that overlap.

    Both sides are spread over position bins of ``width`` and meet bin by bin, so a
    key with many intervals is not compared all against all. Each pair is reported
    in the first bin it shares.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width)))
    pairs = left.withColumn("_bin", bins("ls", "le")).join(right.withColumn("_bin", bins("rs", "re")), [key, "_bin"])
    shared = F.greatest("ls", "rs") < F.least("le", "re")
    return pairs.filter(shared & (F.col("_bin") == F.floor(F.greatest("ls", "rs") / width))).drop("_bin")


def sessions(events: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """Sessions per key by inactivity: (key, started, ended, n).

    Events closer than ``gap`` are first folded per (key, gap-wide bucket) - they
    always share a session - so the window sees one row per bucket.
    """
    folded = events.groupBy(key, F.floor(F.col(time) / gap).alias("_b")).agg(F.min(time).alias("_s"), F.max(time).alias("_e"), F.count("*").alias("_n"))
    order = W.partitionBy(key).orderBy("_b")
    fresh = (F.col("_s") - F.lag("_e").over(order) > gap) | F.lag("_e").over(order).isNull()
    marked = folded.withColumn("_new", fresh.cast("int"))
    numbered = marked.withColumn("_id", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_id").agg(F.min("_s").alias("started"), F.max("_e").alias("ended"), F.sum("_n").alias("n")).drop("_id")


def sustained(ticks: DataFrame, keys: Sequence[str], tick: str, firing: str, step: int, hold: int) -> DataFrame:
    """Stretches of consecutive firing ticks that last at least ``hold``: (keys, started, ended).

    ``ticks`` has one row per key and evaluation time; a missing tick ends a stretch.
    """
    keys = list(keys)
    order = W.partitionBy(*keys).orderBy(tick)
    on = ticks.filter(F.col(firing)).withColumn("_island", F.col(tick) - F.row_number().over(order) * step)
    return on.groupBy(*keys, "_island").agg(F.min(tick).alias("started"), F.max(tick).alias("ended")).filter(
        F.col("ended") - F.col("started") >= hold).drop("_island")
