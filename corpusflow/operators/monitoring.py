"""Limits, rates, ratios, quantiles and alerts over event and metric tables.

Every function works on a batch table; the windowed ones also accept a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusflow.operators.ranking import top_k

# Requests per minute and burst of the request limiter; limit and window of the simple one.
REQUESTS_PER_MINUTE = 60
BURST = 10
WINDOW_LIMIT = 100
WINDOW_SECONDS = 60

# Gauge alerts (metric, comparison, limit, hold in seconds, severity).
GAUGE_RULES = [
    ("up", "=", 0.0, 60, "critical"),
    ("memory_ratio", ">", 0.9, 300, "warning"),
    ("connection_ratio", ">", 0.8, 300, "warning"),
    ("volume_ratio", ">", 0.85, 600, "warning"),
    ("cpu_rate", ">", 0.8, 300, "warning"),
    ("mean_exec_ms", ">", 1000.0, 300, "warning"),
    ("queue_messages", ">", 10000.0, 600, "warning"),
    ("restart_rate", ">", 0.0, 300, "warning"),
]

# Volume alerts (name, window in seconds, limit, hold in seconds, severity).
VOLUME_RULES = [
    ("token_usage", 3600, 100000.0, 1800, "warning"),
    ("cost", 3600, 10.0, 1800, "warning"),
    ("request_rate", 60, 1000.0, 300, "info"),
    ("rate_limited", 300, 10.0, 300, "warning"),
]

# Ratio alerts.
ERROR_RATIO_LIMIT = 0.05
AVAILABILITY_LIMIT = 0.999
AUTH_FAILURE_LIMIT = 0.1
SUCCESS_LIMIT = 0.95

# Log formats of the database services and the service part of a container name.
POSTGRES_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+ UTC) \[(\d+)\] (\w+):  (.*)$"
REDIS_LINE = r"^(\d+):(\w) (\d+ \w+ \d{4} \d{2}:\d{2}:\d{2}\.\d+) ([*#\-.]) (.*)$"
CONTAINER_SERVICE = r"/rag-(.*)"


def fixed_window_limit(requests: DataFrame, keys: Sequence[str], limit: int, seconds: int, time: str = "sec",
                       order: Sequence[str] = ("us", "event_id")) -> DataFrame:
    """Adds window_start, allowed, remaining, reset_time and retry_after to every request.

    Only the first ``limit`` requests of a key and window are ranked (Spark drops
    the others before the shuffle of the window); the place of the last allowed
    one then decides about all requests through a join.
    """
    start = (F.floor(F.col(time) / seconds) * seconds).cast("long")
    place = F.struct(*order)
    framed = requests.withColumn("window_start", start).withColumn("_place", place)
    head = top_k(framed.select(*keys, "window_start", "_place", *order), [*keys, "window_start"], [F.col(c) for c in order], limit, "_n")
    last = head.groupBy(*keys, "window_start").agg(F.max("_place").alias("_last"))
    numbered = framed.join(last, [*keys, "window_start"]).join(
        head.select(*keys, "window_start", "_place", "_n"), [*keys, "window_start", "_place"], "left")
    allowed = F.col("_place") <= F.col("_last")
    reset = F.col("window_start") + seconds
    return numbered.withColumns({
        "allowed": allowed, "remaining": F.coalesce(F.lit(limit) - F.col("_n"), F.lit(0)).cast("long"), "reset_time": reset,
        "retry_after": F.when(allowed, 0).otherwise(reset - F.col(time)).cast("long"),
    }).drop("_place", "_last", "_n")


def remaining_quota(requests: DataFrame, keys: Sequence[str], limit: int, seconds: int, now: Column, time: str = "sec") -> DataFrame:
    """What is left for every key in the window of ``now``."""
    current = F.floor(F.col(time) / seconds) == F.floor(now / seconds)
    return requests.groupBy(*keys).agg(F.greatest(F.lit(0), F.lit(limit) - F.sum(current.cast("long"))).alias("remaining"))


def sliding(events: DataFrame, by: Sequence[str], time: str, length: str, slide: str, aggs: dict[str, Column]) -> DataFrame:
    """Sliding-window aggregates: (start, end, by, named aggregates)."""
    grouped = events.groupBy(F.window(time, length, slide).alias("_w"), *by).agg(*[c.alias(n) for n, c in aggs.items()])
    return grouped.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, *aggs)


BUCKETS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)


def bucket_counts(value: str = "value", edges: Sequence[float] = BUCKETS) -> list[Column]:
    """Cumulative histogram counts as aggregates: le_0 .. le_n and le_inf."""
    return [F.sum((F.col(value) <= e).cast("long")).alias(f"le_{i}") for i, e in enumerate(edges)] + [F.count(value).alias("le_inf")]


def bucket_quantile(q: float, edges: Sequence[float] = BUCKETS) -> Column:
    """Quantile from cumulative buckets by linear interpolation; above the last edge, the last edge."""
    rank = F.lit(q) * F.col("le_inf")
    out = F.lit(float(edges[-1]))
    for i in reversed(range(len(edges))):
        below = F.col(f"le_{i - 1}") if i else F.lit(0)
        low = float(edges[i - 1]) if i else 0.0
        inside = F.col(f"le_{i}") - below
        share = F.when(inside > 0, (rank - below) / inside).otherwise(0.0)
        out = F.when(F.col(f"le_{i}") >= rank, low + (float(edges[i]) - low) * share).otherwise(out)
    return F.when(F.col("le_inf") > 0, out)


def gauge_alerts(latest: DataFrame) -> DataFrame:
    """Rules applied to the newest sample of every series (metric, value, ...)."""
    rules = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(op).alias("op"), F.lit(x).alias("limit"), F.lit(s).alias("severity")) for m, op, x, _, s in GAUGE_RULES])
    rule = F.get(F.filter(rules, lambda r: r["m"] == F.col("metric")), F.lit(0))
    fires = F.when(F.col("_r.op") == ">", F.col("value") > F.col("_r.limit")).otherwise(F.col("value") == F.col("_r.limit"))
    return latest.withColumn("_r", rule).filter(fires).withColumn("severity", F.col("_r.severity")).drop("_r")


#: All alert rules as one table: gauges are sampled, volumes are summed over a window that moves by ``hop`` seconds.
RULE_SCHEMA = "rule string, op string, limit double, hold long, severity string"


def rule_table(spark) -> DataFrame:
    """The gauge and volume rules (12 rows) with their hold times."""
    rows = [(m, op, x, hold, severity) for m, op, x, hold, severity in GAUGE_RULES] + [(n, ">", x, hold, severity) for n, _, x, hold, severity in VOLUME_RULES]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def judged_samples(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds what its rule says to every sample (rule, series, tick, value): met, hold, severity."""
    met = F.when(F.col("op") == ">", F.col("value") > F.col("limit")).otherwise(F.col("value") == F.col("limit"))
    return samples.join(F.broadcast(rules), "rule").withColumn("met", F.coalesce(met, F.lit(False))).drop("op", "limit")  # a handful of rules


def volume_samples(events: DataFrame, rule: str, value: Column, window: int, hop: int) -> DataFrame:
    """(rule, series, tick, value): sums over the ``window`` seconds before each tick; a tick without events counts as zero.

    Only ticks that follow a window with events are written out: one zero behind each stretch is enough to end it.
    """
    first = (F.floor(F.col("sec") / hop) + 1) * hop
    reached = F.explode(F.sequence(first, F.floor((F.col("sec") + window) / hop) * hop, F.lit(hop).cast("long"))).alias("tick")
    sums = events.select("service", value.alias("v"), reached).groupBy("service", "tick").agg(F.sum("v").alias("value"))
    zeros = sums.select("service", (F.col("tick") + hop).alias("tick"), F.lit(0.0).alias("value"))
    both = sums.unionByName(zeros).groupBy("service", "tick").agg(F.max("value").alias("value"))
    return both.select(F.lit(rule).alias("rule"), F.col("service").alias("series"), "tick", "value")


def held_alerts(judged: DataFrame) -> DataFrame:
    """Stretches in which a rule is met: rule, series, severity, started, fired_at, resolved_at, state.

    A stretch goes from the first sample that meets the rule to the next one that does not. It fires when it has held for
    the rule's time; until then it is pending, and a pending stretch that ends leaves nothing. Samples are one per series
    and tick, so a series has as many rows as ticks, however many events are behind them.
    """
    order = W.partitionBy("rule", "series").orderBy("tick")
    turns = judged.withColumn("_was", F.lag("met", 1, False).over(order)).filter(F.col("met") != F.col("_was"))
    turns = turns.withColumn("resolved_at", F.lead("tick").over(order)).filter("met").withColumnRenamed("tick", "started")
    now = judged.agg(F.max("tick").alias("now")).select("now").scalar()
    held = F.coalesce("resolved_at", now) - F.col("started") >= F.col("hold")
    state = F.when(~held, "pending").when(F.col("resolved_at").isNull(), "firing").otherwise("resolved")
    return turns.withColumn("state", state).filter("state <> 'pending' OR resolved_at IS NULL").select(
        "rule", "series", "severity", "started", F.when(held, F.col("started") + F.col("hold")).alias("fired_at"), "resolved_at", "state")


def counter_increase(previous: Column, value: Column) -> Column:
    """Growth of a counter; a drop means it restarted from zero."""
    return F.when(previous.isNull(), 0.0).when(value < previous, value).otherwise(value - previous)


def grouped_alerts(alerts: DataFrame, labels: Sequence[str] = ("alertname", "severity", "service")) -> DataFrame:
    return alerts.groupBy(*labels).agg(F.count("*").alias("n"), F.min("started").alias("started"))


def without_inhibited(alerts: DataFrame, equal: Sequence[str] = ("alertname", "service")) -> DataFrame:
    """Warnings with a critical alert of the same labels are dropped."""
    critical = alerts.filter("severity = 'critical'").select(*equal).distinct().withColumn("severity", F.lit("warning"))
    return alerts.join(critical, [*equal, "severity"], "left_anti")


def service_of(container: Column) -> Column:
    return F.regexp_extract(container, CONTAINER_SERVICE, 1)


def parse_database_line(service: Column, line: Column) -> dict[str, Column]:
    """Level, process and message of a database log line, by the format of its service."""
    pick = lambda pg, redis: F.when(service == "postgres", F.regexp_extract(line, POSTGRES_LINE, pg)).when(
        service == "redis", F.regexp_extract(line, REDIS_LINE, redis))
    return {"db_level": pick(3, 4), "pid": pick(2, 1), "db_message": pick(4, 5)}
