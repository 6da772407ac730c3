"""Rate limits, metric rules, alerts and log queries over the events table (batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import aggregates
from corpusflow.operators import monitoring as mon
from corpusflow.operators.ranking import stable, top_k
from corpusflow.plans.analytics import EV, questions, QUESTIONS, audit, AUDIT
from corpusflow.plans.registry import query
from corpusflow.sources.files import parsed_logs
from corpusflow.sources.tables import epoch_micros, events


def seconds(column):
    return F.floor(epoch_micros(column) / F.lit(1_000_000)).cast("long")


LIMIT = """lim AS (SELECT *, sec // {s} * {s} AS window_start, row_number() OVER (PARTITION BY {key}, sec // {s} ORDER BY us, event_id) AS n FROM ev)
SELECT event_id, window_start, n <= {limit} AS allowed, greatest({limit} - n, 0) AS remaining, window_start + {s} AS reset_time, CASE WHEN n <= {limit} THEN 0 ELSE window_start + {s} - sec END AS retry_after FROM lim"""


@query("request_limiter", "J4", f"WITH {EV}, " + LIMIT.format(s=3600, key="service", limit=2))
def request_limiter(spark, root):
    """Fixed-window limit per service: two requests an hour pass."""
    out = mon.fixed_window_limit(events(spark, root), ["service"], 2, 3600)
    return out.select("event_id", "window_start", "allowed", "remaining", "reset_time", "retry_after")


@query("minute_limiter", "J4 J5", f"WITH {EV}, " + LIMIT.format(s=60, key="event_type", limit=mon.REQUESTS_PER_MINUTE + mon.BURST))
def minute_limiter(spark, root):
    """Request limit per minute plus burst, keyed by event type."""
    out = mon.fixed_window_limit(events(spark, root), ["event_type"], mon.REQUESTS_PER_MINUTE + mon.BURST, 60)
    return out.select("event_id", "window_start", "allowed", "remaining", "reset_time", "retry_after")


@query("window_limiter", "J5", f"WITH {EV}, " + LIMIT.format(s=86400, key="user_id", limit=3))
def window_limiter(spark, root):
    """Configurable limiter: three requests a day and user."""
    out = mon.fixed_window_limit(events(spark, root), ["user_id"], 3, 86400)
    return out.select("event_id", "window_start", "allowed", "remaining", "reset_time", "retry_after")


@query("remaining_quota", "J6", f"WITH {EV}, n AS (SELECT max(sec) AS now FROM ev) SELECT user_id, greatest(0, 5 - sum((sec // 86400 = now // 86400)::INT))::BIGINT AS remaining FROM ev, n GROUP BY 1")
def remaining_quota(spark, root):
    """Requests left today for every user."""
    ev = events(spark, root)
    return mon.remaining_quota(ev, ["user_id"], 5, 86400, ev.agg(F.max("sec")).scalar())


@query("late_samples", "J7", f"WITH {EV}, n AS (SELECT max(us) AS now FROM ev) SELECT day, count(*) AS samples, sum((us < now - 168 * 3600000000)::INT)::BIGINT AS too_old FROM ev, n GROUP BY 1")
def late_samples(spark, root):
    """Samples per day and how many are older than a week at the newest one's time."""
    ev = events(spark, root)
    newest = ev.agg(F.max("us")).scalar()
    return ev.withColumn("old", F.col("us") < newest - 168 * 3600000000).groupBy("day").agg(F.count("*").alias("samples"), F.sum(F.col("old").cast("long")).alias("too_old"))


@query("inactivity_sessions", "J9", f"""WITH {EV}, g AS (SELECT user_id, sec, CASE WHEN sec - lag(sec) OVER w > 3600 OR lag(sec) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY sec)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS id FROM g)
SELECT user_id, min(sec) AS started, max(sec) AS ended, count(*) AS n FROM i GROUP BY user_id, id""")
def inactivity_sessions(spark, root):
    """Sessions per user, ended by an hour without events."""
    return aggregates.sessions(events(spark, root), "user_id", "sec", 3600)


def _hop(length, step):
    return f"unnest(range((sec // {step} - {length // step} + 1) * {step}, sec // {step} * {step} + 1, {step}))"


@query("event_rates", "J10", f"WITH {EV}, w AS (SELECT service, {_hop(3600, 900)} AS start FROM ev) SELECT service, start, count(*) AS n, round(count(*) / 3600.0::DOUBLE, 9) AS rate FROM w GROUP BY ALL")
def event_rates(spark, root):
    """Events per second over the last hour, every quarter of an hour, per service."""
    out = mon.sliding(events(spark, root), ["service"], "ts", "1 hour", "15 minutes", {"n": F.count("*")})
    return out.select("service", seconds("start").alias("start"), "n", stable(F.col("n") / 3600).alias("rate"))


@query("counter_rates", "J10", f"""WITH {EV}, d AS (SELECT service, sec, k, lag(k) OVER (PARTITION BY service ORDER BY us, event_id) AS p FROM ev),
i AS (SELECT service, sec // 86400 * 86400 AS start, CASE WHEN p IS NULL THEN 0 WHEN k < p THEN k ELSE k - p END AS inc FROM d) SELECT service, start, sum(inc)::DOUBLE AS increase, round(sum(inc) / 86400.0::DOUBLE, 9) AS rate FROM i GROUP BY ALL""")
def counter_rates(spark, root):
    """Increase of a counter per day, restarts included; k is the counter."""
    ev = events(spark, root).withColumn("_hour", F.expr("sec div 3600"))
    seen = aggregates.previous_value(ev, ["service"], "_hour", ["us", "event_id"], "k", "p")
    grown = seen.withColumn("inc", mon.counter_increase(F.col("p"), F.col("k").cast("double")))
    return grown.groupBy("service", (F.expr("sec div 86400") * 86400).alias("start")).agg(F.sum("inc").alias("increase")).withColumn("rate", stable(F.col("increase") / 86400))


@query("error_ratios", "J11", f"""WITH {EV}, w AS (SELECT service, is_error, event_type, {_hop(21600, 3600)} AS start FROM ev), r AS (SELECT service, start, count(*) AS n, avg(is_error::INT) AS e,
 sum((event_type = 'error')::INT)::DOUBLE / nullif(sum((event_type IN ('error', 'signup'))::INT), 0) AS a FROM w GROUP BY ALL)
SELECT service, start, n, round(e, 9) AS error_ratio, round(1 - e, 9) AS availability, round(a, 9) AS auth_failures, e > 0.05 AS high_errors, 1 - e < 0.999 AS sla_breach, coalesce(a > 0.1, FALSE) AS auth_alert, 1 - e < 0.95 AS low_success FROM r""")
def error_ratios(spark, root):
    """Error, availability and log-in failure ratios over six hours, with their alerts."""
    kind = F.col("event_type")
    out = mon.sliding(events(spark, root), ["service"], "ts", "6 hours", "1 hour", {
        "n": F.count("*"), "e": F.avg(F.col("is_error").cast("int")),
        "a": F.sum((kind == "error").cast("double")) / F.nullif(F.sum(kind.isin("error", "signup").cast("long")), F.lit(0))})
    return out.select(
        "service", seconds("start").alias("start"), "n", stable(F.col("e")).alias("error_ratio"), stable(1 - F.col("e")).alias("availability"), stable(F.col("a")).alias("auth_failures"),
        (F.col("e") > mon.ERROR_RATIO_LIMIT).alias("high_errors"), (1 - F.col("e") < mon.AVAILABILITY_LIMIT).alias("sla_breach"),
        F.coalesce(F.col("a") > mon.AUTH_FAILURE_LIMIT, F.lit(False)).alias("auth_alert"), (1 - F.col("e") < mon.SUCCESS_LIMIT).alias("low_success"))


def _bucket_sql(q):
    edges = mon.BUCKETS
    cases = []
    for i, e in enumerate(edges):
        low, below = (edges[i - 1], f"le_{i - 1}") if i else (0.0, "0")
        cases.append(f"WHEN le_{i} >= {q}::DOUBLE * le_inf THEN {low}::DOUBLE + ({e} - {low}) * ({q}::DOUBLE * le_inf - {below}) / (le_{i} - {below})")
    return f"CASE {' '.join(cases)} ELSE {edges[-1]} END"


_LE = ", ".join(f"sum((value <= {e})::INT) AS le_{i}" for i, e in enumerate(mon.BUCKETS))


@query("bucket_quantiles", "J12", f"""WITH {EV}, h AS (SELECT service, day, {_LE}, count(value) AS le_inf FROM ev GROUP BY ALL)
SELECT service, day, round({_bucket_sql(0.5)}, 6) AS p50, round({_bucket_sql(0.95)}, 6) AS p95, round({_bucket_sql(0.99)}, 6) AS p99 FROM h""")
def bucket_quantiles(spark, root):
    """Latency quantiles interpolated from histogram buckets."""
    hist = events(spark, root).groupBy("service", "day").agg(*mon.bucket_counts())
    return hist.select("service", "day", *[F.round(mon.bucket_quantile(q), 6).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)])


@query("raw_quantiles", "J12", f"WITH {EV} SELECT service, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM ev GROUP BY 1")
def raw_quantiles(spark, root):
    """Exact latency quantiles per service."""
    out = aggregates.percentiles(events(spark, root), ["service"], "value", (0.5, 0.9, 0.95, 0.99))
    return out.select("service", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99")])


METRIC_OF = {"view": "memory_ratio", "click": "connection_ratio", "signup": "volume_ratio", "purchase": "cpu_rate", "error": "restart_rate"}


@query("gauge_alerts", "J13", f"""WITH {EV}, m AS (SELECT CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in METRIC_OF.items())} END AS metric, user_id AS series, arg_max(value / 50, us * 1000 + event_id % 1000) AS value FROM ev GROUP BY ALL)
SELECT metric, series, round(value, 6) AS value, 'warning' AS severity FROM m WHERE value > CASE metric WHEN 'memory_ratio' THEN 0.9 WHEN 'connection_ratio' THEN 0.8 WHEN 'volume_ratio' THEN 0.85 WHEN 'cpu_rate' THEN 0.8 ELSE 0 END""")
def gauge_alerts(spark, root):
    """Threshold rules on the newest sample of every series."""
    metric = F.create_map(*[F.lit(x) for kv in METRIC_OF.items() for x in kv])[F.col("event_type")]
    latest = events(spark, root).groupBy(metric.alias("metric"), F.col("user_id").alias("series")).agg(
        F.max_by(F.col("value") / 50, F.struct("us", "event_id")).alias("value"))
    return mon.gauge_alerts(latest).withColumn("value", F.round("value", 6))


@query("volume_alerts", "J14", f"""WITH {EV}, w AS (SELECT service, value, {_hop(3600, 600)} AS start FROM ev), c AS (SELECT service, start, count(*) AS n, sum(value) AS tokens FROM w GROUP BY ALL)
SELECT service, start, n, round(tokens, 6) AS tokens, round(tokens / 100, 6) AS cost, tokens * 1000 > 100000 AS token_alert, tokens / 100 > 10 AS cost_alert FROM c""")
def volume_alerts(spark, root):
    """Token and cost volume per hour against their limits; the value stands for tokens in thousands."""
    limits = {name: limit for name, _, limit, _, _ in mon.VOLUME_RULES}
    out = mon.sliding(events(spark, root), ["service"], "ts", "1 hour", "10 minutes", {"n": F.count("*"), "tokens": F.sum("value")})
    return out.select("service", seconds("start").alias("start"), "n", F.round("tokens", 6).alias("tokens"), F.round(F.col("tokens") / 100, 6).alias("cost"),
                      (F.col("tokens") * 1000 > limits["token_usage"]).alias("token_alert"), (F.col("tokens") / 100 > limits["cost"]).alias("cost_alert"))


#: The gauge that an event samples, by its number; the value's scale lets every rule be met sometimes.
GAUGES = [name for name, *_ in mon.GAUGE_RULES]
GAUGE_SCALE = {"up": 0.0, "queue_messages": 400.0, "mean_exec_ms": 40.0}
#: (amount of an event, seconds it counts for, hop); for the request rate an event stands for a quarter of an hour of traffic.
VOLUMES = {"token_usage": ("value * 1000", 3600, 600), "cost": ("value / 10", 3600, 600), "request_rate": ("1100.0D", 900, 60), "rate_limited": ("if(is_error, 6.0D, 0.0D)", 300, 60)}


def alert_samples(ev):
    """Samples of all twelve rules: one gauge per event, volumes over moving windows; one sample a series and second."""
    name = F.get(F.array(*[F.lit(g) for g in GAUGES]), F.pmod("event_id", F.lit(len(GAUGES))).cast("int"))
    scale = F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in GAUGE_SCALE.items() for x in kv]), lambda k, _: k == F.col("rule"))), F.lit(0)), F.lit(0.04))
    value = F.when(F.col("rule") == "up", F.when(F.col("is_error"), 0.0).otherwise(1.0)).otherwise(F.col("value") * scale)
    gauges = ev.withColumn("rule", name).groupBy("rule", F.col("service").alias("series"), F.col("sec").alias("tick")).agg(F.max_by(value, F.struct("us", "event_id")).alias("value"))
    for rule, (amount, window, hop) in VOLUMES.items():
        gauges = gauges.unionByName(mon.volume_samples(ev, rule, F.expr(amount), window, hop))
    return gauges


def _volume_sql(rule, amount, window, hop):
    amount = {"1100.0D": "1100.0::DOUBLE", "if(is_error, 6.0D, 0.0D)": "CASE WHEN is_error THEN 6.0::DOUBLE ELSE 0 END"}.get(amount, amount)
    return f"""v_{rule} AS (SELECT service, t AS tick, sum({amount}) AS value FROM ev, unnest(range((sec // {hop} + 1) * {hop}, (sec + {window}) // {hop} * {hop} + 1, {hop})) AS u(t) GROUP BY ALL),
s_{rule} AS (SELECT '{rule}' AS rule, service AS series, tick, max(value) AS value FROM (SELECT * FROM v_{rule} UNION ALL SELECT service, tick + {hop}, 0 FROM v_{rule}) GROUP BY ALL)"""


_RULES = ", ".join(f"('{r}', '{op}', {x}::DOUBLE, {hold}, '{sev}')" for r, op, x, hold, sev in [*mon.GAUGE_RULES, *[(n, ">", x, h, s) for n, _, x, h, s in mon.VOLUME_RULES]])
HELD = f"""{EV}, rules AS (SELECT * FROM (VALUES {_RULES}) r(rule, op, lim, hold, severity)),
g AS (SELECT {list(GAUGES)}[event_id % {len(GAUGES)} + 1] AS rule, * FROM ev),
sg AS (SELECT rule, service AS series, sec AS tick, arg_max(CASE WHEN rule = 'up' THEN CASE WHEN is_error THEN 0 ELSE 1 END ELSE value * CASE rule WHEN 'queue_messages' THEN 400 WHEN 'mean_exec_ms' THEN 40 ELSE 0.04::DOUBLE END END, (us, event_id)) AS value FROM g GROUP BY ALL),
{", ".join(_volume_sql(r, *v) for r, v in VOLUMES.items())},
sa AS (SELECT * FROM sg {" ".join(f"UNION ALL SELECT * FROM s_{r}" for r in VOLUMES)}),
ju AS (SELECT sa.*, hold, severity, CASE WHEN op = '>' THEN value > lim ELSE value = lim END AS met FROM sa JOIN rules USING (rule)),
tu AS (SELECT * FROM (SELECT *, lag(met, 1, false) OVER (PARTITION BY rule, series ORDER BY tick) AS was FROM ju) WHERE met <> was),
st AS (SELECT *, lead(tick) OVER (PARTITION BY rule, series ORDER BY tick) AS resolved_at FROM tu),
he AS (SELECT rule, series, severity, tick AS started, resolved_at, hold, coalesce(resolved_at, (SELECT max(tick) FROM ju)) - tick >= hold AS held FROM st WHERE met)"""


@query("held_alerts", "J13 J14 J15", f"""WITH {HELD} SELECT rule, series, severity, started, CASE WHEN held THEN started + hold END AS fired_at, resolved_at,
  CASE WHEN NOT held THEN 'pending' WHEN resolved_at IS NULL THEN 'firing' ELSE 'resolved' END AS state FROM he WHERE held OR resolved_at IS NULL""")
def held_alerts(spark, root):
    """All twelve rules with their hold times: pending, firing and resolved stretches of every series."""
    return mon.held_alerts(mon.judged_samples(alert_samples(events(spark, root)), mon.rule_table(spark)))


SUSTAINED = f"""{EV}, tk AS (SELECT service, sec // 3600 * 3600 AS tick, avg(is_error::INT) > 0.05 AS firing FROM ev GROUP BY ALL),
isl AS (SELECT service, tick, tick - row_number() OVER (PARTITION BY service ORDER BY tick) * 3600 AS g FROM tk WHERE firing),
su AS (SELECT service, min(tick) AS started, max(tick) AS ended FROM isl GROUP BY service, g)"""


def error_ticks(spark, root):
    tick = (F.expr("sec div 3600") * 3600).alias("tick")
    return events(spark, root).groupBy("service", tick).agg((F.avg(F.col("is_error").cast("int")) > mon.ERROR_RATIO_LIMIT).alias("firing"))


@query("sustained_alerts", "J15", f"WITH {SUSTAINED} SELECT service, started, ended FROM su WHERE ended - started >= 7200")
def sustained_alerts(spark, root):
    """Stretches of at least two hours with a high error ratio at every hourly tick."""
    return aggregates.sustained(error_ticks(spark, root), ["service"], "tick", "firing", 3600, 7200)


@query("alert_groups", "J16", f"""WITH {SUSTAINED}, al AS (SELECT 'errors_' || (started // 86400 % 3) AS alertname, service, started, CASE WHEN ended - started >= 10800 THEN 'critical' ELSE 'warning' END AS severity FROM su)
SELECT alertname, severity, service, count(*) AS n, min(started) AS started FROM al a WHERE NOT (severity = 'warning' AND EXISTS (SELECT 1 FROM al c WHERE c.severity = 'critical' AND c.alertname = a.alertname AND c.service = a.service)) GROUP BY ALL""")
def alert_groups(spark, root):
    """Alerts grouped by name, severity and service; warnings under a critical alert are dropped."""
    found = aggregates.sustained(error_ticks(spark, root), ["service"], "tick", "firing", 3600, 0)
    alerts = found.select(F.concat(F.lit("errors_"), F.pmod(F.expr("started div 86400"), F.lit(3)).cast("string")).alias("alertname"), "service", "started",
                          F.when(F.col("ended") - F.col("started") >= 10800, "critical").otherwise("warning").alias("severity"))
    return mon.grouped_alerts(mon.without_inhibited(alerts))


# Log lines: events written in the formats of five containers.
CONTAINERS = ["/rag-query-analysis", "/rag-document-retrieval", "/rag-postgres", "/rag-redis", "/other"]


def log_lines(ev):
    """(event_id, sec, container, line): every event as the log line its container would write."""
    stamp = F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss")
    level = F.when(F.col("is_error"), "ERROR").otherwise("Info")
    as_json = F.to_json(F.struct(
        level.alias("level"), F.concat(F.col("event_type"), F.lit(" handled")).alias("message"), stamp.alias("timestamp"), F.col("user_id").cast("string").alias("user_id"),
        F.col("value").alias("duration_ms"), F.when(F.col("is_error"), 500).otherwise(200).alias("status_code"), F.when(F.col("is_error"), "Timeout").alias("error_type")))
    postgres = F.concat(stamp, F.lit(".123 UTC ["), F.col("event_id").cast("string"), F.lit("] "), F.upper(level), F.lit(":  "), F.col("event_type"), F.lit(" done"))
    redis = F.concat(F.col("event_id").cast("string"), F.lit(":M "), F.date_format(F.col("ts"), "dd MMM yyyy HH:mm:ss"), F.lit(".123 "), F.when(F.col("is_error"), "#").otherwise("*"), F.lit(" "), F.col("event_type"))
    line = F.when(F.col("service") == 2, postgres).when(F.col("service") == 3, redis).otherwise(as_json)
    container = F.get(F.array(*[F.lit(c) for c in CONTAINERS]), F.col("service").cast("int"))
    return ev.select("event_id", "sec", container.alias("container"), line.alias("line"))


@query("parsed_log_lines", "J17 A8", f"""WITH {EV} SELECT event_id, CASE service WHEN 0 THEN 'query-analysis' WHEN 1 THEN 'document-retrieval' WHEN 2 THEN 'postgres' WHEN 3 THEN 'redis' ELSE '' END AS service,
  CASE WHEN service = 2 THEN CASE WHEN is_error THEN 'ERROR' ELSE 'INFO' END WHEN service = 3 THEN CASE WHEN is_error THEN '#' ELSE '*' END ELSE CASE WHEN is_error THEN 'error' ELSE 'info' END END AS level,
  CASE WHEN service = 2 THEN event_type || ' done' WHEN service = 3 THEN event_type ELSE event_type || ' handled' END AS message, CASE WHEN service NOT IN (2, 3) THEN value END AS duration_ms,
  CASE WHEN service NOT IN (2, 3) AND is_error THEN 'Timeout' END AS error_type, sec FROM ev""")
def parsed_log_lines(spark, root):
    """Log lines of all containers parsed back into fields."""
    lines = log_lines(events(spark, root)).withColumn("svc", mon.service_of(F.col("container")))
    return parse_lines(lines)


def parse_lines(lines):
    """(event_id, service, level, message, ...) from raw lines, JSON or database format."""
    fields = "level string, message string, timestamp string, duration_ms double, error_type string"
    j = lines.withColumn("j", F.from_json("line", fields)).withColumns(mon.parse_database_line(F.col("svc"), F.col("line")))
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', to_timestamp_ntz(j.timestamp, 'yyyy-MM-dd HH:mm:ss'))")
    stamp = F.regexp_extract("line", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)|:M (\d\d \w{3} \d{4} \d\d:\d\d:\d\d)", 0)
    db_at = F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.regexp_replace(stamp, "^:M ", ""), F.lit("dd MMM yyyy HH:mm:ss")))
    since = F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), db_at.cast("timestamp_ntz"))
    at = F.coalesce(at, since)
    return j.select("event_id", F.col("svc").alias("service"), F.coalesce("db_level", F.lower("j.level")).alias("level"), F.coalesce("db_message", "j.message").alias("message"),
                    "j.duration_ms", "j.error_type", at.alias("sec"))


@query("container_services", "J18", f"WITH {EV} SELECT CASE service WHEN 0 THEN 'query-analysis' WHEN 1 THEN 'document-retrieval' WHEN 2 THEN 'postgres' WHEN 3 THEN 'redis' ELSE '' END AS service, count(*) AS lines FROM ev GROUP BY 1")
def container_services(spark, root):
    """Lines per service, named after its container."""
    lines = log_lines(events(spark, root))
    return lines.groupBy(mon.service_of(F.col("container")).alias("service")).agg(F.count("*").alias("lines"))


#: Service and level of every line as its container writes them.
LOG_FIELDS = """CASE service WHEN 0 THEN 'query-analysis' WHEN 1 THEN 'document-retrieval' WHEN 2 THEN 'postgres' WHEN 3 THEN 'redis' ELSE '' END AS service,
  CASE WHEN service = 2 THEN CASE WHEN is_error THEN 'ERROR' ELSE 'INFO' END WHEN service = 3 THEN CASE WHEN is_error THEN '#' ELSE '*' END
       ELSE CASE WHEN is_error THEN 'error' ELSE 'info' END END AS level"""


@query("log_counts", "J19", f"WITH {EV} SELECT sec // 60 * 60 AS minute, {LOG_FIELDS}, count(*) AS lines FROM ev GROUP BY ALL")
def log_counts(spark, root):
    """Lines per minute, service and level, of all containers."""
    return parsed_log_lines(spark, root).groupBy((F.expr("sec div 60") * 60).alias("minute"), "service", "level").agg(F.count("*").alias("lines"))


@query("log_selection", "B20", f"WITH {EV} SELECT event_id, CASE service WHEN 0 THEN 'query-analysis' ELSE 'document-retrieval' END AS service FROM ev WHERE service IN (0, 1) AND is_error AND value > 20")
def log_selection(spark, root):
    """Lines of allowed services at level error that mention a timeout and took over 20 ms."""
    lines = parsed_log_lines(spark, root)
    keep = F.col("service").rlike("^(query-analysis|document-retrieval|document-ranking|latex-parser|llm-generation|response-formatter)$")
    return lines.filter(keep & (F.col("level") == "error") & F.col("error_type").contains("Time") & (F.col("duration_ms") > 20)).select("event_id", "service")


@query("top_series", "J20", f"""WITH {EV}, r AS (SELECT * FROM ev WHERE us > (SELECT max(us) FROM ev) - 86400000000), c AS (SELECT 'query' AS kind, k::VARCHAR AS name, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'type', event_type, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'user', user_id::VARCHAR, count(*) FROM r GROUP BY ALL)
SELECT * FROM (SELECT kind, name, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS rank FROM c) WHERE rank <= CASE kind WHEN 'user' THEN 20 ELSE 10 END""")
def top_series(spark, root):
    """Most frequent queries, types and users of the last day."""
    ev = events(spark, root)
    recent = ev.filter(F.col("us") > ev.agg(F.max("us")).scalar() - 86400000000)
    names = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("name")) for kind, c in (("query", "k"), ("type", "event_type"), ("user", "user_id"))])
    counts = recent.select(F.inline(names)).groupBy("kind", "name").agg(F.count("*").alias("n"))
    ranked = top_k(counts, ["kind"], [F.col("n").desc(), F.col("name")], 20)
    return ranked.filter(F.col("rank") <= F.when(F.col("kind") == "user", 20).otherwise(10))


@query("change_counts", "J21", f"""WITH {EV}, c AS (SELECT service, day, event_type <> lag(event_type) OVER (PARTITION BY service ORDER BY us, event_id) AS ch, user_id, event_type, value FROM ev)
SELECT service, day, sum(coalesce(ch, FALSE)::INT)::BIGINT AS changes, count(DISTINCT user_id) AS users, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END)::BIGINT AS lag, round(sum(value), 2) AS total_ms FROM c GROUP BY ALL""")
def change_counts(spark, root):
    """Changes of state, distinct users, published minus consumed and total time per service and day."""
    ev = events(spark, root).withColumn("_hour", F.expr("sec div 3600"))
    seen = aggregates.previous_value(ev, ["service"], "_hour", ["us", "event_id"], "event_type", "p")
    return seen.groupBy("service", "day").agg(
        F.sum(F.coalesce(F.col("event_type") != F.col("p"), F.lit(False)).cast("long")).alias("changes"), F.count_distinct("user_id").alias("users"),
        F.sum(F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)).alias("lag"), F.round(F.sum("value"), 2).alias("total_ms"))


@query("audit_records", "J23 H15", f"""WITH {AUDIT}, {QUESTIONS} SELECT event_id, audit_type, status, CASE WHEN len(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview, len(text) AS query_length, audit_type IN ('login_failure') AS security FROM au LEFT JOIN qs USING (k)""")
def audit_records(spark, root):
    """Audit records with a shortened question and its length."""
    asked = questions(spark, root)
    preview = F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text"))
    return audit(events(spark, root)).join(asked, "k", "left").select(
        "event_id", "audit_type", "status", preview.alias("preview"), F.length("text").alias("query_length"), F.col("audit_type").isin("login_failure").alias("security"))


@query("request_completions", "J24", f"""WITH {EV} SELECT s.event_id AS submitted_id, c.event_id AS completed_id, c.us - s.us AS took_us FROM ev s LEFT JOIN ev c ON c.event_type = 'click' AND c.user_id = s.user_id AND c.us >= s.us AND c.us <= s.us + 43200000000 WHERE s.event_type = 'view'""")
def request_completions(spark, root):
    """Submitted queries with the completions of the same user within twelve hours; lost ones stay."""
    ev = events(spark, root)
    submitted = ev.filter("event_type = 'view'").select(F.col("event_id").alias("submitted_id"), "user_id", F.col("us").alias("s_us"), F.expr("us div 43200000000").alias("_b"))
    completed = ev.filter("event_type = 'click'").select(F.col("event_id").alias("completed_id"), F.col("user_id").alias("c_user"), F.col("us").alias("c_us"))
    # A completion can belong to submissions of its own half-day block or the one before.
    completed = completed.withColumn("c_b", F.explode(F.array(F.expr("c_us div 43200000000"), F.expr("c_us div 43200000000 - 1"))))
    near = (F.col("user_id") == F.col("c_user")) & (F.col("_b") == F.col("c_b")) & (F.col("c_us") >= F.col("s_us")) & (F.col("c_us") <= F.col("s_us") + 43200000000)
    return submitted.join(completed, near, "left").select("submitted_id", "completed_id", (F.col("c_us") - F.col("s_us")).alias("took_us"))
