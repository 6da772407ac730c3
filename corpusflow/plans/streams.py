"""Streaming queries: each runs over all data at hand and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import chunking
from corpusflow.operators import monitoring as mon
from corpusflow.operators.ranking import stable
from corpusflow.plans.analytics import CACHE, EV, audit
from corpusflow.plans.corpus import windows_sql
from corpusflow.plans.registry import query
from corpusflow.plans.timeseries import AUDIT, LIMIT, LOG_FIELDS, _hop, log_lines, parse_lines, seconds
from corpusflow.streaming import jobs, stateful


def _data(spark, path):
    return spark.read.parquet(f"{path}/data")


def _batches(spark, path):
    return spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data/batch=*").drop("batch")


@query("stream_history", "A6 A7 J1", f"""WITH {EV} SELECT event_id::VARCHAR AS query_id, CASE WHEN user_id % 10 <> 0 THEN user_id::VARCHAR ELSE 'anonymous' END AS user_id, CASE WHEN k < 50 THEN k::VARCHAR ELSE '' END AS session_id,
 event_type || ' ' || k AS original_query, '["' || event_type || '"]' AS keywords, '[]' AS entities, '{{"intent":"' || event_type || '","confidence":0.9}}' AS intent, CASE WHEN value > 1 THEN value ELSE 0 END AS processing_time_ms FROM ev""")
def stream_history(spark, root):
    """Events published as messages, consumed again and stored as history with defaults."""
    sent = jobs.publish(jobs.event_stream(spark, root))
    stored = jobs.drain(jobs.history_rows(jobs.messages(spark, sent)), "history")
    return _data(spark, stored).drop("timestamp", "normalized_query")


@query("stream_daily_counts", "J2 H1 H3", f"WITH {EV} SELECT day, event_type, count(*) AS n, round(sum(value), 4) AS total_ms FROM ev GROUP BY ALL")
def stream_daily_counts(spark, root):
    """Live daily counters, latest state per day and type."""
    path = jobs.drain(jobs.daily_counts(jobs.event_stream(spark, root)), "daily", jobs.by_batch, "update")
    return jobs.latest_updates(spark, path, ["day", "event_type"]).select("day", "event_type", "n", F.round("total_ms", 4).alias("total_ms"))


@query("stream_deduplicated", "J3", f"WITH {EV} SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM ev GROUP BY 1")
def stream_deduplicated(spark, root):
    """Every event delivered three times and counted once."""
    again = jobs.event_stream(spark, root).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    kept = jobs.once_only(again).select("event_id", "event_type")
    return _data(spark, jobs.drain(kept, "dedup")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("stream_request_limiter", "J4 J5", f"WITH {EV}, " + LIMIT.format(s=3600, key="service", limit=2))
def stream_request_limiter(spark, root):
    """Request limiter over the stream, counts kept as keyed state until their window is over."""
    path = jobs.drain(stateful.limited(jobs.event_stream(spark, root), ["service"], 2, 3600), "limiter")
    return _data(spark, path).select("event_id", "window_start", "allowed", "remaining", "reset_time", "retry_after")


@query("stream_cache", "J8", f"WITH {CACHE} SELECT read_id, k, sec, w[1] AS cached_at, w[3] AS payload, w IS NOT NULL AS hit FROM looked")
def stream_cache(spark, root):
    """Cache lookups over the stream, entries expiring after two hours."""
    kind = F.col("event_type")
    found = stateful.cached(jobs.event_stream(spark, root), 7200, kind.isin("view", "signup", "purchase"), kind.isin("click", "error"))
    return _data(spark, jobs.drain(found, "cache"))


@query("stream_sessions", "J9", f"""WITH {EV}, g AS (SELECT user_id, us, sec, CASE WHEN us - lag(us) OVER w > 3600000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS id FROM g)
SELECT user_id, min(sec) AS started, max(sec) AS ended, count(*) AS n FROM i GROUP BY user_id, id HAVING max(us) // 1000 + 3600000 <= (SELECT max(us) FROM ev) // 1000 - 3600000""")
def stream_sessions(spark, root):
    """Sessions closed by an hour of silence, up to the watermark."""
    return _data(spark, jobs.drain(jobs.closed_sessions(jobs.event_stream(spark, root)), "sessions"))


@query("stream_event_rates", "J10", f"""WITH {EV}, w AS (SELECT service, {_hop(3600, 900)} AS start FROM ev) SELECT service, start, count(*) AS n, round(count(*) / 3600.0::DOUBLE, 9) AS rate FROM w
WHERE (start + 3600) * 1000 <= (SELECT max(us) FROM ev) // 1000 - 3600000 GROUP BY ALL""")
def stream_event_rates(spark, root):
    """Sliding rates of windows that are complete."""
    out = mon.sliding(jobs.event_stream(spark, root), ["service"], "at", "1 hour", "15 minutes", {"n": F.count("*")})
    done = _data(spark, jobs.drain(out, "rates")).withColumn("start", F.col("start").cast("timestamp_ntz"))
    return done.select("service", seconds("start").alias("start"), "n", stable(F.col("n") / 3600).alias("rate"))


@query("stream_error_ratios", "J11 J7", f"""WITH {EV}, w AS (SELECT service, is_error, {_hop(21600, 3600)} AS start FROM ev) SELECT service, start, count(*) AS n, round(avg(is_error::INT), 9) AS error_ratio, avg(is_error::INT) > 0.05 AS high_errors FROM w
WHERE (start + 21600) * 1000 <= (SELECT max(us) FROM ev) // 1000 - 168 * 3600000 GROUP BY ALL""")
def stream_error_ratios(spark, root):
    """Error ratios of complete windows, waiting a week for late samples."""
    out = mon.sliding(jobs.event_stream(spark, root, "168 hours"), ["service"], "at", "6 hours", "1 hour", {"n": F.count("*"), "e": F.avg(F.col("is_error").cast("int"))})
    done = _data(spark, jobs.drain(out, "ratios")).withColumn("start", F.col("start").cast("timestamp_ntz"))
    return done.select("service", seconds("start").alias("start"), "n", stable(F.col("e")).alias("error_ratio"), (F.col("e") > mon.ERROR_RATIO_LIMIT).alias("high_errors"))


@query("stream_log_counts", "J17 J19 A8", f"""WITH {EV} SELECT sec // 60 * 60 AS minute, {LOG_FIELDS}, count(*) AS lines FROM ev
WHERE (sec // 60 * 60 + 60) <= (SELECT max(sec) FROM ev) - 3600 GROUP BY ALL""")
def stream_log_counts(spark, root):
    """Log lines of all containers parsed from the stream and counted per minute, service and level."""
    raw = jobs.metric_roles(jobs.read_table(spark, root, "events", jobs.EVENT_SCHEMA))
    lines = log_lines(raw).withColumn("svc", mon.service_of(F.col("container")))
    parsed = parse_lines(lines).withColumn("at", F.timestamp_seconds("sec")).withWatermark("at", "1 hour")
    counts = parsed.groupBy(F.window("at", "1 minute").alias("w"), "service", "level").agg(F.count("*").alias("lines"))
    return _data(spark, jobs.drain(counts, "loglines")).select(F.unix_timestamp("w.start").alias("minute"), "service", "level", "lines")


@query("stream_audit", "J23", f"WITH {AUDIT} SELECT event_id, audit_type, status, audit_type = 'login_failure' AS security FROM au")
def stream_audit(spark, root):
    """Audit records written as they arrive."""
    out = audit(jobs.event_stream(spark, root)).select("event_id", "audit_type", "status", (F.col("audit_type") == "login_failure").alias("security"))
    return _data(spark, jobs.drain(out, "audit"))


@query("stream_completions", "J24", f"""WITH {EV} SELECT s.event_id AS submitted_id, c.event_id AS completed_id, c.us - s.us AS took_us FROM ev s JOIN ev c ON c.event_type = 'click' AND c.user_id = s.user_id AND c.us >= s.us AND c.us <= s.us + 43200000000 WHERE s.event_type = 'view'""")
def stream_completions(spark, root):
    """Stream-stream join of submitted queries with their completions."""
    return _data(spark, jobs.drain(jobs.completions(jobs.event_stream(spark, root)), "completions"))


@query("stream_uploads", "A11 J22", f"""WITH c AS (SELECT doc_id, count(*) AS n FROM ({windows_sql(128, 12, 128)}) GROUP BY 1) SELECT doc_id, n IS NOT NULL AS success, coalesce(n, 0) AS chunks, CASE WHEN n IS NULL THEN 'no text' ELSE '' END AS error FROM documents LEFT JOIN c USING (doc_id)""")
def stream_uploads(spark, root):
    """Documents arriving as a stream: cut, keyed, upserted, with an outcome per document."""

    def chunker(batch):
        parts = chunking.word_windows(batch.select("doc_id", "text", "lang"), 128, 12, min_share=128)
        key = F.md5(F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
        return parts.select(key.alias("id"), "doc_id", F.col("lang").alias("collection"), "chunk")

    stream = jobs.read_table(spark, root, "documents", jobs.DOCUMENT_SCHEMA)
    return _batches(spark, jobs.drain(stream, "uploads", jobs.upload_sink(chunker)))
