"""Structured Streaming jobs. Each has a batch twin in the operators it reuses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.session import fresh_path
from corpusflow.sources.tables import metric_roles
from corpusflow.streaming.stateful import keyed_state

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# Fixed value: shape of a query.analyzed message.
MESSAGE_SCHEMA = ("query_id string, user_id string, session_id string, timestamp string, processing_time_ms double, "
                  "analysis struct<original_query:string,normalized_query:string,keywords:array<string>,"
                  "entities:array<struct<text:string,label:string>>,intent:struct<intent:string,confidence:double>,language:string>")


def read_table(spark: SparkSession, root: str, name: str, schema, files: int | None = None) -> DataFrame:
    """A table as a stream: a folder of files, or one file of that name."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{root}/{name}.parquet")
    # a stream watches folders; the filter is matched against the names of files
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)


def event_stream(spark: SparkSession, root: str, delay: str = "1 hour") -> DataFrame:
    """Events with their metric roles and a watermark on ``at``."""
    return metric_roles(read_table(spark, root, "events", EVENT_SCHEMA)).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)


def drain(stream: DataFrame, name: str, sink: Callable[[DataFrame, int, str], None] | None = None, mode: str = "append",
          path: str | None = None, fmt: str = "parquet") -> str:
    """Run a stream over all data at hand and return the folder it filled.

    Without ``sink`` rows go to a file sink, which is exactly-once. A sink function
    gets (batch, id, folder) and must be repeatable for one id.
    """
    path = path or fresh_path(stream.sparkSession, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True)
    with keyed_state(stream.sparkSession):
        if sink is None:
            query = writer.format(fmt).start(f"{path}/data")
        else:
            query = writer.foreachBatch(lambda batch, number: sink(batch, number, path)).start()
        query.awaitTermination()
    return path


def by_batch(batch: DataFrame, number: int, path: str) -> None:
    """Sink: one folder per batch, overwritten when a batch is replayed."""
    batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current rows of an update-mode stream: the last batch that touched a key wins."""
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data/batch=*")
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


# --- messages -------------------------------------------------------------------------

def as_messages(events: DataFrame) -> DataFrame:
    """Events as query.analyzed messages (column value); every tenth user is unknown, sessions may be missing."""
    known = F.pmod("user_id", F.lit(10)) != 0
    analysis = F.struct(
        F.concat_ws(" ", "event_type", F.col("k").cast("string")).alias("original_query"), F.concat_ws(" ", "event_type", F.col("k").cast("string")).alias("normalized_query"),
        F.array("event_type").alias("keywords"), F.struct(F.col("event_type").alias("intent"), F.lit(0.9).alias("confidence")).alias("intent"))
    body = F.struct(
        F.col("event_id").cast("string").alias("query_id"), F.when(known, F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("k") < 50, F.col("k").cast("string")).alias("session_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(F.col("value") > 1, F.col("value")).alias("processing_time_ms"), analysis.alias("analysis"))
    return events.select(F.to_json(body).alias("value"))


def publish(events: DataFrame, name: str = "messages") -> str:
    """Write events as message files; a broker sink takes the same column."""
    return drain(as_messages(events), name, fmt="text")


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Message stream with the parsed body in ``m``; rows that do not parse have a null query id."""
    return spark.readStream.text(f"{path}/data").select("value", F.from_json("value", MESSAGE_SCHEMA).alias("m"))


def history_rows(parsed: DataFrame) -> DataFrame:
    """History records: defaults for missing parts, nested parts as JSON text."""
    blank = F.lit("")
    return parsed.filter("m.query_id is not null").select(
        F.col("m.query_id").alias("query_id"), F.coalesce("m.user_id", F.lit("anonymous")).alias("user_id"), F.coalesce("m.session_id", blank).alias("session_id"),
        F.coalesce("m.timestamp", blank).alias("timestamp"), F.coalesce("m.analysis.original_query", blank).alias("original_query"),
        F.coalesce("m.analysis.normalized_query", blank).alias("normalized_query"), F.coalesce(F.to_json("m.analysis.keywords"), F.lit("[]")).alias("keywords"),
        F.coalesce(F.to_json("m.analysis.entities"), F.lit("[]")).alias("entities"), F.coalesce(F.to_json("m.analysis.intent"), F.lit("{}")).alias("intent"),
        F.coalesce("m.processing_time_ms", F.lit(0.0)).alias("processing_time_ms"))


def unreadable(parsed: DataFrame) -> DataFrame:
    """Messages kept aside because they do not parse."""
    return parsed.filter("m.query_id is null").select("value")


# --- stateful jobs --------------------------------------------------------------------

def daily_counts(events: DataFrame) -> DataFrame:
    """Live counters per day and type."""
    return events.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total_ms"), F.approx_count_distinct("user_id").alias("users")
    ).select(F.to_date("w.start").alias("day"), "event_type", "n", "total_ms", "users")


def once_only(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Redelivered events dropped; state is kept only as long as the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def closed_sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    return events.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.min("sec").alias("started"), F.max("sec").alias("ended")).select(
        "user_id", "started", "ended", "n")


def completions(events: DataFrame, timeout: str = "12 hours", how: str = "inner") -> DataFrame:
    """Submitted and completed events of one user joined within the timeout; outer joins report lost ones when time is up."""
    submitted = events.filter("event_type = 'view'").select(F.col("event_id").alias("submitted_id"), F.col("user_id").alias("s_user"), F.col("at").alias("s_at"), F.col("us").alias("s_us"))
    completed = events.filter("event_type = 'click'").select(F.col("event_id").alias("completed_id"), F.col("user_id").alias("c_user"), F.col("at").alias("c_at"), F.col("us").alias("c_us"))
    near = F.expr(f"s_user = c_user AND c_at >= s_at AND c_at <= s_at + interval {timeout}")
    return submitted.join(completed, near, how).select("submitted_id", "completed_id", (F.col("c_us") - F.col("s_us")).alias("took_us"))


def upload_sink(chunker):
    """Sink for uploads: a batch's chunks and outcomes go to folders of that batch.

    Nothing stored before is rewritten; :func:`current_chunks` gives the last
    version of every chunk.
    """

    def sink(batch: DataFrame, number: int, path: str) -> None:
        spark = batch.sparkSession
        chunks = chunker(batch.filter("text is not null and trim(text) <> ''"))
        chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        stored = spark.read.parquet(f"{path}/chunks/batch={number}").groupBy("doc_id").agg(F.count("*").alias("chunks"))
        outcome = batch.select("doc_id").join(stored, "doc_id", "left").select(
            "doc_id", F.col("chunks").isNotNull().alias("success"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"),
            F.when(F.col("chunks").isNull(), "no text").otherwise("").alias("error"))
        outcome.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    return sink


def current_chunks(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Uploaded chunks, last upload wins."""
    rows = spark.read.option("basePath", f"{path}/chunks").parquet(f"{path}/chunks/batch=*")
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(key, *[f"_r.{c}" for c in rest])
