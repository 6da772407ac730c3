"""Scans of the corpus tables. Catalyst prunes columns and pushes filters into these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def epoch_micros(column: str = "ts"):
    """Microseconds since 1970 of a zone-free timestamp, independent of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def events(spark: SparkSession, root: str) -> DataFrame:
    """Events with the metric roles: service, error flag, latency, day and epoch seconds."""
    return metric_roles(table(spark, root, "events"))


def metric_roles(raw: DataFrame) -> DataFrame:
    micros = epoch_micros("ts")
    return raw.select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        micros.alias("us"),
        F.floor(micros / F.lit(1_000_000)).cast("long").alias("sec"),
        F.to_date("ts").alias("day"),
        F.pmod("user_id", F.lit(5)).alias("service"),
        (F.col("event_type") == "error").alias("is_error"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def queries_of(spark: SparkSession, root: str) -> DataFrame:
    """Search queries: every benchmark item."""
    return table(spark, root, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def user_turns(spark: SparkSession, root: str) -> DataFrame:
    """User questions of all conversations, keyed by one id."""
    return (
        table(spark, root, "conversations")
        .filter(F.col("role") == "user")
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "turn", "text")
    )


def token_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Embeddings regrouped as token vectors: eight consecutive vectors form a document."""
    return table(spark, root, "embeddings").select(
        F.expr("vec_id div 8").alias("doc_id"),
        F.pmod("vec_id", F.lit(8)).alias("pos"),
        F.col("embedding").alias("vec"),
        "label",
    )


def spread(df: DataFrame) -> DataFrame:
    """Spread a table stored in fewer splits than there are cores.

    Text functions dominate such jobs, and one split would run them on one
    core. Tables with enough splits are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
