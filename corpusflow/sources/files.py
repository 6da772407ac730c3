"""File drops, dataset folders and text decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def kind_of(path: Column) -> Column:
    """Parser by file ending; unknown endings are tried as text."""
    name = F.lower(path)
    return (F.when(name.endswith(".pdf"), "pdf").when(name.endswith(".docx"), "docx")
            .when(name.endswith(".md"), "md").otherwise("txt"))


def decode_text(raw: Column) -> Column:
    """UTF-8 where the bytes are valid, Latin-1 otherwise."""
    as_text = raw.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(raw, "ISO-8859-1"))


def dropped_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, text) of a folder of uploads; pdf and docx bytes are left to a plugged decoder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", kind_of(F.col("path")).alias("kind"), "content").withColumn(
        "text", F.when(F.col("kind").isin("txt", "md"), decode_text(F.col("content")))).drop("content")


def judged_dataset(spark: SparkSession, folder: str, split: str = "test"):
    """(corpus, queries, qrels) of a retrieval data set folder: two JSON-lines files and a tab-separated one."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    qrels = (spark.read.option("sep", "\t").option("header", True)
             .schema("`query-id` string, `corpus-id` string, score int").csv(f"{folder}/qrels/{split}.tsv"))
    return (
        corpus.select(F.col("_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), "text"),
        queries.select(F.col("_id").alias("query_id"), "text"),
        qrels.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"), F.col("score").alias("rel")),
    )


def parsed_logs(lines: DataFrame) -> DataFrame:
    """JSON log lines (column value) to fields; three time formats are tried in turn."""
    fields = ("level string, message string, timestamp string, service string, correlation_id string, "
              "user_id string, request_id string, duration_ms double, status_code int, path string, method string, "
              "error_type string, error_message string")
    parsed = lines.select("value", F.from_json("value", fields).alias("j"))
    ts = F.coalesce(
        F.try_to_timestamp(F.col("j.timestamp")),
        F.try_to_timestamp(F.col("j.timestamp"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")),
        F.try_to_timestamp(F.col("j.timestamp"), F.lit("yyyy-MM-dd HH:mm:ss")))
    return parsed.select(ts.alias("ts"), F.lower("j.level").alias("level"), "j.message", "j.service", "j.correlation_id",
                         "j.user_id", "j.request_id", "j.duration_ms", "j.status_code", "j.path", "j.method",
                         "j.error_type", "j.error_message")
