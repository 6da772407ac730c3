"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. New documents are reduced to one row per digest, dropped where
the index already holds the digest (an anti-join that reads the index without shuffling it), and appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.names import row_hash, unused
from corpusflow.session import fresh_path, materialize

BUCKETS = 64


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text) -> Column:
    """SHA-256 of the text in UTF-8 with A-Z lower-cased; null counts as empty."""
    # lower() would change letters beyond A-Z too
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row, repeated rows and rows with a null id included."""
    return docs.select(F.col("doc_id"), text_digest(F.col("text").cast("string")).alias("digest"))


class DigestIndex:
    """Digests seen so far, each with the document that stays for it."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def ingest(self, hashed: DataFrame) -> None:
        """Add the digests that the index does not hold yet.

        Of equal new texts the largest doc_id stays (null ids come last); a digest that an earlier call has added
        keeps its document. Rows are combined before the shuffle, so a text with millions of copies is one row per
        task. An empty input leaves the index as it is.
        """
        fresh = hashed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        if self.exists():
            known = self.read().select("digest").hint("merge")
            fresh = fresh.join(known, "digest", "left_anti")
        # one writer task for each bucket, so that a bucket gets one file per call
        (fresh.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest")
         .format("parquet").mode("append").saveAsTable(self.name))


def deduplicated(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """Every row of ``docs`` with the document that stays for its text.

    Columns: doc_id, keep_id, group_size, kept, text_sha256. The rows reach the index in ``batches`` calls by
    descending doc_id, so the largest doc_id of equal texts is the one that stays. Null texts count as empty. Rows
    with a null doc_id come last and stay only if no other row has their text. Of rows that repeat both doc_id and
    text one is kept. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark)
    path = fresh_path(spark, "digests")
    digests(docs).write.parquet(path)  # the texts are read and hashed once
    hashed = spark.read.parquet(path)
    shares = [k / batches for k in range(batches - 1, 0, -1)]
    cuts = hashed.agg(F.percentile_approx("doc_id", shares).alias("c")).first().c if shares else []
    cuts = sorted(set(cuts or []), reverse=True)
    upper = None
    for cut in [*cuts, None]:
        part = hashed
        if cut is not None:
            part = part.filter(F.col("doc_id") >= cut)
        if upper is not None:
            part = part.filter((F.col("doc_id") < upper) | F.col("doc_id").isNull())
        index.ingest(part)
        upper = cut
    rows = hashed.groupBy("digest", "doc_id").agg(F.count("*").alias("repeats"))
    sizes = rows.groupBy("digest").agg(F.sum("repeats").alias("group_size"))
    kept = index.read().select("digest", "keep_id")
    if own:  # an index of this call alone leaves no table behind
        kept = materialize(kept, "kept")
        index.drop()
    return (
        rows.join(sizes, "digest").join(kept, "digest")
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
        .select("doc_id", "keep_id", F.col("group_size").cast("long"),
                (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
                F.col("digest").alias("text_sha256"))
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the largest doc_id, null ids last.

    Of rows that repeat both doc_id and text one stays, the one with the smallest hash of its other columns. Columns may
    have any names: helper names are made so that ``docs`` does not use them. An empty table stays empty.
    """
    key, sha, place = (unused(docs, n) for n in ("key", "sha", "place"))
    # rows are dealt once by this key, which is never null: the join and the window both find them there
    named = lambda c: F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit(""))
    marks = deduplicated(docs).filter("kept").select(named(F.col("doc_id")).alias(key), F.col("text_sha256").alias(sha))
    hashed = docs.withColumn(key, named(F.col("doc_id"))).withColumn(sha, text_digest(F.col("text").cast("string")))
    first = Window.partitionBy(key, sha).orderBy(row_hash(docs))
    return hashed.join(marks, [key, sha]).withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).select(*docs.columns)
