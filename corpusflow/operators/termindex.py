"""A stored inverted index: built once, extended and thinned out, read by every BM25 search.

Documents are packed into ranges where they are scanned. A posting row has one word's documents within one range, with
the largest count and the smallest length among them, from which a bound of the word's weight in the range follows for
any corpus average. Posting rows are bucketed and sorted by word, so a search reads the words that are asked for and no
text. Documents are added as new segments and removed by marks on their places; a segment counts from the moment its
row in the segment table is written, so a failed build leaves nothing that a search would see.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import tokens
from corpusflow.operators.dense import BROADCAST_BLOCKS, BROADCAST_BYTES
from corpusflow.operators.maxscore import packed as loaded, searcher
from corpusflow.operators.ranking import best_hits
from corpusflow.operators.sparse import QUERY_BLOCK, WEIGHT_BLOCK, WEIGHT_BYTES, query_terms, saturated_tf, smoothed_idf, tile_hits
from corpusflow.session import arrow_batches, materialize

#: A range is large, as a word takes one row in each range it stands in.
RANGE_DOCS, RANGE_WORDS = 2048, 1_000_000
#: Rows and bytes of words that reach Python at once: about a range.
BATCH_ROWS, BATCH_BYTES = 2048, 12 << 20
#: Words of a range that leave Python in one batch.
TERM_ROWS = 4096
#: Bytes of text for each bucket of postings: a writer sorts a bucket, so buckets grow in number and not in size.
BUCKET_BYTES = 24 << 20
#: Bytes that a Parquet writer holds before it writes them out (128 MB by default, in every task).
BLOCK_BYTES = 16 << 20
#: Every PROBE-th range is searched first, for thresholds, when there are at least 2 * PROBE.
PROBE = 16
#: Weights of queries that a cell of the grid for many queries holds, and cells per core.
CELL_WEIGHTS, CELLS_A_CORE = 6_000_000, 2
SEGMENT_SHIFT, PARTITION_SHIFT = 40, 16


def _packed(docs: DataFrame, segment: int) -> DataFrame:
    """Rows of two kinds. One per range: ids and lengths (term is null). One per word of a range: its documents' places and
    counts, the largest count, the smallest length. No row holds more than one word's documents of one range, so readers
    and writers, which take rows by the thousand, hold little whatever the table's size."""
    bags = docs.select("doc_id", tokens("text").alias("bag"))
    ints = T.ArrayType(T.IntegerType())
    kind = T.StructType([
        T.StructField("range", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("lens", ints),
        T.StructField("term", T.StringType()), T.StructField("docs", ints), T.StructField("tfs", ints),
        T.StructField("most", T.IntegerType()), T.StructField("least", T.IntegerType())])
    names = kind.fieldNames()

    def pack(batches):
        from pyspark import TaskContext

        number = 0
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            part = np.maximum(np.cumsum(sizes) // RANGE_WORDS, 0) * (1 << 32) + np.arange(len(sizes)) // RANGE_DOCS
            edges = np.r_[np.flatnonzero(np.diff(part, prepend=-1)), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:]):
                rows, own = batch.slice(start, end - start), sizes[start:end]
                words = rows.column(1).flatten().dictionary_encode()
                kind = np.int32 if len(words.dictionary) * len(own) < 1 << 31 else np.int64
                key = words.indices.to_numpy(zero_copy_only=False).astype(kind) * kind(len(own)) + np.repeat(np.arange(len(own), dtype=kind), own)
                key.sort()  # in place: a range's words are held once
                places = np.flatnonzero(np.diff(key, prepend=kind(-1)))
                key, tf = key[places], np.diff(places, append=len(key))
                word, doc = key // len(own), key % len(own)
                first = np.flatnonzero(np.diff(word, prepend=-1))
                place = (segment << SEGMENT_SHIFT) | (TaskContext.get().partitionId() << PARTITION_SHIFT) | number
                number += 1
                ids, lens, none = one(rows.column(0)), one(pa.array(own, pa.int32())), pa.nulls(1, pa.int32())
                lists = pa.nulls(1, lens.type)
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), ids, lens, pa.nulls(1, pa.string()), lists, lists, none, none], names)
                for low in range(0, len(first), TERM_ROWS):
                    begin, stop = first[low], first[low + TERM_ROWS] if low + TERM_ROWS < len(first) else len(key)
                    of = first[low: low + TERM_ROWS] - begin
                    d, t, n = doc[begin:stop], tf[begin:stop], len(of)
                    offsets = pa.array(np.r_[of, len(d)].astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, place), pa.int64()), pa.nulls(n, ids.type), pa.nulls(n, lens.type), words.dictionary.take(pa.array(word[first[low: low + TERM_ROWS]])),
                         pa.ListArray.from_arrays(offsets, pa.array(d, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(t, pa.int32())),
                         pa.array(np.maximum.reduceat(t, of), pa.int32()), pa.array(np.minimum.reduceat(own[d], of), pa.int32())], names)

    return bags.mapInArrow(pack, kind)


class TermIndex:
    """Postings, ranges, segments and removal marks of one corpus, as tables whose names start with ``name``."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name or f"terms_{uuid.uuid4().hex}"
        self.buckets = buckets

    def _buckets_for(self, docs: DataFrame) -> int:
        """Buckets of the postings: as many as the table has; of a new table, as its first documents need."""
        if self.spark.catalog.tableExists(f"{self.name}_postings"):
            told = self.spark.sql(f"DESCRIBE EXTENDED {self.name}_postings").filter("col_name = 'Num Buckets'").first()
            return int(told.data_type)
        if self.buckets:
            return self.buckets
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def _table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def _append(self, frame: DataFrame, part: str) -> None:
        frame.write.format("parquet").mode("append").saveAsTable(f"{self.name}_{part}")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(f"{self.name}_segments")

    def add(self, docs: DataFrame) -> "TermIndex":
        """Index the documents (doc_id, text) as one more segment. Documents of an id that is there already replace it."""
        docs = docs.select("doc_id", "text")
        if self.exists():
            self.remove(docs)
        segment = uuid.uuid4().int & ((1 << 22) - 1)
        with arrow_batches(self.spark, BATCH_ROWS, BATCH_BYTES):
            packed = materialize(_packed(docs, segment), "ranges", **{"parquet.block.size": BLOCK_BYTES})  # numbers of ranges and places are fixed from here on
        posts = packed.filter("term IS NOT NULL").select("term", "range", F.size("docs").alias("n"), "most", "least", "docs", "tfs")
        ranges = packed.filter("term IS NULL").select("range", "ids", "lens")
        # one writer per bucket, so that a bucket gets one sorted file per segment
        buckets = self._buckets_for(docs)
        (posts.repartition(buckets, "term").write.option("parquet.block.size", BLOCK_BYTES).bucketBy(buckets, "term").sortBy("term").format("parquet")
         .mode("append").saveAsTable(f"{self.name}_postings"))
        self._append(ranges, "ranges")
        size = ranges.select(F.size("lens").alias("docs"), F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x).alias("words"))
        self._append(size.agg(F.coalesce(F.sum("docs"), F.lit(0)).cast("long").alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
                     .select(F.lit(segment).cast("long").alias("segment"), "docs", "words"), "segments")
        return self

    def remove(self, gone: DataFrame) -> "TermIndex":
        """Documents of these ids (doc_id) are no longer found or counted."""
        places = self._live("ranges").select("range", F.posexplode("ids").alias("place", "doc_id"), "lens")
        hit = places.join(gone.select("doc_id").distinct(), "doc_id", "left_semi").select("range", "place", F.get("lens", F.col("place")).alias("words"))
        if self.spark.catalog.tableExists(f"{self.name}_gone"):
            hit = hit.join(self._table("gone"), ["range", "place"], "left_anti")
        self._append(materialize(hit, "gone"), "gone")
        return self

    def drop(self) -> None:
        for part in ("postings", "ranges", "gone", "segments"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")

    def _live(self, part: str) -> DataFrame:
        """Rows of finished segments."""
        done = self._table("segments").select("segment").distinct()
        return self._table(part).join(F.broadcast(done), F.shiftright("range", SEGMENT_SHIFT) == F.col("segment"), "left_semi")  # one row a segment

    def _gone(self) -> DataFrame | None:
        if not self.spark.catalog.tableExists(f"{self.name}_gone"):
            return None
        return self._table("gone")

    def stats(self) -> DataFrame:
        """One row: n_docs and avg_len of the live documents."""
        total = self._table("segments").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
        gone = self._gone()
        if gone is not None:
            less = gone.agg(F.count("*").alias("less"), F.coalesce(F.sum("words"), F.lit(0)).alias("fewer"))
            total = total.crossJoin(less).select((F.col("docs") - F.col("less")).alias("docs"), (F.col("words") - F.col("fewer")).alias("words"))  # one row each
        return total.select(F.col("docs").alias("n_docs"), F.expr("try_divide(words, docs)").alias("avg_len"))

    def doc_lengths(self) -> DataFrame:
        """(doc_id, doc_len) of every live document."""
        every = self._live("ranges").select("range", F.posexplode(F.arrays_zip("ids", "lens")).alias("place", "d"))
        gone = self._gone()
        every = every if gone is None else every.join(gone, ["range", "place"], "left_anti")
        return every.select(F.col("d.ids").alias("doc_id"), F.col("d.lens").alias("doc_len"))

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df) of the live documents, for the asked words or all; reads no posting list unless documents are gone."""
        posts = self._live("postings")
        posts = posts if terms is None else posts.join(terms, "term", "left_semi")
        count = posts.select("term", F.col("n").cast("long").alias("n"))
        gone = self._gone()
        if gone is not None:
            places = gone.groupBy("range").agg(F.collect_set("place").alias("gone"))  # at most a range's documents
            count = count.unionByName(posts.join(places, "range").select("term", (-F.size(F.array_intersect("docs", "gone"))).cast("long").alias("n")))
        return count.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")

    def occurrences(self) -> DataFrame:
        """(term, df, occurrences) of every word of the live documents."""
        posts = self._live("postings").select("range", "term", F.explode(F.arrays_zip("docs", "tfs")).alias("p"))
        gone = self._gone()
        if gone is not None:
            posts = posts.join(gone.select("range", F.col("place").alias("docs")), (posts["range"] == gone["range"]) & (F.col("p.docs") == F.col("docs")), "left_anti")
        return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("p.tfs").alias("occurrences"))

    def search(self, queries: DataFrame, k: int = 10, subset: DataFrame | None = None) -> DataFrame:
        """The k best live documents of every query (query_id, text): query_id, doc_id, score, rank.

        ``subset`` (doc_id) restricts what may be returned; statistics stay those of the whole corpus. Queries are dealt to
        blocks; a block meets a range with the postings of its own words only. With many ranges some are searched
        first, and a query skips the others where the bounds of its words cannot reach its k-th score.
        """
        wanted = materialize(query_terms(queries), "query-terms")
        size = wanted.agg(F.count("*").alias("weights"), F.count_distinct("query_id").alias("queries")).first()
        n_blocks = max(1, -(-size.queries // QUERY_BLOCK), -(-size.weights // WEIGHT_BLOCK))
        stats = self.stats().first()
        df = self.frequencies(wanted.select("term").distinct())
        weights = materialize(wanted.join(df, "term").select(
            F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("long").alias("block"), "query_id", "term",
            (F.col("qtf") * smoothed_idf(F.lit(stats.n_docs or 0), F.col("df"))).alias("weight")), "weights")
        ranges = self._live("ranges")
        if n_blocks > BROADCAST_BLOCKS:
            return self._many(weights, ranges, subset, size.weights, k, stats.avg_len or 1.0, queries.schema["query_id"])
        kinds = T.StructType([queries.schema["query_id"], T.StructField("doc_id", ranges.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])
        count = ranges.count()
        run = lambda some, floors: self._hits(weights, ranges.filter(some), subset, floors, n_blocks, WEIGHT_BYTES * size.weights, count, k, stats.avg_len or 1.0, kinds)
        if count < 2 * PROBE:
            return best_hits(run(F.lit(True), None), k)
        probe = F.pmod(F.xxhash64("range"), F.lit(PROBE)) == 0
        first = materialize(best_hits(run(probe, None), k), "probed")
        floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("hits")).filter(F.col("hits") >= k).drop("hits")
        return best_hits(first.drop("rank").unionByName(run(~probe, floors)), k)

    def _places(self, ranges: DataFrame, subset: DataFrame | None) -> DataFrame:
        """Ranges with the places that are removed (barred) and, for a subset, those that may be found (allowed)."""
        places = ranges.withColumn("barred", F.lit(None).cast("array<int>"))
        gone = self._gone()
        if gone is not None:
            places = ranges.join(gone.groupBy("range").agg(F.collect_set("place").alias("barred")), "range", "left")
        if subset is None:
            return places.withColumn("allowed", F.lit(None).cast("array<int>"))
        inside = ranges.select("range", F.posexplode("ids").alias("place", "doc_id")).join(subset.select("doc_id").distinct(), "doc_id", "left_semi")
        return places.join(inside.groupBy("range").agg(F.collect_list("place").alias("allowed")), "range")

    def _many(self, weights, ranges, subset, n_weights: int, k: int, average: float, query_id: T.StructField) -> DataFrame:
        """Search for many blocks of queries: dealt with the ranges to a grid of cells, which hold queries and let ranges pass.

        A posting goes to every row of cells, of which there is one for CELL_WEIGHTS weights; a query to every column.
        """
        rows = -(-n_weights // CELL_WEIGHTS)
        columns = -(-CELLS_A_CORE * self.spark.sparkContext.defaultParallelism // rows)
        copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        cell = (F.col("_row") * columns + F.col("_column")).cast("int").alias("_cell")
        blocks = (weights.groupBy("block", "query_id").agg(F.collect_list(F.struct("term", "weight")).alias("words"))
                  .groupBy("block").agg(F.collect_list(F.struct("query_id", "words")).alias("asked"))
                  .withColumn("_row", F.pmod("block", F.lit(rows))).withColumn("_column", copies(columns)).select(cell, "asked"))
        dealt = lambda frame, *names: frame.withColumn("_column", F.pmod(F.xxhash64("range"), F.lit(columns))).withColumn("_row", copies(rows)).select(cell, "range", *names)
        posts = self._live("postings").join(weights.select("term").distinct(), "term", "left_semi")
        loads = posts.select("range", "term", "docs", "tfs").mapInArrow(loaded, "range long, load binary")
        every = (blocks.unionByName(dealt(self._places(ranges, subset), "ids", "lens", "barred", "allowed"), allowMissingColumns=True)
                 .unionByName(dealt(loads, "load"), allowMissingColumns=True))
        kinds = T.StructType([query_id, T.StructField("doc_id", ranges.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])
        with arrow_batches(self.spark, BATCH_ROWS, BATCH_BYTES):
            hits = every.repartitionById(rows * columns, "_cell").sortWithinPartitions("_cell", "range", F.col("load").isNotNull()).mapInArrow(searcher(k, average), kinds)
            return materialize(best_hits(hits, k), "hits")

    def _hits(self, weights, ranges, subset, floors, n_blocks, query_bytes, count, k, average, kinds) -> DataFrame:
        words = weights.groupBy("block", "query_id").agg(F.collect_list(F.struct("term", "weight")).alias("words"))
        if floors is None:
            words = words.withColumn("floor", F.lit(0.0))
        else:
            floors = floors.withColumnRenamed("query_id", "of")
            words = words.join(floors, words["query_id"].eqNullSafe(floors["of"]), "left").drop("of").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        blocks = words.groupBy("block").agg(F.collect_list(F.struct("query_id", "floor", "words")).alias("asked"))
        posts = self._live("postings").join(weights.select("block", "term").distinct(), "term").join(ranges.select("range"), "range", "left_semi")
        found = posts.groupBy("block", "range").agg(F.collect_list(F.struct("term", "docs", "tfs", "most", "least")).alias("found"))
        places = self._places(ranges, subset)
        met = found.join(places, "range")
        if query_bytes <= BROADCAST_BYTES:
            met = met.join(F.broadcast(blocks), "block")
        else:  # a block of queries is met by many ranges, so it is copied to several tasks
            salts = max(1, min(count, self.spark.sparkContext.defaultParallelism))
            copied = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            met = met.withColumn("salt", F.pmod(F.xxhash64("range"), F.lit(salts)).cast("int")).join(copied, ["block", "salt"])
        return met.select("asked", "found", "ids", "lens", "barred", "allowed").mapInArrow(_searcher(k, average), kinds)


def reaching(asking, words, weight, floor, most, least, average: float) -> np.ndarray:
    """Which queries can reach their floor in a range: the sum of the bounds of their words there."""
    bound = np.bincount(asking, weights=weight * saturated_tf(most, least, average)[words], minlength=len(floor))
    return bound * (1 + 1e-9) + 1e-8 >= floor


def _searcher(k: int, average: float):
    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asked, found, ids, lens = (batch.column(c)[i].values for c in range(4))
                query_ids, lists, floor = asked.field("query_id"), asked.field("words"), asked.field("floor").to_numpy()
                terms, most, least = found.field("term"), found.field("most").to_numpy(), found.field("least").to_numpy()
                flat = lists.flatten()
                place = pc.index_in(flat.field("term"), value_set=terms)
                known = pc.is_valid(place).to_numpy(zero_copy_only=False)
                asking = np.repeat(np.arange(len(query_ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[known]
                words, weight = pc.drop_null(place).to_numpy(), flat.field("weight").to_numpy()[known]
                can = reaching(asking, words, weight, floor, most, least, average)
                if not can.any():
                    continue
                # queries that cannot reach their k-th score are left out, and words that none of the others asks for
                stay = can[asking]
                number = np.cumsum(can) - 1
                asking, words, weight = number[asking[stay]], words[stay], weight[stay]
                shared = np.unique(words)
                docs, tfs = found.field("docs").take(pa.array(shared)), found.field("tfs").take(pa.array(shared))
                word = np.repeat(np.arange(len(shared)), pc.list_value_length(docs).to_numpy(zero_copy_only=False))
                doc, tf = docs.flatten().to_numpy(), tfs.flatten().to_numpy()
                take = np.ones(len(doc), bool)
                for column, keep in ((4, False), (5, True)):
                    marked = batch.column(column)[i]
                    if marked.is_valid:
                        listed = np.zeros(len(ids), bool)
                        listed[marked.values.to_numpy()] = True
                        take &= listed[doc] == keep
                order = np.argsort(doc[take], kind="stable")
                doc, word, tf = doc[take][order], word[take][order], tf[take][order]
                owners = pa.array(np.flatnonzero(can))
                for q, d, score in tile_hits(asking, np.searchsorted(shared, words), weight, int(can.sum()), doc, word, tf, lens.to_numpy(), len(shared), k, average):
                    good = score >= floor[can][q]
                    yield pa.RecordBatch.from_arrays([query_ids.take(owners.take(pa.array(q[good]))), ids.take(pa.array(d[good])), pa.array(score[good])], ["query_id", "doc_id", "score"])

    return search


_held: dict[tuple, TermIndex] = {}


def index_of(spark: SparkSession, key: str, docs: DataFrame) -> TermIndex:
    """The index of a corpus, built when it is first asked for in an application and read from then on."""
    app = (spark.sparkContext.applicationId, key)
    if app not in _held or not _held[app].exists():
        _held[app] = TermIndex(spark).add(docs)
    return _held[app]
