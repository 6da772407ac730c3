"""Stored collections: keyed upserts, deletes, catalog and plain sinks.

Stored collections keep their rows in Parquet, cut by collection and by a bucket of
the document id. A change rewrites only the cuts it touches; a manifest then commits
the new version at once, and readers follow the newest complete manifest.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "collection string, bucket int, folder string, schema string"


def merge_latest(current: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str, content: str | None = None,
                 touched: str | None = None) -> DataFrame:
    """Last version of every key wins. Repeating a merge changes nothing.

    One combining aggregate, so a key with very many versions is reduced before
    the shuffle. With ``content`` and ``touched`` the touch column keeps its old
    value where a newer version brings the same content.
    """
    both = current.unionByName(incoming)
    rest = [c for c in both.columns if c not in keys]
    aggs = [F.max_by(F.struct(*rest), F.struct(version, *([touched] if touched else []))).alias("_new")]
    if touched:
        aggs.append(F.min_by(F.struct(content, touched), F.struct(version, touched)).alias("_old"))
    merged = both.groupBy(*keys).agg(*aggs)
    columns = [F.col(f"_new.{c}").alias(c) for c in rest if c != touched]
    if touched:
        same = F.col(f"_new.{content}") == F.col(f"_old.{content}")
        columns.append(F.when(same, F.col(f"_old.{touched}")).otherwise(F.col(f"_new.{touched}")).alias(touched))
    return merged.select(*keys, *columns)


def without_documents(table: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose document is not on the delete list."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def without_collection(table: DataFrame, name: str) -> DataFrame:
    return table.filter(F.col("collection") != name)


def cascade(results: DataFrame, gone_queries: DataFrame, gone_documents: DataFrame) -> DataFrame:
    """Results go with their query or their document."""
    kept = results.join(gone_queries.select("query_id").distinct(), "query_id", "left_anti")
    return kept.join(gone_documents.select("doc_id").distinct(), "doc_id", "left_anti")


def catalog(table: DataFrame) -> DataFrame:
    """Name, size and description of every collection."""
    return table.groupBy("collection").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("points")).withColumn(
        "description", F.format_string("Collection '%s' with %d documents", "collection", "documents"))


def write_collections(table: DataFrame, path: str) -> None:
    """Write a version, partitioned by collection."""
    table.write.mode("overwrite").partitionBy("collection").parquet(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def write_judged_dataset(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, folder: str, split: str = "test") -> None:
    """Retrieval data set folder: corpus.jsonl, queries.jsonl, qrels/<split>.tsv."""
    corpus.select(F.col("doc_id").cast("string").alias("_id"), "title", "text").write.json(f"{folder}/corpus.jsonl")
    queries.select(F.col("query_id").cast("string").alias("_id"), "text").write.json(f"{folder}/queries.jsonl")
    qrels.select(F.col("query_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("rel").alias("score")).write.option(
        "sep", "\t").option("header", True).csv(f"{folder}/qrels/{split}.tsv")


class StoredCollections:
    """Rows with a ``collection`` and a document id, changed in place by cuts (collection, bucket of the document id)."""

    def __init__(self, spark: SparkSession, path: str, document: str = "doc_id", buckets: int = 16):
        self.spark, self.path, self.document, self.buckets = spark, path.rstrip("/"), document, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.document), F.lit(self.buckets)).cast("int")

    # --- versions ---------------------------------------------------------------------

    def versions(self) -> list[int]:
        """Numbers of the complete versions; a manifest counts once its write has been committed."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        top = hadoop.Path(f"{self.path}/manifest")
        files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(top):
            return []
        found = [s.getPath() for s in files.listStatus(top)]
        return sorted(int(p.getName()) for p in found if files.exists(hadoop.Path(p, "_SUCCESS")))

    def cuts(self, version: int | None = None) -> dict[tuple[str | None, int], str]:
        """Folder of every cut (collection, bucket) of a version; its size is collections x buckets."""
        version = version if version is not None else (self.versions() or [None])[-1]
        if version is None:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{version:08d}").collect()
        self._schema = T.StructType.fromJson(json.loads(next(r.schema for r in rows if r.schema is not None)))
        return {(r.collection, r.bucket): r.folder for r in rows if r.folder is not None}

    def _commit(self, cuts: dict, schema: T.StructType) -> int:
        number = (self.versions() or [0])[-1] + 1
        rows = [(c, b, folder, None) for (c, b), folder in cuts.items()] + [(None, None, None, schema.json())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/{number:08d}")
        return number

    def read(self, only: Sequence[tuple[str | None, int]] | None = None, version: int | None = None) -> DataFrame:
        """All rows of a version, or those of some cuts. Cuts are partitions, so others are not read."""
        cuts = self.cuts(version)
        by_folder = defaultdict(lambda: defaultdict(list))
        for cut in cuts if only is None else [c for c in only if c in cuts]:
            by_folder[cuts[cut]][cut[0]].append(cut[1])
        out = self.spark.createDataFrame([], self._schema)
        inside = T.StructType([*[f for f in self._schema.fields if f.name != "collection"], T.StructField("collection", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        for folder, held in by_folder.items():
            wanted = F.lit(False)
            for collection, numbers in held.items():
                wanted = wanted | (F.col("collection").eqNullSafe(F.lit(collection)) & F.col("_bucket").isin(numbers))
            out = out.unionByName(self.spark.read.schema(inside).parquet(f"{self.path}/{folder}").filter(wanted).drop("_bucket"))
        return out

    # --- changes ----------------------------------------------------------------------

    def _rewrite(self, rows: DataFrame, touched: set, cuts: dict) -> int:
        """Write ``rows`` as the new content of the touched cuts and commit them with all others as they are."""
        folder = f"data/{uuid.uuid4().hex}"
        # a large collection is as many cuts as there are buckets, so the number of buckets bounds what one task writes
        dealt = rows.withColumn("_bucket", self._bucket()).repartition("collection", "_bucket")
        dealt.write.partitionBy("collection", "_bucket").parquet(f"{self.path}/{folder}")
        kinds = "collection string, _bucket int"
        written = {(r[0], r[1]) for r in self.spark.read.schema(f"{self.document} string, {kinds}").parquet(f"{self.path}/{folder}").select("collection", "_bucket").distinct().collect()}
        kept = {cut: f for cut, f in cuts.items() if cut not in touched}
        return self._commit(kept | {cut: folder for cut in written}, rows.schema)

    def create(self, rows: DataFrame) -> int:
        return self._rewrite(rows, set(), {})

    def _cuts_of(self, rows: DataFrame) -> set:
        return {(r[0], r[1]) for r in rows.select("collection", self._bucket().alias("b")).distinct().collect()}

    def merge(self, incoming: DataFrame, keys: Sequence[str], version: str, content: str | None = None, touched: str | None = None) -> int:
        """``merge_latest`` into the cuts that ``incoming`` has rows for.

        Only cuts whose rows change are rewritten, so repeating a merge writes nothing but its manifest.
        """
        cuts = self.cuts()
        hit = self._cuts_of(incoming)
        current = self.read(sorted(hit, key=str))
        incoming = incoming.select(*current.columns)
        changed = self._changed(current, incoming, keys, version, content, touched, hit)
        if not changed:
            return self._commit(cuts, current.schema)
        current = self.read(sorted(changed, key=str))
        inside = self._in_cuts(incoming, changed)
        merged = merge_latest(current, inside, keys, version, content, touched).select(*current.columns)
        return self._rewrite(merged, changed, cuts)

    def _in_cuts(self, rows: DataFrame, cuts: set) -> DataFrame:
        numbers = defaultdict(list)
        for collection, bucket in cuts:
            numbers[collection].append(bucket)
        wanted = F.lit(False)
        for collection, held in numbers.items():
            wanted = wanted | (F.col("collection").eqNullSafe(F.lit(collection)) & self._bucket().isin(held))
        return rows.filter(wanted)

    def _changed(self, current: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str, content: str | None, touched: str | None, hit: set) -> set:
        """Cuts in which a merge adds, changes or takes away a row. Rows are merged without their contents, by digests of them.

        Where a key has rows in two cuts, these depend on each other: then all cuts of ``hit`` are merged together.
        """
        named = [c for c in (version, touched) if c]
        place = ["collection", self.document]
        plain = [*keys, *[c for c in [*named, *place] if c not in keys]]
        rest = [c for c in current.columns if c not in plain and c != content]
        digest = lambda columns: F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
        extra = {"_content": F.when(F.col(content).isNotNull(), digest([content])) if content else F.lit(None).cast("binary"), "_rest": digest(rest) if rest else F.lit(None).cast("binary")}
        narrow = lambda frame: frame.withColumns(extra).select(*plain, "_content", "_rest")
        before, after = narrow(current), narrow(incoming)
        places = before.unionByName(after).groupBy(*keys).agg(*[f(F.struct("collection", self._bucket())).alias(n) for f, n in ((F.min, "_low"), (F.max, "_high"))])
        if not places.filter(~F.col("_low").eqNullSafe(F.col("_high"))).isEmpty():
            return hit
        merged = merge_latest(before, after, keys, version, "_content" if content else None, touched).select(*before.columns)
        # a row counts +1 after and -1 before; what does not cancel out has changed
        both = merged.withColumn("_n", F.lit(1)).unionByName(before.withColumn("_n", F.lit(-1)))
        return self._cuts_of(both.groupBy(*before.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0"))

    def remove_documents(self, gone: DataFrame) -> int:
        """Drop all rows of these documents; cuts without any of them stay as they are."""
        cuts = self.cuts()
        numbers = {r[0] for r in gone.select(self._bucket().alias("b")).distinct().collect()}
        held = self.read([c for c in cuts if c[1] in numbers]).join(gone.select(self.document).distinct(), self.document, "left_semi")
        hit = self._cuts_of(held)
        current = self.read(sorted(hit, key=str))
        return self._rewrite(without_documents(current, gone, self.document).select(*current.columns), hit, cuts)

    def drop_collection(self, name: str) -> int:
        """The manifest alone changes."""
        cuts = self.cuts()
        return self._commit({cut: folder for cut, folder in cuts.items() if cut[0] != name}, self._schema)
