"""A stored token-vector index: saved, loaded, listed and deleted by name, searched by cells.

Token vectors lie in one folder per cell, as the difference to the cell's centroid in one byte per dimension. A
search looks up, for every query token, the nearest tokens of the nearest cells; the documents that gather the best sums
that way are scored exactly by MaxSim on their full vectors. The manifest is a table of rows that are only added: the
last row of a name says which version is valid, or that the index is gone.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators import dense
from corpusflow.operators import multivector as mv
from corpusflow.operators.ranking import DIGITS, best_hits
from corpusflow.session import materialize, shared_root

MANIFEST = "name string, entry long, version string, deleted boolean, documents long, tokens long, dim int, centroids array<array<double>>"
SCALE = 127.0
#: Nearest tokens that a query token takes from each cell it probes.
TOKENS_A_CELL = 64


class TokenIndexes:
    """All token-vector indexes below one folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_root(spark)}/token-indexes-{uuid.uuid4().hex}"

    # --- manifest ---------------------------------------------------------------------

    def _entries(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")

    def _enter(self, row: tuple) -> None:
        last = self._entries().agg(F.coalesce(F.max("entry"), F.lit(0))).first()[0]
        self.spark.createDataFrame([(row[0], last + 1, *row[1:])], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def catalog(self) -> DataFrame:
        """(name, version, documents, tokens, dim, storage_mib) of every index that is there; storage of one byte a dimension."""
        last = self._entries().groupBy("name").agg(F.max_by(F.struct("version", "deleted", "documents", "tokens", "dim"), "entry").alias("e")).select("name", "e.*")
        return last.filter("NOT deleted").drop("deleted").withColumn("storage_mib", F.col("tokens") * F.col("dim") / 1048576.0)

    def exists(self, name: str) -> bool:
        return not self.catalog().filter(F.col("name") == name).isEmpty()

    def delete(self, name: str) -> None:
        """The name is free again; deleting what is not there changes nothing."""
        if self.exists(name):
            self._enter((name, "", True, 0, 0, 0, []))

    # --- content ----------------------------------------------------------------------

    def save(self, name: str, tokens: DataFrame, cells: int = 16) -> None:
        """Index tokens (doc_id, pos, vec) under a name; an index of that name is replaced at once by the manifest's new row.

        Zero vectors belong to no cell but stay part of their document's score.
        """
        version = uuid.uuid4().hex
        path = f"{self.folder}/{version}"
        packed = mv.packed_documents(tokens)
        packed.write.parquet(f"{path}/documents")
        centroids = dense.train_centroids(tokens.select("vec"), cells)
        centers = np.array(centroids)

        def code(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                matrix = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                at = batch.column("block").to_numpy()
                rest = matrix - centers[at]
                size = np.maximum(np.abs(rest).max(axis=1), 1e-12)
                codes = np.round(rest / size[:, None] * SCALE).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("block")],
                                                 ["doc_id", "size", "code", "cell"])

        placed = dense.nearest_cells(tokens.select("doc_id", "vec"), "doc_id", centroids, 1)
        coded = placed.select("block", "doc_id", "vec").mapInArrow(code, "doc_id long, size double, code binary, cell long")
        coded.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(4))).write.partitionBy("cell").parquet(f"{path}/cells")
        kept = self.spark.read.parquet(f"{path}/documents").agg(F.count("*").alias("documents"), F.sum(F.get("lens", F.lit(0))).alias("tokens")).first()
        self._enter((name, version, False, kept.documents, kept.tokens or 0, centers.shape[1], [list(map(float, c)) for c in centroids]))

    def load(self, name: str) -> "TokenIndex":
        row = self._entries().filter(F.col("name") == name).orderBy(F.desc("entry")).first()
        if row is None or row.deleted:
            raise KeyError(name)
        return TokenIndex(self.spark, f"{self.folder}/{row.version}", np.array(row.centroids))


class TokenIndex:
    """One version of a stored index."""

    def __init__(self, spark: SparkSession, path: str, centers: np.ndarray):
        self.spark, self.path, self.centers = spark, path, centers

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    def candidates(self, tokens: DataFrame, depth: int, n_probe: int) -> DataFrame:
        """(query_id, doc_id): every query's ``depth`` best documents by decoded tokens of the probed cells.

        A token's finds in a cell are one row, dealt by query once: that order serves the sums and the ranks too.
        """
        centers = self.centers
        asked = tokens.withColumn("token", F.xxhash64("query_id", "pos")).select("query_id", "token", "vec")
        probes = materialize(dense.nearest_cells(asked, "token", [list(c) for c in centers], n_probe, ("query_id",)), "probes")
        cells = [r.block for r in probes.select("block").distinct().collect()]  # at most one number per centroid
        rows = self.spark.read.schema("doc_id long, size double, code binary, cell long").parquet(f"{self.path}/cells").filter(F.col("cell").isin(cells))

        def packed(batches):
            for batch in batches:
                at = batch.column("cell").to_numpy()
                for cell in np.unique(at):
                    own = batch.filter(pa.array(at == cell))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell], pa.int64()), dense._list_of(own.column("doc_id").to_numpy(), [own.num_rows], pa.int64()),
                         dense._list_of(own.column("size").to_numpy(), [own.num_rows], pa.float64()), pa.array([b"".join(own.column("code").to_pylist())], pa.binary())],
                        ["block", "ids", "sizes", "codes"])

        lists = rows.mapInArrow(packed, "block long, ids array<long>, sizes array<double>, codes binary")
        owner = tokens.schema["query_id"].dataType.simpleString()

        def gathered(batches):
            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            for batch in batches:
                at = batch.column("block").to_numpy()
                for cell in np.unique(at):
                    own = batch.filter(pa.array(at == cell))
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), whole(own.column("token")), whole(own.column("query_id")), whole(own.column("vec").flatten())],
                                                     ["block", "qids", "owners", "qvecs"])

        def look_up(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    tokens_, vecs, ids, sizes = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("qids", "qvecs", "ids", "sizes"))
                    codes = np.frombuffer(batch.column("codes")[i].as_py(), np.int8).reshape(len(ids), -1)
                    decoded = centers[batch.column("block")[i].as_py()] + codes * (sizes / SCALE)[:, None]
                    scores = np.round(vecs.reshape(len(tokens_), -1) @ decoded.T, DIGITS)
                    best = [dense.keep_best(row, ids, TOKENS_A_CELL) for row in scores]
                    sizes = [len(found) for _, found in best]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("owners")[i].values, pa.array(tokens_, pa.int64()), dense._list_of(np.concatenate([found for _, found in best]), sizes, pa.int64()),
                         dense._list_of(np.concatenate([score for score, _ in best]), sizes, pa.float64())], ["query_id", "token", "ids", "scores"])

        met = probes.mapInArrow(gathered, f"block long, qids array<long>, owners array<{owner}>, qvecs array<double>").join(lists, "block")
        found = met.mapInArrow(look_up, f"query_id {owner}, token long, ids array<long>, scores array<double>").repartition("query_id")
        rows = found.select("query_id", "token", F.explode(F.arrays_zip("ids", "scores")).alias("h")).select("query_id", "token", F.col("h.ids").alias("doc_id"), F.col("h.scores").alias("score"))
        best = rows.groupBy("query_id", "token", "doc_id").agg(F.max("score").alias("score"))
        sums = best.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), DIGITS).alias("score"))
        return best_hits(sums, depth).select("query_id", "doc_id")

    def search(self, tokens: DataFrame, k: int = 10, depth: int = 50, n_probe: int = 6) -> DataFrame:
        """MaxSim top-k of the queries (query_id, pos, vec) among their candidates: query_id, doc_id, score, rank."""
        queries = mv.packed_documents(tokens.withColumnRenamed("query_id", "doc_id")).withColumnRenamed("doc_id", "query_id")
        pairs = materialize(self.candidates(tokens, depth, n_probe), "candidates")
        documents = self.documents().select("doc_id", "lens", "flat")
        numbers = sum(frame.agg(F.coalesce(F.sum(F.size("flat")), F.lit(0))).first()[0] for frame in (queries, documents))
        return best_hits(dense.score_pairs(pairs, queries, documents, numbers, _maxsims), k)


def _maxsims(queries: pa.Table, docs: pa.Table, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """MaxSim of every pair of rows of two tables of packed tokens; a query meets its documents at once."""
    columns = []
    for table in (queries, docs):
        lens, flat = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("lens", "flat"))
        edges = np.r_[0, np.cumsum(pc.list_value_length(table.column("flat").combine_chunks()).to_numpy(zero_copy_only=False))]
        columns.append((lens, lambda row, flat=flat, edges=edges: flat[edges[row]: edges[row + 1]].astype(np.float64)))
    (ql, qf), (dl, df) = columns
    out, starts = np.empty(len(q)), np.flatnonzero(np.diff(q, prepend=-1))
    for low, high in zip(starts, np.r_[starts[1:], len(q)]):
        own = d[low:high]
        out[low:high] = mv.maxsim(qf(q[low]), ql[q[low]: q[low] + 1], np.concatenate([df(x) for x in own]), dl[own])[0]
    return out
