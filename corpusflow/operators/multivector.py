"""Token-level vectors: pooling, MaxSim scoring, quantization and storage."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import dense
from corpusflow.operators.dense import _list_of, join_blocks, keep_best
from corpusflow.operators.ranking import DIGITS, best_hits, stable
from corpusflow.session import materialize

# Longest document per domain in tokens, bits per value, pooling thresholds.
DOMAIN_MAXLEN = {"biomedical": 350, "scientific": 400, "financial": 280, "argumentative": 250, "general": 300}
DOMAIN_NBITS = 2
POOL_THRESHOLDS = [(0.5, 1), (0.3, 2), (0.15, 3)]
POOL_LAST = 4
QUERY_BLOCK = 256
# Products of a query token and a document token that are held at once.
TILE_CELLS = 4_000_000


def domain_maxlen(domain: Column) -> Column:
    """Token limit of a domain; unknown domains count as general."""
    out = F.lit(DOMAIN_MAXLEN["general"])
    for name, limit in DOMAIN_MAXLEN.items():
        out = F.when(domain == name, limit).otherwise(out)
    return out


def complexity(tokens: DataFrame) -> DataFrame:
    """(doc_id, complexity): mean variance over dimensions and deviation of token norms, halved.

    ``tokens`` is (doc_id, pos, vec). Grouping by (doc, dimension) keeps every
    partial aggregate small and combines before the shuffle.
    """
    flat = tokens.select("doc_id", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    spread_ = flat.groupBy("doc_id", "dim").agg(F.var_samp("x").alias("v")).groupBy("doc_id").agg(F.avg("v").alias("v"))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    norms = tokens.select("doc_id", length.alias("n")).groupBy("doc_id").agg(F.stddev_samp("n").alias("s"))
    return spread_.join(norms, "doc_id").select("doc_id", stable((F.col("v") + F.col("s")) / 2).alias("complexity"))


def pool_factor(score: Column) -> Column:
    out = F.lit(POOL_LAST)
    for limit, factor in reversed(POOL_THRESHOLDS):
        out = F.when(score > limit, factor).otherwise(out)
    return out


def pool(tokens: DataFrame, pad: str = "zero") -> DataFrame:
    """(doc_id, pos, dim, x): means of ``factor`` consecutive token vectors.

    ``tokens`` is (doc_id, pos, vec, factor). The last group is divided by the
    full factor (pad='zero') or by the vectors it has (pad='exact').
    """
    flat = tokens.select("doc_id", F.expr("pos div factor").alias("pos"), "factor", F.posexplode("vec").alias("dim", "x"))
    total = F.sum(F.col("x").cast("double"))
    return flat.groupBy("doc_id", "pos", "factor", "dim").agg((total / (F.col("factor") if pad == "zero" else F.count("*"))).alias("x")).drop("factor")


def storage_stats(tokens: DataFrame) -> DataFrame:
    """Documents, tokens, tokens per document, dimension and MiB of an index."""
    return tokens.agg(
        F.count_distinct("doc_id").alias("documents"), F.count("*").alias("tokens"), F.max(F.size("vec")).alias("dim")
    ).withColumn("avg_tokens", F.col("tokens") / F.col("documents")).withColumn(
        "storage_mib", F.col("tokens") * F.col("dim") * 4 / F.lit(1048576.0))


# --- MaxSim by blocks -----------------------------------------------------------------

def packed_documents(tokens: DataFrame, maxlen: int | None = None, key: str = "doc_id") -> DataFrame:
    """(key, lens, flat): all token vectors of a document in one row; with ``maxlen`` at most so many."""
    return (tokens if maxlen is None else tokens.filter(F.col("pos") < maxlen)).groupBy(key).agg(
        F.array(F.count("*").cast("long")).alias("lens"), F.flatten(F.collect_list("vec")).alias("flat"))


def packed_variants(variants: DataFrame) -> DataFrame:
    """(query_id, lens, flat): a query's token lists in one row, the query itself (variant 0) first.

    ``variants`` is (query_id, variant, lens, flat); a query has a handful of them.
    """
    rows = F.array_sort(F.collect_list(F.struct("variant", "lens", "flat"))).alias("_v")
    return variants.groupBy("query_id").agg(rows).select(
        "query_id", F.flatten(F.transform("_v", lambda r: r["lens"])).alias("lens"),
        F.flatten(F.transform("_v", lambda r: r["flat"])).alias("flat"))


_LISTS = (("ids", pa.int64()), ("counts", pa.int64()), ("lens", pa.int64()), ("vecs", pa.float64()), ("extra", pa.float64()))


def _flat(batch, i):
    return batch.column(i).flatten().to_numpy(zero_copy_only=False)


def _blocks(prefix: str):
    """Packer of (block, id, lens, flat, extra) rows into matrices, and its schema."""
    schema = pa.schema([("block", pa.int64())] + [(prefix + n, pa.list_(t)) for n, t in _LISTS])

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            block, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            counts = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            lens, flat, extra = _flat(batch, 2), _flat(batch, 3).astype(np.float64), _flat(batch, 4).reshape(len(ids), -1)
            dim = flat.size // int(lens.sum())
            edges = np.concatenate([[0], np.cumsum(counts)])
            sizes = np.add.reduceat(lens, edges[:-1])
            starts = np.concatenate([[0], np.cumsum(sizes)]) * dim
            for key in np.unique(block):
                rows = np.flatnonzero(block == key)
                parts = (ids[rows], counts[rows], np.concatenate([lens[edges[r]:edges[r + 1]] for r in rows]),
                         np.concatenate([flat[starts[r]:starts[r + 1]] for r in rows]), extra[rows].ravel())
                yield pa.RecordBatch.from_arrays([pa.array([key], type=pa.int64())] + [
                    _list_of(part, [part.size], kind) for part, (_, kind) in zip(parts, _LISTS)], schema=schema)

    names = {pa.int64(): "array<long>", pa.float64(): "array<double>"}
    return pack, "block long, " + ", ".join(f"{prefix}{n} {names[t]}" for n, t in _LISTS)


def maxsim(qvecs: np.ndarray, qlens: np.ndarray, dvecs: np.ndarray, dlens: np.ndarray) -> np.ndarray:
    """queries x documents: mean over query tokens of the best dot product with a document token."""
    n_tokens = int(qlens.sum())
    dim = qvecs.size // n_tokens
    left, right = qvecs.reshape(-1, dim), dvecs.reshape(-1, dim)
    edges, starts = np.concatenate([[0], np.cumsum(dlens)]), np.concatenate([[0], np.cumsum(qlens)[:-1]])
    # products of all tokens are made for so many documents at a time that they stay below TILE_CELLS
    tile = np.maximum(edges[1:] - 1, 0) * n_tokens // TILE_CELLS
    bounds = np.append(np.flatnonzero(np.diff(tile, prepend=-1)), len(dlens))
    out = np.empty((len(qlens), len(dlens)))
    for low, high in zip(bounds[:-1], bounds[1:]):
        sims = left @ right[edges[low]:edges[high]].T
        best = np.maximum.reduceat(sims, edges[low:high] - edges[low], axis=1)
        out[:, low:high] = np.add.reduceat(best, starts, axis=0) / qlens[:, None]
    return out


_PAIR_COLUMNS = ("qids", "qcounts", "qlens", "qvecs", "qextra", "dids", "dlens", "dvecs")


def _pairs(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Block pairs: query blocks of bounded size, each document block sent once per query block."""
    size = queries.agg(F.count("*"), F.sum(F.size("flat"))).first()
    n_blocks = max(1, -(-size[0] // QUERY_BLOCK))
    none = F.array().cast("array<double>")
    extra = F.col("extra") if "extra" in queries.columns else none
    left = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("block"), "query_id", "lens", "flat", extra.alias("extra"))
    left = left.repartition(n_blocks, "block").mapInArrow(*_blocks("q"))
    right = docs.select(F.lit(0).cast("long").alias("block"), "doc_id", "lens", "flat", none.alias("extra")).mapInArrow(*_blocks("d"))
    return join_blocks(left, right, n_blocks, 8 * (size[1] or 0), "dids",
                       lambda: 8 * (docs.agg(F.sum(F.size("flat"))).first()[0] or 0)).select(*_PAIR_COLUMNS)


def _unpack(batches):
    for batch in batches:
        columns = [batch.column(n) for n in _PAIR_COLUMNS]
        for row in range(batch.num_rows):
            yield [c[row].values.to_numpy(zero_copy_only=False) for c in columns]


def _columns(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(values, schema)], schema=schema)


def maxsim_topk(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """Exact MaxSim top-k. Both sides are packed: (query_id | doc_id, lens, flat)."""
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches):
        best = {}
        for qids, _, qlens, qvecs, _, dids, dlens, dvecs in _unpack(batches):
            sims = np.round(maxsim(qvecs, qlens, dvecs, dlens), DIGITS)
            for i, qid in enumerate(qids):
                old = best.get(int(qid), (np.empty(0), np.empty(0, dtype=np.int64)))
                best[int(qid)] = keep_best(np.concatenate([old[0], sims[i]]), np.concatenate([old[1], dids]), k)
        for qid, (scores, ids) in best.items():
            yield _columns(schema, np.full(len(ids), qid), ids, scores)

    return best_hits(_pairs(queries, docs).mapInArrow(score, "query_id long, doc_id long, score double"), k)


def _own_and_rest(qcounts, qlens, qvecs, dlens, dvecs):
    """Scores of the query itself and mean scores of its hypothetical answers."""
    sims = maxsim(qvecs, qlens, dvecs, dlens)
    starts = np.concatenate([[0], np.cumsum(qcounts)[:-1]])
    own = sims[starts]
    rest = (np.add.reduceat(sims, starts, axis=0) - own) / np.maximum(qcounts - 1, 1)[:, None]
    return own, rest


def _scale(values, low, high):
    return np.full_like(values, 0.5) if high - low < 1e-8 else (values - low) / (high - low)


def hypothetical_topk(queries: DataFrame, docs: DataFrame, k: int = 10, weight: float = 0.2) -> DataFrame:
    """Query and hypothetical answers scored by MaxSim, scaled over all documents, fused, top-k.

    ``queries`` is packed by :func:`packed_variants`. Two passes over the block
    pairs: the first finds each query's score ranges, the second fuses with them
    and keeps the k best. Scores of pairs are never stored.
    """
    ends = ("qlo", "qhi", "hlo", "hhi")
    range_schema = pa.schema([("query_id", pa.int64())] + [(n, pa.float64()) for n in ends])

    def ranges(batches):
        for qids, qcounts, qlens, qvecs, _, _, dlens, dvecs in _unpack(batches):
            own, rest = _own_and_rest(qcounts, qlens, qvecs, dlens, dvecs)
            yield _columns(range_schema, qids, own.min(1), own.max(1), rest.min(1), rest.max(1))

    bounds = _pairs(queries, docs).mapInArrow(ranges, "query_id long, " + ", ".join(f"{n} double" for n in ends))
    bounds = bounds.groupBy("query_id").agg(F.min("qlo").alias("qlo"), F.max("qhi").alias("qhi"), F.min("hlo").alias("hlo"), F.max("hhi").alias("hhi"))
    limited = queries.join(bounds.select("query_id", F.array(*ends).alias("extra")), "query_id")
    hit_schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64())] + [(n, pa.float64()) for n in ("score", "query_score", "hypothetical_score")])

    def fuse(batches):
        for qids, qcounts, qlens, qvecs, qextra, dids, dlens, dvecs in _unpack(batches):
            own, rest = _own_and_rest(qcounts, qlens, qvecs, dlens, dvecs)
            for i, (qlo, qhi, hlo, hhi) in enumerate(qextra.reshape(len(qids), 4)):
                fused = np.round(weight * _scale(rest[i], hlo, hhi) + (1 - weight) * _scale(own[i], qlo, qhi), DIGITS)
                at = np.lexsort((dids, -fused))[:k]
                yield _columns(hit_schema, np.full(len(at), qids[i]), dids[at], fused[at], np.round(own[i][at], DIGITS), np.round(rest[i][at], DIGITS))

    hits = _pairs(limited, docs).mapInArrow(fuse, "query_id long, doc_id long, score double, query_score double, hypothetical_score double")
    return best_hits(hits, k)


def centroids(vectors: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, n, centroid): mean vector of every key, whole vectors at a time.

    Tasks add up the vectors of each key in Arrow batches; one partial sum for each key and batch is shuffled, so a key
    with a third of all rows is a few rows. Null vectors are left out; a key's vectors must have one length.
    """
    kind = vectors.schema[key]

    def partial(batches):
        for batch in batches:
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            at = keys.indices.to_numpy()
            for number in range(len(keys.dictionary)):
                rows = batch.filter(pa.array(at == number))
                total = rows.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1).sum(axis=0)
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(0, 1), pa.array([pa.compute.sum(rows.column(1)).as_py()], pa.int64()), _list_of(total, [len(total)], pa.float64())], [key, "n", "total"])

    schema = f"{key} {kind.dataType.simpleString()}, n long, total array<double>"
    ones = vectors.filter(F.col(vec).isNotNull()).select(key, F.lit(1).cast("long").alias("n"), F.transform(vec, lambda x: x.cast("double")).alias("total"))
    sums = ones.mapInArrow(partial, schema).repartition(key).mapInArrow(partial, schema)
    # a task may see a key in several batches: at most a handful of rows a key are left
    whole = sums.groupBy(key).agg(F.sum("n").alias("n"), F.collect_list("total").alias("t"))
    total = F.aggregate(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), F.get("t", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return whole.select(key, "n", F.transform(total, lambda x: x / F.col("n")).alias("centroid"))


# --- Quantization ---------------------------------------------------------------------

# Compression ratio and bytes per dimension of each storage form.
STORAGE_FORMS = [("float32", 1.0, 4.0), ("float16", 2.0, 2.0), ("int8", 4.0, 1.0), ("binary", 32.0, 0.125), ("product", 16.0, 0.25)]


def int8_codes(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Adds codes -128..127 on the table's own range; a table without spread gets zeros."""
    ends = vectors.agg(F.min(F.array_min(vec)).cast("double").alias("lo"), F.max(F.array_max(vec)).cast("double").alias("hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    code = lambda x: F.when(hi > lo, (F.round((x.cast("double") - lo) / (hi - lo) * 255) - 128)).otherwise(0.0).cast("smallint")
    ranged = vectors.withColumns({"_lo": ends.select("lo").scalar(), "_hi": ends.select("hi").scalar()})
    return ranged.withColumn("codes", F.transform(vec, code)).drop("_lo", "_hi")


def sign_bits(vec: str = "vec", width: int = 32) -> Column:
    """Sign bits packed into words of ``width`` bits; bit i of a word is dimension i."""
    return F.expr(f"""transform(sequence(0, cast((size({vec}) - 1) div {width} as int)), w -> aggregate(
        transform(slice({vec}, w * {width} + 1, {width}), (x, i) -> CASE WHEN x > 0 THEN shiftleft(1L, i) ELSE 0L END),
        0L, (a, b) -> a | b))""")


def hamming(left: str, right: str) -> Column:
    """Differing bits of two packed codes."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)


def half_precision(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Values after a round trip through 16-bit floats."""
    @F.pandas_udf("array<float>")
    def trip(series: pd.Series) -> pd.Series:
        sizes = series.map(len).to_numpy()
        flat = np.concatenate([*series, np.zeros(0)]).astype(np.float32).astype(np.float16).astype(np.float32)
        return pd.Series(np.split(flat, np.cumsum(sizes)[:-1])) if len(sizes) else series

    return vectors.withColumn(vec, trip(vec))


def _parts(vecs: pa.Array, n_sub: int, width: int) -> np.ndarray:
    """Unit vectors cut into sub-vectors; zeros behind vectors that are too short, zero vectors stay zero."""
    sizes, flat = np.diff(vecs.offsets.to_numpy()), vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), n_sub * width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0).reshape(len(sizes), n_sub, width)


def _nearest_codes(parts: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Nearest code of every sub-vector, as bytes."""
    codes = np.empty(parts.shape[:2], np.uint8)
    for s in range(len(books)):
        half = (books[s] ** 2).sum(axis=1) / 2
        for low in range(0, len(parts), 4096):
            codes[low: low + 4096, s] = (half[None, :] - parts[low: low + 4096, s] @ books[s].T).argmin(axis=1)
    return codes


def _decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for."""
    return np.concatenate([books[s][codes[:, s]] for s in range(len(books))], axis=1)


def _cosines(queries: pa.Table, docs: pa.Table, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Cosine of every pair of rows of two tables with vectors in ``flat``; not a number for zero vectors."""
    left, right = (t.column("flat").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (queries, docs))
    out = np.empty(len(q))
    for low in range(0, len(q), dense.PAIRS_AT_ONCE):
        a, b = (m[at[low: low + dense.PAIRS_AT_ONCE]].astype(np.float64) for m, at in ((left, q), (right, d)))
        size = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
        out[low: low + len(a)] = np.divide((a * b).sum(axis=1), size, out=np.full(len(a), np.nan), where=size > 0)
    return out


def train_codebooks(vectors: DataFrame, n_sub: int = 8, n_codes: int = 256, seed: int = 42, max_iter: int = 5) -> np.ndarray:
    """Codebooks (n_sub x n_codes x width) of unit vectors, at most 256 codes each.

    Starts from ``n_codes`` vectors in seeded hash order; each iteration is one pass in which tasks sum the sub-vectors of
    every code for all sub-spaces. What comes to the driver has the size of the codebooks.
    """
    dim = vectors.select(F.max(F.size("vec"))).first()[0] or n_sub
    width = -(-dim // n_sub)
    first = vectors.filter("vec IS NOT NULL").select("vec").distinct().orderBy(F.xxhash64(F.lit(seed), "vec")).limit(n_codes).toArrow().column("vec").combine_chunks()
    start = _parts(first, n_sub, width) if len(first) else np.zeros((1, n_sub, width))
    books = np.resize(start, (n_codes, n_sub, width)).transpose(1, 0, 2).copy()
    for _ in range(max_iter):
        known = books

        def sums(batches):
            total, count = np.zeros(known.shape), np.zeros(known.shape[:2])
            for batch in batches:
                parts = _parts(batch.column(0), n_sub, width)
                codes = _nearest_codes(parts, known)
                for s in range(n_sub):
                    count[s] += np.bincount(codes[:, s], minlength=n_codes)
                    for w in range(width):
                        total[s, :, w] += np.bincount(codes[:, s], weights=parts[:, s, w], minlength=n_codes)
            at = np.flatnonzero(count.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count.ravel()[at]), _list_of(total.reshape(-1, width)[at].ravel(), [width] * len(at), pa.float64())], ["at", "n", "total"])

        partial = vectors.filter("vec IS NOT NULL").select("vec").mapInArrow(sums, "at long, n double, total array<double>")
        added = [F.sum(F.get("total", F.lit(w))).alias(f"t{w}") for w in range(width)]
        rows = partial.groupBy("at").agg(F.sum("n").alias("n"), *added).collect()  # one row per code
        books = books.copy()
        for r in rows:
            books[r.at // n_codes, r.at % n_codes] = np.array([r[f"t{w}"] for w in range(width)]) / r.n
    return books


def product_codes(vectors: DataFrame, books: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, code): one byte per sub-vector."""
    n_sub, _, width = books.shape

    def encode(batches):
        for batch in batches:
            codes = _nearest_codes(_parts(batch.column(1), n_sub, width), books)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], [key, "code"])

    return vectors.filter("vec IS NOT NULL").select(key, "vec").mapInArrow(encode, f"{key} {vectors.schema[key].dataType.simpleString()}, code binary")


def product_topk(queries: DataFrame, vectors: DataFrame, codes: DataFrame, books: np.ndarray, k: int = 10, depth: int = 100, exclude_self: bool = False) -> DataFrame:
    """The k best by cosine among each query's ``depth`` best in code space: query_id, doc_id, score, rank.

    Codes are decoded a tile at a time, where a block of queries meets them, and multiplied with the queries; a product is
    the sum of the table entries that the codes' bytes point at. Only the ``depth`` best meet their vectors, for exact scores.
    """
    n_sub, n_codes, width = books.shape

    def pack_codes(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), _list_of(batch.column(0).to_numpy(), [batch.num_rows], pa.int64()),
                                                  pa.array([b"".join(batch.column(1).to_pylist())], pa.binary())], ["block", "vids", "codes"])

    def look_up(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                qids, qvecs, vids = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("qids", "qvecs", "vids"))
                asked = np.zeros((len(qids), n_sub * width))
                asked[:, : len(qvecs) // len(qids)] = qvecs.reshape(len(qids), -1)
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(len(vids), n_sub)
                yield None, qids, ((asked @ _decoded(codes[low: low + dense.TILE], books).T, vids[low: low + dense.TILE]) for low in range(0, len(vids), dense.TILE))

    def nearest(batches):
        return dense.best_of_blocks(look_up(batches), depth, exclude_self=exclude_self)

    size = queries.agg(F.count("*"), F.max(F.size("vec"))).first()
    n_blocks = max(1, -(-size[0] // dense.QUERY_BLOCK))
    left = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("block"), "query_id", "vec")
    left = left.repartition(n_blocks, "block") if n_blocks > 1 else left
    packed = codes.select("doc_id", "code").mapInArrow(pack_codes, "block long, vids array<long>, codes binary")
    pairs = dense.join_blocks(dense.pack(left, "q"), packed, n_blocks, 8 * size[0] * (size[1] or 0), "vids", lambda: (n_sub + 8) * codes.count())
    near = best_hits(pairs.select("qids", "qvecs", "vids", "codes").mapInArrow(nearest, "query_id long, doc_id long, score double"), depth)
    near = materialize(near.select("query_id", "doc_id"), "near")  # counted, then scored
    numbers = (size[0] + codes.count()) * (size[1] or 0)
    known = vectors.filter("vec IS NOT NULL")
    return best_hits(dense.score_pairs(near, queries.select("query_id", F.col("vec").alias("flat")), known.select("doc_id", F.col("vec").alias("flat")), numbers, _cosines), k)
