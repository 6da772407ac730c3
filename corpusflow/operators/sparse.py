"""Term statistics, BM25 search and BM25 re-ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import exploded, token_count, tokens
from corpusflow.operators.dense import join_blocks
from corpusflow.operators.ranking import DIGITS, best_hits, stable
from corpusflow.session import materialize

# BM25 saturation, length weight and the smallest idf.
K1 = 1.5
B = 0.75
IDF_FLOOR = 0.25


def postings(docs: DataFrame, only_terms: DataFrame | None = None, doc: str = "doc_id",
             text: str = "text", keep: tuple[str, ...] = (), by_document: bool = False) -> DataFrame:
    """(term, doc_id, doc_len, tf): one row per distinct word of a document.

    The length rides along as a grouping key, so no second pass or join is
    needed. With ``only_terms`` other words are dropped before the shuffle.
    """
    # The length is taken before the array is exploded, so the array is not copied to every word.
    bags = docs.select(doc, *keep, tokens(text).alias("_bag")).select(doc, *keep, F.size("_bag").alias("doc_len"), "_bag")
    flat = exploded(bags, "_bag", "term")
    if only_terms is not None:
        flat = flat.join(only_terms, "term", "left_semi")
    if not by_document:
        return flat.groupBy("term", doc, *keep, "doc_len").agg(F.count("*").alias("tf"))
    # Words of one document stay together: counting them and later summing a
    # document's score both happen in this partitioning, without further shuffles.
    return flat.repartition(doc, *keep).groupBy(doc, *keep, "doc_len", "term").agg(F.count("*").alias("tf"))


def document_frequency(posts: DataFrame) -> DataFrame:
    # Reading tf keeps this branch equal to the scoring branch, so Spark reuses the exchange.
    return posts.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of documents and mean length."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(token_count(text)).alias("avg_len"))


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term, qtf): repeated words count."""
    return (
        exploded(queries.select(query, tokens(text).alias("_bag")), "_bag", "term")
        .groupBy(query, "term").agg(F.count("*").alias("qtf"))
    )


def smoothed_idf(n_docs, df):
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5) + 1.0), F.lit(IDF_FLOOR))


def saturated_tf(tf, doc_len, avg_len):
    return tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * (doc_len / avg_len)))


def bm25_scores(queries: DataFrame, docs: DataFrame, text: str = "text",
                subset: DataFrame | None = None) -> DataFrame:
    """Positive BM25 scores (query_id, doc_id, score) of all matching pairs.

    ``subset`` restricts the documents that may be returned (a doc_id table);
    term statistics still come from the whole corpus.
    """
    wanted = query_terms(queries)
    posts = postings(docs, wanted.select("term").distinct(), text=text, by_document=True)
    stats = corpus_stats(docs, text)
    n_docs = stats.select("n_docs").scalar()
    avg_len = stats.select("avg_len").scalar()
    weights = wanted.join(document_frequency(posts), "term").select(
        "query_id", "term",
        (F.col("qtf") * smoothed_idf(n_docs, F.col("df"))).alias("weight"),
    )
    if subset is not None:
        posts = posts.join(subset, "doc_id", "left_semi")
    gain = F.col("weight") * saturated_tf(F.col("tf"), F.col("doc_len"), avg_len)
    return (
        posts.join(weights, "term")
        .groupBy("query_id", "doc_id").agg(stable(F.sum(gain)).alias("score"))
        .filter(F.col("score") > 0)
    )


#: Queries and weights of a query block, words of a document block, and cells of any dense matrix.
QUERY_BLOCK, WEIGHT_BLOCK, WORD_BLOCK = 1024, 100_000, 200_000
BLOCK_CELLS = 1_000_000
#: Bytes of a (query, word, weight) in a packed block, for the choice between broadcast and shuffle.
WEIGHT_BYTES = 48
#: Bytes of a document's word in a packed block.
WORD_BYTES = 24


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 10, text: str = "text",
              subset: DataFrame | None = None) -> DataFrame:
    """The k best documents of every query.

    Queries are dealt to blocks that stay sparse (query, word, weight); blocks of documents meet query blocks through an
    equi-join on the block number. A task multiplies tiles of bounded size, and at most k rows (and ties) per query and
    pair of blocks leave it. No word occurrence is shuffled to be counted, and no query reaches the driver.
    """
    wanted = materialize(query_terms(queries), "query-terms")  # its size, the weights and the blocks read it
    size = wanted.agg(F.count("*").alias("weights"), F.count_distinct("query_id").alias("queries")).first()
    n_blocks = max(1, -(-size.queries // QUERY_BLOCK), -(-size.weights // WEIGHT_BLOCK))
    bags = docs.select("doc_id", tokens(text).alias("_bag"))
    total = bags.agg(F.count("*").alias("n"), F.sum(F.when(F.col("_bag").isNotNull(), F.size("_bag"))).alias("words")).first()
    average = (total.words or 0) / total.n if total.n else 1.0
    # words of a document count once; the counts are combined in the scan's own tasks
    df = exploded(bags.select(F.array_distinct("_bag").alias("_bag")), "_bag", "term").groupBy("term").agg(F.count("*").alias("df"))
    weights = wanted.join(df, "term").select(
        F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("long").alias("block"), "query_id", "term",
        (F.col("qtf") * smoothed_idf(F.lit(total.n), F.col("df"))).alias("weight"))
    # one entry for each query, so that a query is known by its place in the block and its id may have any type
    blocks = (weights.groupBy("block", "query_id").agg(F.collect_list(F.struct("term", "weight")).alias("words"))
              .groupBy("block").agg(F.collect_list(F.struct("query_id", "words")).alias("asked")))
    if subset is not None:
        bags = bags.join(subset.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = join_blocks(blocks, _packed(bags), n_blocks, WEIGHT_BYTES * size.weights, "ids", lambda: WORD_BYTES * (total.words or 0))
    schema = T.StructType([queries.schema["query_id"], bags.schema["doc_id"], T.StructField("score", T.DoubleType())])
    hits = pairs.select("asked", "ids", "lens", "owner", "terms", "tfs").mapInArrow(_scorer(k, average or 1.0), schema)
    return best_hits(hits, k)


def _packed(bags: DataFrame) -> DataFrame:
    """Blocks of documents: ids and lengths, and (document, word, tf) of their distinct words."""
    kind = bags.schema["doc_id"].dataType

    def one(values) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def pack(batches):
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(lengths) // WORD_BLOCK
            edges = np.r_[np.flatnonzero(np.diff(part, prepend=-1)), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:]):
                rows = batch.slice(start, end - start)
                own = lengths[start:end]
                words = rows.column(1).flatten().dictionary_encode()
                width = max(1, len(words.dictionary))
                key, tf = np.unique(np.repeat(np.arange(len(own)), own) * width + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0], pa.int64()), one(rows.column(0)), one(pa.array(own, pa.int32())), one(pa.array(key // width, pa.int32())),
                     one(words.dictionary.take(pa.array(key % width))), one(pa.array(tf, pa.int32()))], ["block", "ids", "lens", "owner", "terms", "tfs"])

    ints = T.ArrayType(T.IntegerType())
    return bags.mapInArrow(pack, T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("lens", ints), T.StructField("owner", ints),
        T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", ints)]))


def tile_hits(asking, words, weight, n_queries: int, doc, word, tf, length, n_words: int, k: int, average: float):
    """(query, document, score) numbers of a block of queries and one of documents: at most k (and ties) a query and tile.

    Queries are (asking, words, weight) triples, documents (doc, word, tf) triples sorted by document, words numbered in
    common. Both are multiplied in tiles of at most ``BLOCK_CELLS`` cells.
    """
    gain = saturated_tf(tf, length[doc], average)
    by_word = np.argsort(words, kind="stable")
    asking, weight, words = asking[by_word], weight[by_word], words[by_word]
    deep = max(1, BLOCK_CELLS // max(1, n_queries))
    for low in range(0, len(length), deep):
        first, last = np.searchsorted(doc, (low, low + deep))
        rows = min(deep, len(length) - low)
        scores = np.zeros((rows, n_queries))
        wide = max(1, BLOCK_CELLS // max(rows, n_queries))
        for left in range(0, n_words, wide):
            right = min(left + wide, n_words)
            inside = np.flatnonzero((word[first:last] >= left) & (word[first:last] < right)) + first
            counts, matrix = np.zeros((rows, right - left)), np.zeros((right - left, n_queries))
            counts[doc[inside] - low, word[inside] - left] = gain[inside]
            a, b = np.searchsorted(words, (left, right))
            matrix[words[a:b] - left, asking[a:b]] = weight[a:b]
            scores += counts @ matrix
        scores = np.round(scores, DIGITS)
        found = scores > 0
        if rows > k:
            found &= scores >= np.partition(scores, rows - k, axis=0)[rows - k]
        d, q = np.nonzero(found)
        yield q, d + low, scores[d, q]


def _scorer(k: int, average: float):
    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asked, ids, lens, owner, terms, tfs = (batch.column(c)[i].values for c in range(6))
                query_ids, lists = asked.field("query_id"), asked.field("words")
                wanted = lists.flatten()
                word_of = wanted.field("term").dictionary_encode()
                asking = np.repeat(np.arange(len(query_ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                words, weight = word_of.indices.to_numpy(), wanted.field("weight").to_numpy()
                length, n_queries = lens.to_numpy(), len(query_ids)
                place = pc.index_in(terms, value_set=word_of.dictionary)
                known = pc.is_valid(place).to_numpy(zero_copy_only=False)
                # only words that both blocks have, numbered anew
                shared, word = np.unique(pc.drop_null(place).to_numpy(), return_inverse=True)
                doc, tf = owner.to_numpy()[known], tfs.to_numpy()[known]
                # words of the queries that the block has
                both = np.isin(words, shared)
                for q, d, found in tile_hits(asking[both], np.searchsorted(shared, words[both]), weight[both], n_queries, doc, word, tf, length, len(shared), k, average):
                    yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(q)), ids.take(pa.array(d)), pa.array(found)], ["query_id", "doc_id", "score"])

    return score


def okapi_rerank(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Re-rank each query's own candidate list; that list is the corpus.

    Library idf: ln(N-df+.5) - ln(df+.5), negative values replaced by a quarter
    of the mean idf over all words of the list. Zero scores stay in the list.
    ``candidates`` has (query_id, doc_id, text).
    """
    posts = postings(candidates, keep=("query_id",), by_document=True)
    lists = candidates.groupBy("query_id").agg(
        F.count("*").alias("n_docs"), F.avg(token_count("text")).alias("avg_len")
    )
    raw_idf = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = (
        posts.groupBy("query_id", "term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))
        .join(lists, "query_id").withColumn("idf", raw_idf)
    )
    mean_idf = terms.groupBy("query_id").agg(F.avg("idf").alias("mean_idf"))
    weights = (
        query_terms(queries).join(terms, ["query_id", "term"]).join(mean_idf, "query_id")
        .select(
            "query_id", "term", "avg_len",
            (F.col("qtf") * F.when(F.col("idf") < 0, IDF_FLOOR * F.col("mean_idf"))
             .otherwise(F.col("idf"))).alias("weight"),
        )
    )
    gain = F.col("weight") * saturated_tf(F.col("tf"), F.col("doc_len"), F.col("avg_len"))
    matched = (
        posts.join(weights, ["query_id", "term"])
        .groupBy("query_id", "doc_id").agg(F.sum(gain).alias("score"))
    )
    scored = candidates.select("query_id", "doc_id").join(
        matched, ["query_id", "doc_id"], "left"
    ).select("query_id", "doc_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))
    return best_hits(scored, k)


def overlap_scores(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Share of a query's distinct words (split at blanks) found in each candidate text."""
    wanted = queries.select(
        "query_id",
        F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("_q"),
    )
    bag = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    return candidates.join(wanted, "query_id").withColumn(
        "overlap",
        F.when(F.size(bag) == 0, 0.0).otherwise(
            F.size(F.array_intersect("_q", bag)) / F.greatest(F.size("_q"), F.lit(1))
        ),
    ).drop("_q")
