"""Retrieval queries: BM25, dense search, re-ranking, evaluation against judgments."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import dense, sparse
from corpusflow.operators.evaluation import evaluate
from corpusflow.operators.judgments import contained_in
from corpusflow.operators.ranking import best_hits, stable
from corpusflow.operators.termindex import index_of
from corpusflow.plans import sqlparts as sql
from corpusflow.plans.registry import query
from corpusflow.session import materialize
from corpusflow.sources.tables import queries_of, spread, table, user_turns


def corpus(spark, root):
    return spread(table(spark, root, "documents").select("doc_id", "text"))


def corpus_index(spark, root):
    """The corpus as a stored inverted index."""
    return index_of(spark, root, corpus(spark, root))


def vectors(spark, root):
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def vector_queries(spark, root):
    return vectors(spark, root).withColumnRenamed("doc_id", "query_id")


def containment(spark, root):
    # Read once for hits and once for ideal gains; the written table saves a second pass over the corpus.
    return materialize(contained_in(queries_of(spark, root), corpus(spark, root)), "judgments")


@query("bm25_index_terms", "E5 C20", rf"""
SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM (
  SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({sql.WORDS}) AS term FROM documents) GROUP BY ALL)
GROUP BY term""")
def bm25_index_terms(spark, root):
    """Inverted-index statistics: document frequency and occurrences of every word."""
    return corpus_index(spark, root).occurrences()


@query("bm25_corpus_stats", "E5", rf"""
SELECT count(*) AS n_docs, round(avg(len({sql.WORDS})), 9) AS avg_len FROM documents""")
def bm25_corpus_stats(spark, root):
    """Number of documents and mean document length."""
    return corpus_index(spark, root).stats().withColumn("avg_len", F.round("avg_len", 9))


@query("bm25_doc_lengths", "E5 C20", rf"SELECT doc_id, len({sql.WORDS}) AS doc_len FROM documents")
def bm25_doc_lengths(spark, root):
    """Length in words of every document."""
    return corpus_index(spark, root).doc_lengths()


@query("bm25_topk", "E6 G1", f"WITH {sql.bm25()} {sql.ranked('scores', 10)}")
def bm25_topk(spark, root):
    """Ten best documents for every benchmark query."""
    return corpus_index(spark, root).search(queries_of(spark, root), 10)


@query("bm25_batch_turns", "E8", f"WITH {sql.bm25(sql.TURNS)} {sql.ranked('scores', 10)}")
def bm25_batch_turns(spark, root):
    """Ten best documents for every user question of every conversation."""
    return corpus_index(spark, root).search(user_turns(spark, root), 10)


@query("bm25_topk_subset", "E6 E17", f"""WITH {sql.bm25()},
sub AS (SELECT s.* FROM scores s JOIN documents USING (doc_id) WHERE lang = 'en')
{sql.ranked('sub', 10)}""")
def bm25_topk_subset(spark, root):
    """BM25 restricted to English documents, statistics from the whole corpus."""
    english = table(spark, root, "documents").filter("lang = 'en'").select("doc_id")
    return corpus_index(spark, root).search(queries_of(spark, root), 10, subset=english)


@query("benchmark_containment", "A2", f"WITH {sql.QRELS} SELECT * FROM qrels")
def benchmark_containment(spark, root):
    """Judgments: documents that contain a benchmark passage verbatim."""
    return containment(spark, root)


@query("bm25_evaluation", "I1 I2 I3 I4 I5 I6 I8", f"""WITH {sql.bm25()},
run AS ({sql.ranked('scores', 100)}), {sql.QRELS}, {sql.metrics('run')} {sql.LONG}""")
def bm25_evaluation(spark, root):
    """nDCG, MAP, recall, precision at all cut-offs and MRR of BM25 in long form."""
    run = corpus_index(spark, root).search(queries_of(spark, root), 100)
    return evaluate(run, containment(spark, root)).withColumn("value", F.round("value", 9))


@query("dense_topk", "E1 G1 K4", sql.dense_run(10))
def dense_topk(spark, root):
    """Exact cosine top-10 of every embedding among all others."""
    return dense.cosine_topk(vector_queries(spark, root), vectors(spark, root), 10, exclude_self=True)


@query("dense_topk_threshold", "B3 E1", f"""SELECT * FROM ({sql.dense_run(10)}) WHERE score >= 0.3""")
def dense_topk_threshold(spark, root):
    """Cosine top-10 with a minimum score applied before the cut."""
    return dense.cosine_topk(vector_queries(spark, root), vectors(spark, root), 10, threshold=0.3,
                             exclude_self=True)


@query("distance_search", "E2", f"""
SELECT query_id, doc_id, rank, round(1 - score, 9) AS distance, score AS similarity
FROM ({sql.dense_run(20)}) WHERE score >= 0.25""")
def distance_search(spark, root):
    """Distance-store search: top-20 first, then 1 - distance against the threshold."""
    hits = dense.cosine_topk(vector_queries(spark, root), vectors(spark, root), 20, exclude_self=True)
    return hits.select("query_id", "doc_id", "rank", stable(1 - F.col("score")).alias("distance"),
                       F.col("score").alias("similarity")).filter("similarity >= 0.25")


@query("unit_embeddings", "E3", """
SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 9) AS length,
  round(u[1], 9) AS first_value, round(list_sum(u), 9) AS total
FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x:
  x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)""")
def unit_embeddings(spark, root):
    """Embeddings scaled to unit length."""
    scaled = table(spark, root, "embeddings").select("vec_id", dense.unit("embedding").alias("u"))
    total = lambda f: F.aggregate("u", F.lit(0.0), f)
    return scaled.select("vec_id", stable(total(lambda s, x: s + x * x)).alias("length"),
                         stable(F.get("u", 0)).alias("first_value"),
                         stable(total(lambda s, x: s + x)).alias("total"))


@query("vector_functions", "K4", f"""
SELECT query_id, doc_id, round(dot, 9) AS dot, round(l2, 9) AS l2, round(cos, 9) AS cos FROM (
 SELECT r.query_id, r.doc_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dot,
  sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1]-p[2])*(p[1]-p[2])))) AS l2,
  {sql.cosine('a.embedding', 'b.embedding')} AS cos
 FROM ({sql.dense_run(5)}) r JOIN embeddings a ON a.vec_id = r.query_id JOIN embeddings b ON b.vec_id = r.doc_id)""")
def vector_functions(spark, root):
    """dot, distance and cosine as column functions on the nearest pairs."""
    hits = dense.cosine_topk(vector_queries(spark, root), vectors(spark, root), 5, exclude_self=True)
    left = vector_queries(spark, root).withColumnRenamed("vec", "a")
    right = vectors(spark, root).withColumnRenamed("vec", "b")
    gap = F.zip_with("a", "b", lambda x, y: x.cast("double") - y.cast("double"))
    return hits.join(left, "query_id").join(right, "doc_id").select(
        "query_id", "doc_id", stable(dense.dot("a", "b")).alias("dot"),
        stable(dense.norm(gap)).alias("l2"), stable(dense.cosine("a", "b")).alias("cos"))


@query("ivf_search", "E4")
def ivf_search(spark, root):
    """Clustered approximate search over stored lists: 16 cells, vectors listed in three, the 6 nearest are probed."""
    base = vectors(spark, root)
    lists = dense.InvertedLists.build(base, dense.train_centroids(base, 16), copies=3)
    return lists.search(vector_queries(spark, root), 10, n_probe=6, exclude_self=True)


CANDIDATES = f"""cand AS (SELECT r.query_id, r.doc_id, r.score, r.rank, source || '. ' || text AS text, source
  FROM ({sql.ranked('scores', 50)}) r JOIN documents USING (doc_id))"""


def candidates(spark, root):
    """BM25 candidates, min(5k, 100) per query, with title, dot and content as text."""
    docs = table(spark, root, "documents").select(
        "doc_id", "source", F.concat("source", F.lit(". "), "text").alias("text"))
    found = corpus_index(spark, root).search(queries_of(spark, root), 50).join(docs, "doc_id")
    # Several branches read the list; without the table each would search the corpus again.
    return spread(materialize(found, "candidates"))


OKAPI = rf"""
ct AS (SELECT query_id, doc_id, unnest({sql.WORDS}) AS term FROM cand),
cl AS (SELECT query_id, doc_id, len({sql.WORDS}) AS doc_len FROM cand),
cst AS (SELECT query_id, count(*) AS n, avg(doc_len) AS avg_len FROM cl GROUP BY 1),
ctf AS (SELECT query_id, doc_id, term, count(*) AS tf FROM ct GROUP BY ALL),
cidf AS (SELECT query_id, term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf, avg_len
  FROM (SELECT query_id, term, count(*) AS df FROM ctf GROUP BY ALL) JOIN cst USING (query_id)),
cm AS (SELECT query_id, avg(idf) AS mean_idf FROM cidf GROUP BY 1),
okapi AS (SELECT cand.query_id, cand.doc_id, round(coalesce(s, 0), 6) AS score FROM cand LEFT JOIN (
  SELECT query_id, doc_id, sum(qtf * CASE WHEN idf < 0 THEN 0.25::DOUBLE * mean_idf ELSE idf END
    * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))) AS s
  FROM qt JOIN cidf USING (query_id, term) JOIN cm USING (query_id) JOIN ctf USING (query_id, term)
  JOIN cl USING (query_id, doc_id) GROUP BY ALL) m
  ON m.query_id = cand.query_id AND m.doc_id = cand.doc_id)"""


@query("okapi_rerank", "E7 G2", f"""WITH {sql.bm25()}, {CANDIDATES}, {OKAPI}
{sql.ranked('okapi', 20)}""")
def okapi_rerank(spark, root):
    """Candidates of each query re-ranked by BM25 Okapi with the candidates as corpus."""
    return sparse.okapi_rerank(queries_of(spark, root), candidates(spark, root), 20)


@query("supplied_score_rank", "E9 G2", f"""WITH {sql.bm25()}, {CANDIDATES},
s AS (SELECT query_id, doc_id, score AS original_score, rank AS original_rank,
  round(1 / (1 + exp(-(score - 10.0::DOUBLE))), 9) AS score FROM cand)
SELECT query_id, doc_id, score, original_score, original_rank,
  round(score - original_score, 9) AS boost, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def supplied_score_rank(spark, root):
    """Pair logits supplied as a column: sigmoid, new rank, old rank and boost."""
    pairs = candidates(spark, root).select(
        "query_id", "doc_id", F.col("score").alias("original_score"),
        F.col("rank").alias("original_rank"),
        stable(1.0 / (1.0 + F.exp(-(F.col("score") - 10.0)))).alias("score"))
    return best_hits(pairs, 10).withColumn("boost", stable(F.col("score") - F.col("original_score")))


OVERLAP = r"""
qw AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM q),
ov AS (SELECT c.query_id, c.doc_id, c.score, len(list_intersect(w, list_distinct(
  list_filter(regexp_split_to_array(lower(c.text), '\s+'), lambda w: w <> ''))))::DOUBLE / greatest(len(w), 1) AS overlap
  FROM cand c JOIN qw USING (query_id))"""


@query("token_overlap_rank", "E11", f"""WITH {sql.bm25()}, {CANDIDATES}, {OVERLAP},
o AS (SELECT query_id, doc_id, round(overlap, 9) AS score FROM ov) {sql.ranked('o', 10)}""")
def token_overlap_rank(spark, root):
    """Candidates ranked by the share of query words they contain."""
    scored = sparse.overlap_scores(queries_of(spark, root), candidates(spark, root))
    return best_hits(scored.select("query_id", "doc_id", stable(F.col("overlap")).alias("score")), 10)
