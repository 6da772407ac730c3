"""Fusion and re-ranking of result lists for every benchmark query."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusflow.functions import embed
from corpusflow.functions.text import tokens
from corpusflow.operators import dense, fusion, sparse
from corpusflow.operators.querytext import keywords
from corpusflow.operators.ranking import best_hits, min_max, stable, z_score
from corpusflow.plans import sqlparts as sql
from corpusflow.plans.querytext import STOPS
from corpusflow.plans.registry import query
from corpusflow.plans.retrieval import CANDIDATES, OKAPI, OVERLAP, candidates, corpus, corpus_index
from corpusflow.session import materialize
from corpusflow.sources.tables import queries_of, table

DEPTH = fusion.candidate_depth(10)

_BUCKET = "((strpos('0123456789abcdef', substr(md5(w), 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(md5(w), 2, 1)) - 1) % 64"


def _counts(source, key):
    return f"SELECT {key}, b, count(*)::DOUBLE AS c FROM (SELECT {key}, {_BUCKET} AS b FROM (SELECT {key}, unnest({sql.WORDS}) AS w FROM {source})) GROUP BY ALL"


DENSE = f"""hd AS ({_counts('documents', 'doc_id')}), hq AS ({_counts('q', 'query_id')}),
nd AS (SELECT doc_id, sqrt(sum(c * c)) AS l FROM hd GROUP BY 1), nq AS (SELECT query_id, sqrt(sum(c * c)) AS l FROM hq GROUP BY 1),
cosines AS (SELECT query_id, doc_id, round(d / (nq.l * nd.l), 9) AS score FROM (
  SELECT query_id, doc_id, sum(hq.c * hd.c) AS d FROM hq JOIN hd USING (b) GROUP BY ALL) JOIN nq USING (query_id) JOIN nd USING (doc_id)),
dense AS ({sql.ranked('cosines', DEPTH)})"""
SPARSE = f"sparse AS ({sql.ranked('scores', DEPTH)})"
BOTH = f"{sql.bm25()}, {DENSE}, {SPARSE}"


def dense_run(spark, root, k=DEPTH):
    """Cosine over hashed word counts of the whole texts."""
    return dense.cosine_topk(embed.hashed(queries_of(spark, root), "query_id"), embed.hashed(corpus(spark, root), "doc_id"), k)


def sparse_run(spark, root, k=DEPTH):
    return corpus_index(spark, root).search(queries_of(spark, root), k)


@query("hashed_embeddings", "L12 K1", f"""WITH e AS ({_counts('documents', 'doc_id')})
SELECT doc_id, sum(c) AS words, count(*) AS used, round(sqrt(sum(c * c)), 9) AS length, max(c) AS top FROM e GROUP BY 1""")
def hashed_embeddings(spark, root):
    """Model-free text vectors: hashed word counts."""
    vecs = embed.hashed(corpus(spark, root), "doc_id")
    return vecs.select("doc_id", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x).alias("words"),
                       F.size(F.filter("vec", lambda x: x > 0)).alias("used"), stable(dense.norm(F.col("vec"))).alias("length"),
                       F.array_max("vec").alias("top"))


@query("text_dense_topk", "E1 L12 F4", f"WITH q AS ({sql.BENCH}), {DENSE} SELECT * FROM dense")
def text_dense_topk(spark, root):
    """Dense branch of a hybrid search: five times the wanted depth."""
    return dense_run(spark, root)


@query("weighted_fusion", "F2 F4 F10", f"""WITH {BOTH},
nm AS (SELECT query_id, doc_id, src, CASE WHEN hi = lo THEN score ELSE (score - lo) / (hi - lo) END AS norm FROM (
  SELECT *, max(score) OVER (PARTITION BY query_id, src) AS hi, min(score) OVER (PARTITION BY query_id, src) AS lo FROM (
    SELECT query_id, doc_id, score, 'd' AS src FROM dense UNION ALL SELECT query_id, doc_id, score, 's' FROM sparse))),
p AS (SELECT query_id, doc_id, coalesce(max(CASE WHEN src = 'd' THEN norm END), 0) AS d, coalesce(max(CASE WHEN src = 's' THEN norm END), 0) AS s FROM nm GROUP BY ALL),
f AS (SELECT query_id, doc_id, round(0.3::DOUBLE * d + 0.7::DOUBLE * s, 9) AS score, CASE WHEN d > 0 THEN round(d, 9) END AS dense_score, CASE WHEN s > 0 THEN round(s, 9) END AS sparse_score FROM p)
{sql.ranked('f', 10, ', dense_score, sparse_score')}""")
def weighted_fusion(spark, root):
    """Weighted sum of scaled dense and sparse scores."""
    return fusion.weighted(dense_run(spark, root), sparse_run(spark, root), 10)


RRF = """rf AS (SELECT query_id, doc_id, round(sum(w / (60 + rank)), 9) AS score FROM (
  SELECT query_id, doc_id, rank, {wd}::DOUBLE AS w FROM dense UNION ALL SELECT query_id, doc_id, rank, {ws}::DOUBLE FROM sparse) GROUP BY ALL)"""


@query("weighted_rrf", "F3 F4", f"WITH {BOTH}, {RRF.format(wd=0.3, ws=0.7)} {sql.ranked('rf', 10)}")
def weighted_rrf(spark, root):
    """Weighted reciprocal rank fusion of dense and sparse lists."""
    return fusion.weighted_reciprocal_rank(dense_run(spark, root), sparse_run(spark, root), 10)


@query("plain_rrf", "F8", f"WITH {BOTH}, {RRF.format(wd=1, ws=1)} {sql.ranked('rf', 10)}")
def plain_rrf(spark, root):
    """Reciprocal rank fusion of any lists, equal weights."""
    lists = fusion.tagged({"dense": dense_run(spark, root), "sparse": sparse_run(spark, root)}, "rank")
    return fusion.reciprocal_rank(lists, 10)


@query("multi_source_union", "F1", f"""WITH {BOTH}, u AS (
  SELECT query_id, doc_id, score, 'dense' AS src FROM dense UNION ALL SELECT query_id, doc_id, score, 'sparse' FROM sparse),
b AS (SELECT u.*, row_number() OVER (PARTITION BY query_id, md5(text) ORDER BY score DESC, u.doc_id, src DESC) AS n FROM u JOIN documents d ON d.doc_id = u.doc_id),
k AS (SELECT * FROM b WHERE n = 1) {sql.ranked('k', 10, ', src AS source')}""")
def multi_source_union(spark, root):
    """Union of sources; equal texts count once with their best score."""
    lists = fusion.tagged({"dense": dense_run(spark, root), "sparse": sparse_run(spark, root)}, "score")
    keys = corpus(spark, root).select("doc_id", F.md5("text").alias("text_key"))
    return fusion.best_per_text(lists.join(keys, "doc_id"), 10)


SCORES5 = f"""WITH {sql.bm25()}, {CANDIDATES}, {OVERLAP},
st AS (SELECT query_id, doc_id, 'query' AS src, score FROM ov UNION ALL SELECT query_id, doc_id, 'h1', round(overlap, 6) FROM ov
  UNION ALL SELECT query_id, doc_id, 'h2', round(1.0::DOUBLE / rank, 6) FROM cand),
pr AS (SELECT query_id, doc_id, max(CASE WHEN src = 'query' THEN score END) AS qs, avg(CASE WHEN src <> 'query' THEN score END) AS hs FROM st GROUP BY ALL),
pn AS (SELECT query_id, doc_id, qs, hs, CASE WHEN qhi - qlo <= 1e-8 THEN 0.5 ELSE (qs - qlo) / (qhi - qlo) END AS qn, CASE WHEN hhi - hlo <= 1e-8 THEN 0.5 ELSE (hs - hlo) / (hhi - hlo) END AS hn FROM (
  SELECT *, max(qs) OVER w AS qhi, min(qs) OVER w AS qlo, max(hs) OVER w AS hhi, min(hs) OVER w AS hlo FROM pr WINDOW w AS (PARTITION BY query_id))),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, src ORDER BY score DESC, doc_id) AS r FROM st),
fs AS (SELECT query_id, doc_id, 'weighted_average' AS strategy, round(0.2::DOUBLE * hn + 0.8::DOUBLE * qn, 9) AS score FROM pn
  UNION ALL SELECT query_id, doc_id, 'average_all', round(avg(score), 9) FROM st GROUP BY ALL
  UNION ALL SELECT query_id, doc_id, 'average_hypothetical', round(hs, 9) FROM pr
  UNION ALL SELECT query_id, doc_id, 'max', round(max(score), 9) FROM st GROUP BY ALL
  UNION ALL SELECT query_id, doc_id, 'rrf', round(sum(1.0::DOUBLE / (60 + r)), 9) FROM rk GROUP BY ALL)"""


def source_scores(spark, root):
    """Candidates scored by three sources: the query itself and two stand-ins for hypothetical answers."""
    scored = sparse.overlap_scores(queries_of(spark, root), candidates(spark, root))
    rows = F.array(*[F.struct(F.lit(n).alias("source"), c.alias("score")) for n, c in (
        ("query", F.col("score")), ("h1", F.round("overlap", 6)), ("h2", F.round(1.0 / F.col("rank"), 6)))])
    return scored.select("query_id", "doc_id", F.inline(rows))


@query("score_fusion_strategies", "F5 G3", f"""{SCORES5} SELECT * FROM (SELECT query_id, doc_id, strategy, score, row_number() OVER (PARTITION BY query_id, strategy ORDER BY score DESC, doc_id) AS rank FROM fs) WHERE rank <= 5""")
def score_fusion_strategies(spark, root):
    """All five ways to fuse query scores with hypothetical scores."""
    scores = materialize(source_scores(spark, root), "scores")
    out = None
    for strategy in fusion.STRATEGIES:
        part = best_hits(fusion.fuse_scores(scores, strategy), 5).withColumn("strategy", F.lit(strategy))
        out = part if out is None else out.unionByName(part)
    return out


@query("method_comparison", "F13", f"""{SCORES5}, mc AS (SELECT query_id, doc_id, 'query_only' AS method, score FROM st WHERE src = 'query' UNION ALL
  SELECT query_id, doc_id, 'hypothetical_only', score FROM fs WHERE strategy = 'average_hypothetical' UNION ALL SELECT query_id, doc_id, 'fused', score FROM fs WHERE strategy = 'weighted_average')
SELECT * FROM (SELECT query_id, doc_id, method, score, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC, doc_id) AS rank FROM mc) WHERE rank <= 10""")
def method_comparison(spark, root):
    """Query only, hypothetical only and fused rankings side by side."""
    scores = materialize(source_scores(spark, root), "scores")
    parts = {"query_only": scores.filter("source = 'query'").select("query_id", "doc_id", "score"),
             "hypothetical_only": fusion.fuse_scores(scores, "average_hypothetical"), "fused": fusion.fuse_scores(scores)}
    out = None
    for method, frame in parts.items():
        part = best_hits(frame, 10).withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out


VARIATIONS = rf"""vq AS (SELECT item_id AS query_id, 0 AS variation_id, 1.0::DOUBLE AS confidence, text FROM benchmark UNION ALL
  SELECT item_id, 1, 0.9::DOUBLE, string_agg(w, ' ' ORDER BY n) FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS n FROM (
    SELECT item_id, w, min(pos) AS pos FROM (SELECT item_id, unnest(w) AS w, unnest(range(len(w))) AS pos FROM (SELECT item_id, {sql.WORDS} AS w FROM benchmark))
    WHERE len(w) > 2 AND w NOT IN {STOPS} GROUP BY ALL)) WHERE n <= 10 GROUP BY item_id UNION ALL
  SELECT item_id, 2, 0.8::DOUBLE, array_to_string(list_filter({sql.WORDS}, lambda w: len(w) > 6), ' ') FROM benchmark)"""
_VBM25 = sql.bm25("SELECT query_id * 10 + variation_id AS query_id, text FROM vq")
RUNS = f"""WITH {VARIATIONS}, {_VBM25}, run AS ({sql.ranked('scores', 20)}),
vr AS (SELECT run.query_id // 10 AS query_id, run.query_id % 10 AS variation_id, confidence, doc_id, score, rank FROM run JOIN vq ON vq.query_id * 10 + vq.variation_id = run.query_id)"""


def variations(spark, root):
    """Three variations per query: the text, its keywords, its long words."""
    base = queries_of(spark, root)
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("variation_id"), F.lit(c).alias("confidence"), t.alias("text")) for i, c, t in (
        (0, 1.0, F.col("text")), (1, 0.9, F.array_join(keywords(F.col("text")), " ")),
        (2, 0.8, F.array_join(F.filter(tokens("text"), lambda w: F.length(w) > 6), " ")))])
    return base.select("query_id", F.inline(rows))


def variation_runs(spark, root):
    """All variations searched in one job."""
    varied = variations(spark, root)
    coded = varied.select(F.struct("query_id", "variation_id").alias("query_id"), "text")
    run = corpus_index(spark, root).search(coded, 20)
    plain = run.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.variation_id").alias("variation_id"), "doc_id", "score", "rank")
    return plain.join(varied.select("query_id", "variation_id", "confidence"), ["query_id", "variation_id"])


@query("variation_fusion", "F6 K3", f"""{RUNS},
f AS (SELECT query_id, doc_id, round(sum(confidence / (60 + rank)), 9) AS score, count(DISTINCT variation_id) AS num_queries, round(avg(rank), 9) AS avg_rank,
  max(CASE WHEN variation_id = 0 THEN rank END) AS first_rank FROM vr GROUP BY ALL)
{sql.ranked('f', 10, ', num_queries, avg_rank, first_rank')}""")
def variation_fusion(spark, root):
    """Rank fusion over query variations, weighted by confidence."""
    fused = fusion.variation_fusion(variation_runs(spark, root), 10)
    return fused.withColumn("first_rank", F.col("positions")[F.lit(0).cast("long")]["rank"]).drop("positions")


@query("strategy_weighted_fusion", "F7", f"""{RUNS},
f AS (SELECT query_id, doc_id, round(sum(w / (60 + rank)), 9) AS score FROM vr JOIN (VALUES (0, 0.5::DOUBLE), (1, 0.3::DOUBLE), (2, 0.2::DOUBLE)) x(variation_id, w) USING (variation_id) GROUP BY ALL)
{sql.ranked('f', 10)}""")
def strategy_weighted_fusion(spark, root):
    """Variation fusion with a weight per strategy in place of the confidence."""
    weights = F.create_map(*[x for i, w in enumerate((0.5, 0.3, 0.2)) for x in (F.lit(i).cast("long"), F.lit(w))])
    runs = variation_runs(spark, root).withColumn("confidence", weights[F.col("variation_id")])
    return fusion.variation_fusion(runs, 10).select("query_id", "doc_id", "score", "rank")


@query("hybrid_rerank", "F9 E9 E11", f"""WITH {sql.bm25()}, {CANDIDATES}, {OVERLAP},
hr AS (SELECT query_id, doc_id, 1.0::DOUBLE / (1 + exp(-(score - 10.0::DOUBLE))) AS ce, overlap, score AS original FROM ov),
hn AS (SELECT *, max(ce) OVER w AS chi, min(ce) OVER w AS clo, max(overlap) OVER w AS ohi, min(overlap) OVER w AS olo FROM hr WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, doc_id, original, round(0.6::DOUBLE * CASE WHEN chi = clo THEN 1 ELSE (ce - clo) / (chi - clo) END + 0.3::DOUBLE * CASE WHEN ohi = olo THEN 1 ELSE (overlap - olo) / (ohi - olo) END + 0.1::DOUBLE * original, 9) AS score FROM hn)
{sql.ranked('f', 10, ', original')}""")
def hybrid_rerank(spark, root):
    """Candidates re-ranked by supplied model score, word overlap and first score."""
    scored = sparse.overlap_scores(queries_of(spark, root), candidates(spark, root))
    hits = scored.select("query_id", "doc_id", (1.0 / (1.0 + F.exp(-(F.col("score") - 10.0)))).alias("cross_encoder"), "overlap", F.col("score").alias("original"))
    return fusion.hybrid_rerank(materialize(hits, "hits"), 10)


@query("min_max_scores", "F10", f"""WITH {sql.bm25()}, r AS ({sql.ranked('scores', 50)}), m AS (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM r WINDOW w AS (PARTITION BY query_id))
SELECT query_id, doc_id, round(CASE WHEN hi = lo THEN score ELSE (score - lo) / (hi - lo) END, 9) AS keep, round(CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END, 9) AS one,
 round(CASE WHEN hi - lo <= 1e-8 THEN 0.5 ELSE (score - lo) / (hi - lo) END, 9) AS half FROM m""")
def min_max_scores(spark, root):
    """Min-max scaling with its three rules for flat lists."""
    run = materialize(sparse_run(spark, root, 50), "run")
    scaled = min_max(min_max(min_max(run, ["query_id"], out="keep"), ["query_id"], out="one", constant="one"), ["query_id"], out="half", constant="half", eps=1e-8)
    return scaled.select("query_id", "doc_id", *[stable(F.col(c)).alias(c) for c in ("keep", "one", "half")])


@query("calibrated_scores", "F11 H13", f"""WITH {sql.bm25()}, r AS ({sql.ranked('scores', 50)}), m AS (SELECT *, avg(score) OVER w AS mu, stddev_pop(score) OVER w AS sd FROM r WINDOW w AS (PARTITION BY query_id))
SELECT query_id, doc_id, round(CASE WHEN sd < 1e-8 THEN score - mu ELSE (score - mu) / sd END, 6) AS z FROM m""")
def calibrated_scores(spark, root):
    """Scores centred and divided by their deviation."""
    return z_score(sparse_run(spark, root, 50), ["query_id"]).select("query_id", "doc_id", F.round("z", 6).alias("z"))


@query("ranking_overlap", "F12", f"""WITH {BOTH} SELECT query_id, count(*) AS shared FROM (SELECT query_id, doc_id FROM dense WHERE rank <= 50 INTERSECT SELECT query_id, doc_id FROM sparse WHERE rank <= 50) GROUP BY 1""")
def ranking_overlap(spark, root):
    """Documents that both rankings return, per query."""
    return fusion.overlap_sizes(dense_run(spark, root), sparse_run(spark, root))


@query("conditional_rerank", "G4 E7 G2", f"""WITH {sql.bm25()}, {CANDIDATES}, {OKAPI}, n AS (SELECT query_id, count(*) > 45 AS long FROM cand GROUP BY 1), ok AS ({sql.ranked('okapi', 45)})
SELECT query_id, doc_id, score, rank, long AS reranked FROM ok JOIN n USING (query_id) WHERE long UNION ALL
SELECT query_id, doc_id, score, rank, long FROM cand JOIN n USING (query_id) WHERE NOT long""")
def conditional_rerank(spark, root):
    """Re-ranking only where a query has more candidates than are kept."""
    found = candidates(spark, root)
    return fusion.rerank_if_longer(found, sparse.okapi_rerank(queries_of(spark, root), found, 45), 45)
