"""Token-vector and quantization queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import dense, evaluation
from corpusflow.operators import multivector as mv
from corpusflow.operators.ranking import stable
from corpusflow.operators.tokenindex import TokenIndexes
from corpusflow.plans import sqlparts as sql
from corpusflow.plans.registry import query
from corpusflow.plans.retrieval import vector_queries, vectors
from corpusflow.session import materialize
from corpusflow.sources.tables import table, token_vectors

TOK = "tok AS (SELECT vec_id // 8 AS doc_id, vec_id % 8 AS pos, embedding::DOUBLE[] AS vec, label FROM embeddings)"
FLAT = f"{TOK}, flat AS (SELECT doc_id, pos, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM tok)"
COMPLEXITY = f"""{FLAT},
cv AS (SELECT doc_id, avg(v) AS v FROM (SELECT doc_id, dim, var_samp(x) AS v FROM flat GROUP BY ALL) GROUP BY 1),
cn AS (SELECT doc_id, stddev_samp(sqrt(list_inner_product(vec, vec))) AS s FROM tok GROUP BY 1),
cx AS (SELECT doc_id, round((v + s) / 2, 9) AS complexity FROM cv JOIN cn USING (doc_id)),
pf AS (SELECT doc_id, complexity, CASE WHEN complexity > 0.5 THEN 1 WHEN complexity > 0.3 THEN 2 WHEN complexity > 0.15 THEN 3 ELSE 4 END AS factor FROM cx)"""


def tokens(spark, root):
    return token_vectors(spark, root).select("doc_id", "pos", "vec")


@query("token_complexity", "L1 L2", f"WITH {COMPLEXITY} SELECT doc_id, complexity, factor FROM pf")
def token_complexity(spark, root):
    """Complexity of every document's token vectors and the pooling factor it calls for."""
    return mv.complexity(tokens(spark, root)).withColumn("factor", mv.pool_factor(F.col("complexity")))


@query("pooled_tokens", "L3", f"""WITH {COMPLEXITY}
SELECT doc_id, pos, dim, round(x, 9) AS x FROM (SELECT doc_id, flat.pos // factor AS pos, dim, sum(x) / factor AS x FROM flat JOIN pf USING (doc_id) GROUP BY doc_id, flat.pos // factor, dim, factor)""")
def pooled_tokens(spark, root):
    """Token vectors pooled by the factor of their document, last group padded with zeros."""
    factors = mv.complexity(tokens(spark, root)).select("doc_id", mv.pool_factor(F.col("complexity")).alias("factor"))
    return mv.pool(tokens(spark, root).join(factors, "doc_id")).withColumn("x", stable(F.col("x")))


@query("fixed_pooling", "L3", f"""WITH {FLAT}
SELECT doc_id, pos // 3 AS pos, dim, round(sum(x) / 3, 9) AS zero_pad, round(avg(x), 9) AS exact FROM flat GROUP BY ALL""")
def fixed_pooling(spark, root):
    """Pooling by three with both rules for the last group."""
    three = tokens(spark, root).withColumn("factor", F.lit(3))
    zero = mv.pool(three).select("doc_id", "pos", "dim", stable(F.col("x")).alias("zero_pad"))
    return zero.join(mv.pool(three, "exact").select("doc_id", "pos", "dim", stable(F.col("x")).alias("exact")), ["doc_id", "pos", "dim"])


@query("domain_truncation", "L4", f"""WITH {TOK}, d AS (SELECT *, ['biomedical', 'scientific', 'financial', 'argumentative', 'other'][(doc_id % 5 + 1)::INT] AS domain FROM tok)
SELECT domain, CASE domain WHEN 'biomedical' THEN 350 WHEN 'scientific' THEN 400 WHEN 'financial' THEN 280 WHEN 'argumentative' THEN 250 ELSE 300 END AS maxlen,
  count(*) AS tokens, sum(CASE WHEN pos * 60 < CASE domain WHEN 'biomedical' THEN 350 WHEN 'scientific' THEN 400 WHEN 'financial' THEN 280 WHEN 'argumentative' THEN 250 ELSE 300 END THEN 1 ELSE 0 END)::BIGINT AS kept FROM d GROUP BY ALL""")
def domain_truncation(spark, root):
    """Token limits per domain applied to positions (every vector stands for 60 positions)."""
    names = F.array(*[F.lit(d) for d in ("biomedical", "scientific", "financial", "argumentative", "other")])
    t = tokens(spark, root).select(F.get(names, F.pmod("doc_id", F.lit(5)).cast("int")).alias("domain"), "pos")
    t = t.withColumn("maxlen", mv.domain_maxlen(F.col("domain")))
    return t.groupBy("domain", "maxlen").agg(F.count("*").alias("tokens"), F.sum((F.col("pos") * 60 < F.col("maxlen")).cast("long")).alias("kept"))


@query("multivector_storage", "L5 A18", f"""WITH {TOK} SELECT count(DISTINCT doc_id) AS documents, count(*) AS tokens, max(len(vec)) AS dim,
  round(count(*)::DOUBLE / count(DISTINCT doc_id), 9) AS avg_tokens, round(count(*) * max(len(vec)) * 4 / 1048576.0::DOUBLE, 9) AS storage_mib FROM tok""")
def multivector_storage(spark, root):
    """Size of the token-vector index."""
    stats = mv.storage_stats(tokens(spark, root))
    return stats.withColumns({"avg_tokens": stable(F.col("avg_tokens")), "storage_mib": stable(F.col("storage_mib"))})


@query("centroids", "K6", """WITH f AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS dim FROM embeddings),
m AS (SELECT label, dim, avg(x) AS x FROM f GROUP BY ALL)
SELECT label, (SELECT count(*) FROM embeddings e WHERE e.label = m.label) AS n, round(sqrt(sum(x * x)), 9) AS length, round(max(CASE WHEN dim = 0 THEN x END), 9) AS first_value, round(sum(x), 9) AS total FROM m GROUP BY 1""")
def centroids(spark, root):
    """Mean vector of every label."""
    means = mv.centroids(table(spark, root, "embeddings").select("label", F.col("embedding").alias("vec")), "label")
    return means.select("label", "n", stable(dense.norm(F.col("centroid"))).alias("length"), stable(F.get("centroid", F.lit(0))).alias("first_value"),
                        stable(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)).alias("total"))


def _three_indexes(spark, root):
    """Indexes of the even, the odd and all documents; the odd one is deleted again."""
    t, found = tokens(spark, root), TokenIndexes(spark)
    for name, part in (("even", t.filter("doc_id % 2 = 0")), ("odd", t.filter("doc_id % 2 = 1")), ("all", t)):
        found.save(name, part)
    found.delete("odd")
    return found


@query("token_index_catalog", "A18", f"""WITH {TOK}, n AS (SELECT 'all' AS name, * FROM tok UNION ALL SELECT 'even', * FROM tok WHERE doc_id % 2 = 0)
SELECT name, count(DISTINCT doc_id) AS documents, count(*) AS tokens, max(len(vec)) AS dim, round(count(*) * max(len(vec)) / 1048576.0::DOUBLE, 9) AS storage_mib FROM n GROUP BY 1""")
def token_index_catalog(spark, root):
    """Stored token-vector indexes after three saves and a delete."""
    return _three_indexes(spark, root).catalog().select("name", "documents", "tokens", "dim", stable(F.col("storage_mib")).alias("storage_mib"))


@query("token_index_search", "A18 E10")
def token_index_search(spark, root):
    """MaxSim top-10 through a stored index: cells near the query's tokens, candidates scored exactly."""
    t, found = tokens(spark, root), TokenIndexes(spark)
    found.save("all", t)
    return found.load("all").search(t.withColumnRenamed("doc_id", "query_id"), 10)


MAXSIM = f"""{TOK}, ms AS (SELECT q.doc_id AS query_id, d.doc_id, q.pos, max(list_inner_product(q.vec, d.vec)) AS best FROM tok q, tok d GROUP BY ALL),
mx AS (SELECT query_id, doc_id, round(avg(best), 9) AS score FROM ms GROUP BY ALL)"""


@query("maxsim_topk", "E10", f"WITH {MAXSIM} {sql.ranked('mx', 10)}")
def maxsim_topk(spark, root):
    """MaxSim top-10 of every document's token vectors against all documents."""
    docs = mv.packed_documents(tokens(spark, root))
    return mv.maxsim_topk(docs.withColumnRenamed("doc_id", "query_id"), docs, 10)


@query("hypothetical_topk", "E12", f"""WITH {MAXSIM},
v AS (SELECT query_id // 4 AS query_id, query_id % 4 AS variant, doc_id, score FROM (SELECT query_id, doc_id, avg(best) AS score FROM ms GROUP BY ALL)),
p AS (SELECT query_id, doc_id, max(CASE WHEN variant = 0 THEN score END) AS qs, coalesce(avg(CASE WHEN variant > 0 THEN score END), 0) AS hs FROM v GROUP BY ALL),
n AS (SELECT *, max(qs) OVER w AS qhi, min(qs) OVER w AS qlo, max(hs) OVER w AS hhi, min(hs) OVER w AS hlo FROM p WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, doc_id, round(qs, 9) AS query_score, round(hs, 9) AS hypothetical_score, round(0.2::DOUBLE * CASE WHEN hhi - hlo < 1e-8 THEN 0.5 ELSE (hs - hlo) / (hhi - hlo) END
  + 0.8::DOUBLE * CASE WHEN qhi - qlo < 1e-8 THEN 0.5 ELSE (qs - qlo) / (qhi - qlo) END, 9) AS score FROM n) {sql.ranked('f', 10, ', query_score, hypothetical_score')}""")
def hypothetical_topk(spark, root):
    """Four documents form a query with three hypothetical answers; fused MaxSim over all documents."""
    docs = mv.packed_documents(tokens(spark, root))
    variants = docs.select(F.expr("doc_id div 4").alias("query_id"), F.pmod("doc_id", F.lit(4)).alias("variant"), "lens", "flat")
    return mv.hypothetical_topk(mv.packed_variants(variants), docs, 10)


# the exponent of a half is at least -14, its fraction has ten bits, ties go to the even neighbour
@query("half_precision", "L6", """WITH u AS (SELECT vec_id, x, pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10) AS ulp FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings))
SELECT vec_id AS doc_id, max(CASE WHEN x = 0 THEN 0 ELSE abs((round_even(x::DOUBLE / ulp, 0) * ulp)::FLOAT - x) END)::DOUBLE AS max_error FROM u GROUP BY 1""")
def half_precision(spark, root):
    """Largest error of 16-bit storage per vector."""
    base = vectors(spark, root).withColumn("orig", F.col("vec"))
    error = F.zip_with("vec", "orig", lambda a, b: F.abs(a - b))
    return mv.half_precision(base).select("doc_id", F.array_max(error).cast("double").alias("max_error"))


INT8 = """ends AS (SELECT min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM embeddings),
i8 AS (SELECT vec_id, label, list_transform(embedding, lambda x: round((x::DOUBLE - lo) / (hi - lo) * 255) - 128) AS codes FROM embeddings, ends)"""


@query("int8_codes", "L7", f"""WITH {INT8} SELECT vec_id, list_sum(codes)::BIGINT AS total, list_min(codes)::BIGINT AS low, list_max(codes)::BIGINT AS high, codes[1]::BIGINT AS first_code FROM i8""")
def int8_codes(spark, root):
    """Codes -128..127 of every vector on the table's range."""
    coded = mv.int8_codes(vectors(spark, root))
    return coded.select(F.col("doc_id").alias("vec_id"), F.aggregate("codes", F.lit(0), lambda s, x: s + x).alias("total"),
                        F.array_min("codes").alias("low"), F.array_max("codes").alias("high"), F.get("codes", F.lit(0)).alias("first_code"))


BITS = """bits AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s FROM embeddings)"""


@query("binary_codes", "L8", """
SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - 1)::INT ELSE 0::BIGINT END))::BIGINT AS word0,
  list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i + 32] > 0 THEN 1::BIGINT << (i - 1)::INT ELSE 0::BIGINT END))::BIGINT AS word1 FROM embeddings""")
def binary_codes(spark, root):
    """Sign bits of every vector packed into words."""
    return vectors(spark, root).select(F.col("doc_id").alias("vec_id"), mv.sign_bits("vec").alias("w")).select(
        "vec_id", F.get("w", F.lit(0)).alias("word0"), F.get("w", F.lit(1)).alias("word1"))


@query("hamming_topk", "L8 K4", f"""WITH {BITS}, h AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_inner_product(a.s, b.s) AS score FROM bits a, bits b WHERE a.vec_id <> b.vec_id)
SELECT query_id, doc_id, ((64 - score) / 2)::BIGINT AS distance, rank FROM ({sql.ranked('h', 10)})""")
def hamming_topk(spark, root):
    """Ten nearest sign codes by Hamming distance, checked on the packed words."""
    signs = vectors(spark, root).withColumn("vec", F.transform("vec", lambda x: F.when(x > 0, 1.0).otherwise(-1.0).cast("float")))
    hits = dense.cosine_topk(signs.withColumnRenamed("doc_id", "query_id"), signs, 10, exclude_self=True, normalize=False)
    packed = vectors(spark, root).select("doc_id", mv.sign_bits("vec").alias("b"))
    left = packed.select(F.col("doc_id").alias("query_id"), F.col("b").alias("a"))
    return hits.join(left, "query_id").join(packed, "doc_id").select("query_id", "doc_id", mv.hamming("a", "b").alias("distance"), "rank")


@query("product_quantization", "L9")
def product_quantization(spark, root):
    """Search in code space, eight bytes a vector, the hundred best of each query scored exactly."""
    base = vectors(spark, root)
    books = mv.train_codebooks(base, 8, 256)
    codes = materialize(mv.product_codes(base, books), "codes")
    return mv.product_topk(vector_queries(spark, root), base, codes, books, 10, 100, exclude_self=True)


def _quality_sql(name, source, dims=None):
    return f"""run_{name} AS (SELECT query_id, doc_id, rank FROM ({sql.ranked(source, 10)}))"""


QUANT = f"""WITH {INT8}, {BITS},
cf AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({sql.cosine('a.embedding', 'b.embedding')}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
ci AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({sql.cosine('a.codes', 'b.codes')}, 9) AS score FROM i8 a, i8 b WHERE a.vec_id <> b.vec_id),
cb AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_inner_product(a.s, b.s) AS score FROM bits a, bits b WHERE a.vec_id <> b.vec_id),
{_quality_sql('float32', 'cf')}, {_quality_sql('int8', 'ci')}, {_quality_sql('binary', 'cb')},
runs AS (SELECT query_id * 10 AS query_id, doc_id, rank FROM run_float32 UNION ALL SELECT query_id * 10 + 1, doc_id, rank FROM run_int8 UNION ALL SELECT query_id * 10 + 2, doc_id, rank FROM run_binary),
qrels1 AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, 1 AS rel FROM embeddings a, embeddings b WHERE a.label = b.label AND a.vec_id <> b.vec_id),
qrels AS (SELECT query_id * 10 + t AS query_id, doc_id, rel FROM qrels1, range(3) x(t)), {sql.metrics('runs', cutoffs=(10,))},
s AS (SELECT ['float32', 'int8', 'binary'][(query_id % 10 + 1)::INT] AS form, avg(ndcg) AS ndcg FROM perq GROUP BY 1)
SELECT form, round(ndcg, 9) AS ndcg, CASE form WHEN 'float32' THEN 1.0::DOUBLE WHEN 'int8' THEN 4.0 ELSE 32.0 END AS compression,
  round((SELECT count(*) * max(len(embedding)) FROM embeddings) * CASE form WHEN 'float32' THEN 4.0::DOUBLE WHEN 'int8' THEN 1.0 ELSE 0.125 END / 1048576.0::DOUBLE, 9) AS storage_mib,
  round(CASE form WHEN 'float32' THEN 1.0::DOUBLE WHEN 'int8' THEN 0.25 ELSE 0.03125 END, 9) AS relative_storage,
  round((max(CASE WHEN form = 'float32' THEN ndcg END) OVER () - ndcg) / max(CASE WHEN form = 'float32' THEN ndcg END) OVER () * 100, 6) AS quality_loss_pct FROM s"""


@query("quantization_comparison", "L10 H20", QUANT)
def quantization_comparison(spark, root):
    """Quality, storage and loss of float, 8-bit and sign codes."""
    base = vectors(spark, root)
    labels = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), "label")
    signs = base.withColumn("vec", F.transform("vec", lambda x: F.when(x > 0, 1.0).otherwise(-1.0).cast("float")))
    codes = mv.int8_codes(base).select("doc_id", F.transform("codes", lambda x: x.cast("float")).alias("vec"))
    forms = {"float32": (base, True), "int8": (codes, True), "binary": (signs, False)}
    out = None
    for name, (frame, scale) in forms.items():
        run = dense.cosine_topk(frame.withColumnRenamed("doc_id", "query_id"), frame, 10, exclude_self=True, normalize=scale)
        part = evaluation.label_metrics(run, labels, (10,)).select(F.lit(name).alias("form"), F.col("`ndcg@10`").alias("n"))
        out = part if out is None else out.unionByName(part)
    means = out.groupBy("form").agg(F.avg("n").alias("n"))
    exact = means.filter("form = 'float32'").select("n").scalar()
    values = base.agg((F.count("*") * F.max(F.size("vec"))).alias("v")).scalar()
    of = lambda i: F.create_map(*[F.lit(x) for f in mv.STORAGE_FORMS for x in (f[0], f[i])])[F.col("form")]
    return means.select(
        "form", stable(F.col("n")).alias("ndcg"), of(1).alias("compression"), stable(values * of(2) / F.lit(1048576.0)).alias("storage_mib"),
        stable(of(2) / 4.0).alias("relative_storage"), F.round((exact - F.col("n")) / exact * 100, 6).alias("quality_loss_pct"))


DIMS = (64, 32, 16, 8)


@query("dimension_sweep", "L11", "WITH " + ", ".join(f"""c{d} AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({sql.cosine(f'a.embedding[1:{d}]', f'b.embedding[1:{d}]')}, 9) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id), r{d} AS ({sql.ranked(f'c{d}', 10)})""" for d in DIMS) + ", runs AS ("
  + " UNION ALL ".join(f"SELECT query_id * 10 + {i} AS query_id, doc_id, rank FROM r{d}" for i, d in enumerate(DIMS)) + f"""),
qrels1 AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, 1 AS rel FROM embeddings a, embeddings b WHERE a.label = b.label AND a.vec_id <> b.vec_id),
qrels AS (SELECT query_id * 10 + t AS query_id, doc_id, rel FROM qrels1, range(4) x(t)), {sql.metrics('runs', cutoffs=(10,))}
SELECT [64, 32, 16, 8][(query_id % 10 + 1)::INT] AS dim, round(avg(ndcg), 9) AS ndcg, round(avg(recall), 9) AS recall,
  round((SELECT count(*) FROM embeddings) * [64, 32, 16, 8][(query_id % 10 + 1)::INT] * 4 / 1048576.0::DOUBLE, 9) AS storage_mib FROM perq GROUP BY query_id % 10""")
def dimension_sweep(spark, root):
    """Quality and storage of vectors cut to fewer dimensions."""
    base = vectors(spark, root)
    labels = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), "label")
    n = base.agg(F.count("*")).scalar()
    out = None
    for dim in DIMS:
        cut = base.withColumn("vec", F.slice("vec", 1, dim))
        run = dense.cosine_topk(cut.withColumnRenamed("doc_id", "query_id"), cut, 10, exclude_self=True)
        part = evaluation.label_metrics(run, labels, (10,)).agg(
            F.lit(dim).alias("dim"), F.round(F.avg("`ndcg@10`"), 9).alias("ndcg"), F.round(F.avg("`recall@10`"), 9).alias("recall"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("storage_mib", stable(evaluation.storage_mib(n, F.col("dim"))))
