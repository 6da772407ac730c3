"""Evaluation queries: comparisons, sweeps, reports and cost models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusflow.operators import chunking, evaluation, fusion
from corpusflow.operators.partsearch import search_parts
from corpusflow.operators.ranking import best_hits, stable, top_k
from corpusflow.plans import sqlparts as sql
from corpusflow.plans.corpus import paragraph_packing_sql, sentence_packing_sql, windows_sql
from corpusflow.plans.fusion import BOTH, RRF, dense_run, sparse_run
from corpusflow.plans.registry import query
from corpusflow.plans.retrieval import containment, corpus, corpus_index, vector_queries, vectors
from corpusflow.session import materialize
from corpusflow.sources.tables import events, queries_of, spread, table


@query("dense_evaluation", "I1 I2 I3 I4 I5 I6 I8 E14", f"""WITH run AS ({sql.dense_run(100)}), {sql.LABEL_QRELS}, {sql.metrics('run')} {sql.LONG}""")
def dense_evaluation(spark, root):
    """Metrics of cosine search with equal labels as judgments."""
    from corpusflow.operators import dense

    run = dense.cosine_topk(vector_queries(spark, root), vectors(spark, root), 100, exclude_self=True)
    labels = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return evaluation.mean_metrics(evaluation.label_metrics(run, labels)).withColumn("value", F.round("value", 9))


@query("ndcg_by_domain", "I7", f"""WITH run AS ({sql.dense_run(10)}), {sql.LABEL_QRELS}, {sql.metrics('run', cutoffs=(10,))}
SELECT label AS domain, count(*) AS queries, round(avg(ndcg), 9) AS ndcg FROM perq JOIN embeddings ON vec_id = query_id GROUP BY 1""")
def ndcg_by_domain(spark, root):
    """nDCG at 10 per label."""
    from corpusflow.operators import dense

    run = dense.cosine_topk(vector_queries(spark, root), vectors(spark, root), 10, exclude_self=True)
    labels = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), "label")
    scored = evaluation.label_metrics(run, labels, (10,)).join(labels.withColumnRenamed("id", "query_id"), "query_id")
    return scored.groupBy(F.col("label").alias("domain")).agg(F.count("*").alias("queries"), F.round(F.avg("`ndcg@10`"), 9).alias("ndcg"))


@query("graded_evaluation", "I1 I6", f"""WITH {sql.bm25()}, run AS ({sql.ranked('scores', 100)}),
qrels AS (SELECT query_id, doc_id, 1 + (len(text) > 1000)::INT + (lang = 'en')::INT AS rel FROM (SELECT item_id AS query_id, doc_id, d.text, lang FROM benchmark b, documents d WHERE contains(d.text, b.text))),
{sql.metrics('run')} {sql.LONG}""")
def graded_evaluation(spark, root):
    """Metrics with graded judgments 1 to 3."""
    docs = table(spark, root, "documents")
    grade = (1 + (F.length("text") > 1000).cast("int") + (F.col("lang") == "en").cast("int")).alias("rel")
    qrels = containment(spark, root).drop("rel").join(docs.select("doc_id", grade), "doc_id")
    run = corpus_index(spark, root).search(queries_of(spark, root), 100)
    return evaluation.evaluate(run, qrels).withColumn("value", F.round("value", 9))


# Techniques compared, in order; the number is added to ten times the query id.
TECHNIQUES = ["bm25", "dense", "weighted", "rrf"]
_CASE = "CASE query_id % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TECHNIQUES)) + " END"

RESULTS = f"""WITH {BOTH},
nm AS (SELECT query_id, doc_id, src, CASE WHEN hi = lo THEN score ELSE (score - lo) / (hi - lo) END AS norm FROM (
  SELECT *, max(score) OVER (PARTITION BY query_id, src) AS hi, min(score) OVER (PARTITION BY query_id, src) AS lo FROM (
    SELECT query_id, doc_id, score, 'd' AS src FROM dense UNION ALL SELECT query_id, doc_id, score, 's' FROM sparse))),
wf AS (SELECT query_id, doc_id, round(sum(CASE WHEN src = 'd' THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END * norm), 9) AS score FROM nm GROUP BY ALL),
{RRF.format(wd=0.3, ws=0.7)}, {sql.QRELS.replace('qrels AS', 'qrels1 AS')},
runs AS (SELECT query_id * 10 AS query_id, doc_id, rank FROM sparse WHERE rank <= 10 UNION ALL SELECT query_id * 10 + 1, doc_id, rank FROM dense WHERE rank <= 10
  UNION ALL SELECT query_id * 10 + 2, doc_id, rank FROM ({sql.ranked('wf', 10)}) UNION ALL SELECT query_id * 10 + 3, doc_id, rank FROM ({sql.ranked('rf', 10)})),
qrels AS (SELECT query_id * 10 + t AS query_id, doc_id, rel FROM qrels1, range(4) x(t)), {sql.metrics('runs', cutoffs=(10,))},
results AS (SELECT {_CASE} AS technique, CASE WHEN len(text) > 150 THEN 'long' ELSE 'short' END AS dataset, query_id // 10 AS query_id, ndcg, map, recall, precision, mrr,
  coalesce(ms, (SELECT round(avg(value), 6) FROM events)) / 1000.0::DOUBLE AS seconds FROM perq JOIN benchmark ON item_id = query_id // 10
  LEFT JOIN (SELECT json_extract_string(props, '$.k')::BIGINT AS k, round(avg(value), 6) AS ms FROM events GROUP BY 1) lg ON lg.k = item_id)"""


def results(spark, root):
    """Per technique, data set (short or long queries) and query: all metrics at 10, in one evaluation job."""
    lists = {"dense": materialize(dense_run(spark, root), "dense"), "sparse": materialize(sparse_run(spark, root), "sparse")}
    runs = {"bm25": lists["sparse"].filter("rank <= 10"), "dense": lists["dense"].filter("rank <= 10"),
            "weighted": fusion.weighted(lists["dense"], lists["sparse"], 10),
            "rrf": fusion.weighted_reciprocal_rank(lists["dense"], lists["sparse"], 10)}
    coded = None
    for number, name in enumerate(TECHNIQUES):
        part = runs[name].select(F.struct("query_id", F.lit(number).alias("t")).alias("query_id"), "doc_id", "rank")
        coded = part if coded is None else coded.unionByName(part)
    numbers = F.explode(F.array(*[F.lit(i) for i in range(len(TECHNIQUES))]))
    qrels = containment(spark, root).withColumn("t", numbers).select(F.struct("query_id", "t").alias("query_id"), "doc_id", "rel")
    scored = evaluation.per_query_metrics(coded, qrels, (10,))
    names = F.get(F.array(*[F.lit(t) for t in TECHNIQUES]), F.col("query_id.t"))
    plain = scored.select(names.alias("technique"), F.col("query_id.query_id").alias("query_id"),
                          *[F.col(f"`{m}@10`").alias(m) for m in ("ndcg", "map", "recall", "precision")], "mrr")
    # a query's time is its mean in the log, or the log's mean where it is not logged
    log = events(spark, root)
    times = log.groupBy(F.col("k").alias("query_id")).agg(F.round(F.avg("value"), 6).alias("ms"))
    mean = log.agg(F.round(F.avg("value"), 6).alias("mean")).scalar()
    asked = queries_of(spark, root).join(times, "query_id", "left").select(
        "query_id", F.when(F.length("text") > 150, "long").otherwise("short").alias("dataset"), (F.coalesce("ms", mean) / 1000.0).alias("seconds"))
    return plain.join(asked, "query_id")


@query("technique_comparison", "I9 H19", f"""{RESULTS}
SELECT coalesce(technique, 'all') AS technique, coalesce(dataset, 'all') AS dataset, count(*) AS evaluations, round(avg(ndcg), 9) AS ndcg, round(avg(map), 9) AS map,
  round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision, round(avg(mrr), 9) AS mrr, round(avg(seconds), 9) AS seconds
FROM results GROUP BY GROUPING SETS ((), (technique), (dataset), (technique, dataset))""")
def technique_comparison(spark, root):
    """Report at all grains: overall, per technique, per data set, per pair."""
    out = results(spark, root).groupingSets([[], ["technique"], ["dataset"], ["technique", "dataset"]], "technique", "dataset").agg(
        F.count("*").alias("evaluations"), *[F.round(F.avg(m), 9).alias(m) for m in ("ndcg", "map", "recall", "precision", "mrr", "seconds")])
    return out.withColumns({"technique": F.coalesce("technique", F.lit("all")), "dataset": F.coalesce("dataset", F.lit("all"))})


@query("technique_pivot", "H18", f"""{RESULTS}
SELECT technique, round(avg(CASE WHEN dataset = 'long' THEN ndcg END), 9) AS long, round(avg(CASE WHEN dataset = 'short' THEN ndcg END), 9) AS short FROM results GROUP BY 1""")
def technique_pivot(spark, root):
    """Techniques in rows, data sets in columns."""
    return results(spark, root).groupBy("technique").pivot("dataset", ["long", "short"]).agg(F.round(F.avg("ndcg"), 9))


@query("dataset_difficulty", "H18 G9", f"""{RESULTS}
SELECT dataset, round(avg(ndcg), 9) AS mean_ndcg, rank() OVER (ORDER BY round(avg(ndcg), 9)) AS difficulty FROM results GROUP BY 1""")
def dataset_difficulty(spark, root):
    """Data sets from hardest to easiest."""
    means = results(spark, root).groupBy("dataset").agg(F.round(F.avg("ndcg"), 9).alias("mean_ndcg"))
    return means.withColumn("difficulty", F.rank().over(W.orderBy("mean_ndcg")))


@query("best_techniques", "G5 G9", f"""{RESULTS}, m AS (SELECT technique, dataset, round(avg(ndcg), 9) AS score FROM results GROUP BY ALL)
SELECT dataset, technique, score, rank() OVER (PARTITION BY dataset ORDER BY score DESC) AS place,
  technique = first_value(technique) OVER (PARTITION BY dataset ORDER BY score DESC, technique) AS is_best FROM m""")
def best_techniques(spark, root):
    """Place of every technique per data set and the winner."""
    means = results(spark, root).groupBy("technique", "dataset").agg(F.round(F.avg("ndcg"), 9).alias("score"))
    w = W.partitionBy("dataset")
    return means.withColumn("place", F.rank().over(w.orderBy(F.col("score").desc()))).withColumn(
        "is_best", F.col("technique") == F.first("technique").over(w.orderBy(F.col("score").desc(), "technique")))


@query("efficiency_ranking", "H20 G6", f"""{RESULTS}, m AS (SELECT technique, dataset, avg(ndcg) AS n, avg(seconds) AS t FROM results GROUP BY ALL)
SELECT technique, dataset, round(n / t, 9) AS efficiency FROM m ORDER BY efficiency DESC, technique, dataset LIMIT 3""")
def efficiency_ranking(spark, root):
    """Three best ratios of quality to time."""
    means = results(spark, root).groupBy("technique", "dataset").agg(F.avg("ndcg").alias("n"), F.avg("seconds").alias("t"))
    return means.select("technique", "dataset", stable(F.col("n") / F.col("t")).alias("efficiency")).orderBy(F.col("efficiency").desc(), "technique", "dataset").limit(3)


@query("ablation_gains", "G8", f"""{RESULTS}, m AS (SELECT technique, list_position(['bm25', 'dense', 'weighted', 'rrf'], technique) AS step, avg(ndcg) AS s FROM results GROUP BY ALL)
SELECT technique, step, round(s, 9) AS score, round((s - first_value(s) OVER (ORDER BY step)) / first_value(s) OVER (ORDER BY step) * 100, 6) AS gain_pct,
  round(coalesce(s - lag(s) OVER (ORDER BY step), 0), 9) AS step_change FROM m""")
def ablation_gains(spark, root):
    """Improvement over the first technique and over the one before."""
    step = F.array_position(F.array(*[F.lit(t) for t in TECHNIQUES]), F.col("technique"))
    means = results(spark, root).groupBy("technique").agg(F.avg("ndcg").alias("s")).withColumn("step", step)
    order = W.orderBy("step")
    first = F.first("s").over(order)
    return means.select("technique", "step", stable(F.col("s")).alias("score"), F.round((F.col("s") - first) / first * 100, 6).alias("gain_pct"),
                        stable(F.coalesce(F.col("s") - F.lag("s").over(order), F.lit(0.0))).alias("step_change"))


@query("sensitivity_variance", "H21", f"""{RESULTS}, m AS (SELECT technique, dataset, avg(ndcg) AS s FROM results GROUP BY ALL)
SELECT technique, dataset, round(s, 9) AS score, round(var_samp(s) OVER (PARTITION BY technique), 9) AS variance FROM m""")
def sensitivity_variance(spark, root):
    """Variance of quality over data sets, next to each mean."""
    means = results(spark, root).groupBy("technique", "dataset").agg(F.avg("ndcg").alias("s"))
    return means.select("technique", "dataset", stable(F.col("s")).alias("score"), stable(F.var_samp("s").over(W.partitionBy("technique"))).alias("variance"))


# Fusion configurations of the weight sweep; None is rank fusion.
FUSION_CONFIGS = [("dense only", 1.0, 0.0), ("sparse only", 0.0, 1.0), ("hybrid 70/30", 0.7, 0.3), ("hybrid 50/50", 0.5, 0.5),
                  ("hybrid 30/70", 0.3, 0.7), ("hybrid rrf", None, None)]
_CONFIG_ROWS = ", ".join(f"({i}, '{n}', {d}::DOUBLE, {s}::DOUBLE)" for i, (n, d, s) in enumerate(FUSION_CONFIGS) if d is not None)


@query("fusion_weight_sweep", "I12", f"""WITH {BOTH},
nm AS (SELECT query_id, doc_id, src, CASE WHEN hi = lo THEN score ELSE (score - lo) / (hi - lo) END AS norm FROM (
  SELECT *, max(score) OVER (PARTITION BY query_id, src) AS hi, min(score) OVER (PARTITION BY query_id, src) AS lo FROM (
    SELECT query_id, doc_id, score, 'd' AS src FROM dense UNION ALL SELECT query_id, doc_id, score, 's' FROM sparse))),
cfg(c, name, wd, ws) AS (VALUES {_CONFIG_ROWS}),
wf AS (SELECT query_id * 10 + c AS query_id, doc_id, round(sum(CASE WHEN src = 'd' THEN wd ELSE ws END * norm), 9) AS score FROM nm, cfg GROUP BY ALL),
{RRF.format(wd=0.3, ws=0.7)}, af AS (SELECT * FROM wf UNION ALL SELECT query_id * 10 + 5, doc_id, score FROM rf),
runs AS ({sql.ranked('af', 10)}), {sql.QRELS.replace('qrels AS', 'qrels1 AS')}, qrels AS (SELECT query_id * 10 + t AS query_id, doc_id, rel FROM qrels1, range(6) x(t)),
{sql.metrics('runs', cutoffs=(10,))}
SELECT ['dense only', 'sparse only', 'hybrid 70/30', 'hybrid 50/50', 'hybrid 30/70', 'hybrid rrf'][(query_id % 10 + 1)::INT] AS configuration,
  round(avg(ndcg), 9) AS ndcg, round(avg(recall), 9) AS recall, round(avg(map), 9) AS map FROM perq GROUP BY 1""")
def fusion_weight_sweep(spark, root):
    """Quality of six fusion configurations, evaluated in one job."""
    from corpusflow.operators.ranking import min_max

    lists = materialize(fusion.tagged({"dense": dense_run(spark, root), "sparse": sparse_run(spark, root)}, "score", "rank"), "lists")
    scaled = min_max(lists, ["query_id", "source"])
    shares = F.array(*[
        F.struct(F.lit(i).alias("c"), (
            F.when(F.col("source") == "dense", fusion.DENSE_WEIGHT).otherwise(fusion.SPARSE_WEIGHT) / (fusion.RRF_K + F.col("rank"))
            if d is None else F.when(F.col("source") == "dense", d).otherwise(s) * F.col("norm")).alias("part"))
        for i, (_, d, s) in enumerate(FUSION_CONFIGS)])
    fused = scaled.select("query_id", "doc_id", F.inline(shares)).groupBy(
        F.struct("query_id", F.col("c").alias("t")).alias("query_id"), "doc_id").agg(stable(F.sum("part")).alias("score"))
    numbers = F.explode(F.array(*[F.lit(i) for i in range(len(FUSION_CONFIGS))]))
    qrels = containment(spark, root).withColumn("t", numbers).select(F.struct("query_id", "t").alias("query_id"), "doc_id", "rel")
    scored = evaluation.per_query_metrics(best_hits(fused, 10), qrels, (10,))
    name = F.get(F.array(*[F.lit(n) for n, _, _ in FUSION_CONFIGS]), F.col("query_id.t"))
    return scored.groupBy(name.alias("configuration")).agg(*[F.round(F.avg(f"`{m}@10`"), 9).alias(m) for m in ("ndcg", "recall", "map")])


def _window_eval_sql(size, overlap, tag):
    docs = f"SELECT doc_id * 100000 + chunk_index AS doc_id, chunk AS text FROM ({windows_sql(size, overlap, size)})"
    return f"""{sql.bm25(docs=docs, tag=tag)},
par{tag} AS (SELECT query_id, doc_id // 100000 AS doc_id, max(score) AS score FROM scores{tag} GROUP BY ALL), run{tag} AS ({sql.ranked('par' + tag, 10)})"""


def _sweep_sql(configs):
    parts = ", ".join(_window_eval_sql(size, overlap, f"_{size}_{overlap}") for size, overlap in configs)
    runs = " UNION ALL ".join(f"SELECT query_id * 10 + {i} AS query_id, doc_id, rank FROM run_{s}_{o}" for i, (s, o) in enumerate(configs))
    counts = " UNION ALL ".join(f"SELECT {i} AS c, {s} AS size, {o} AS overlap, (SELECT count(*) FROM d_{s}_{o}) AS chunks" for i, (s, o) in enumerate(configs))
    return f"""WITH {parts}, runs AS ({runs}), {sql.QRELS.replace('qrels AS', 'qrels1 AS')},
qrels AS (SELECT query_id * 10 + t AS query_id, doc_id, rel FROM qrels1, range({len(configs)}) x(t)), {sql.metrics('runs', cutoffs=(10,))},
cc AS ({counts})
SELECT size, overlap, max(chunks) AS chunks, round(max(chunks) * 64 * 4 / 1048576.0::DOUBLE, 9) AS storage_mib, round(1 + overlap::DOUBLE / size, 9) AS redundancy,
  round(avg(ndcg), 9) AS ndcg, round(avg(recall), 9) AS recall, round(avg(map), 9) AS map FROM perq JOIN cc ON cc.c = query_id % 10 GROUP BY size, overlap"""


def window_sweep(spark, root, configs):
    """Cut, search and evaluate every (size, overlap); hits on chunks count for their document once."""
    hits, parts = search_parts(queries_of(spark, root), corpus(spark, root), configs, 10)
    runs = hits.select(F.struct("query_id", F.col("grid").alias("t")).alias("query_id"), "doc_id", "rank")
    counts = spark.createDataFrame([(number, *config, n) for number, (config, n) in enumerate(zip(configs, parts))], "c int, size int, overlap int, chunks long")
    numbers = F.explode(F.array(*[F.lit(i) for i in range(len(configs))]))
    qrels = containment(spark, root).withColumn("t", numbers).select(F.struct("query_id", "t").alias("query_id"), "doc_id", "rel")
    scored = evaluation.per_query_metrics(runs, qrels, (10,)).withColumn("c", F.col("query_id.t"))
    means = scored.groupBy("c").agg(*[F.round(F.avg(f"`{m}@10`"), 9).alias(m) for m in ("ndcg", "recall", "map")])
    return counts.join(means, "c").select(
        "size", "overlap", "chunks", stable(evaluation.storage_mib(F.col("chunks"), 64)).alias("storage_mib"),
        stable(1 + F.col("overlap") / F.col("size")).alias("redundancy"), "ndcg", "recall", "map")


SIZE_SWEEP = [(64, 6), (128, 12), (256, 25)]
OVERLAP_SWEEP = [(128, 0), (128, 25), (128, 51)]
CONTEXT_SWEEP = [(128, 0), (512, 0), (640, 128), (2048, 0)]


@query("chunk_size_sweep", "I10 E14", _sweep_sql(SIZE_SWEEP))
def chunk_size_sweep(spark, root):
    """Search quality and storage over chunk sizes."""
    return window_sweep(spark, root, SIZE_SWEEP)


@query("overlap_sweep", "I10 E14", _sweep_sql(OVERLAP_SWEEP))
def overlap_sweep(spark, root):
    """Search quality and redundancy over chunk overlaps."""
    return window_sweep(spark, root, OVERLAP_SWEEP)


@query("context_length_sweep", "I13", _sweep_sql(CONTEXT_SWEEP))
def context_length_sweep(spark, root):
    """Search quality over context lengths: snippet, chunk, chunk with surroundings, document."""
    return window_sweep(spark, root, CONTEXT_SWEEP)


@query("chunking_strategies", "I11", f"""WITH RECURSIVE sc AS (WITH RECURSIVE {sentence_packing_sql(256, 25)} SELECT * FROM packed),
pc AS (WITH RECURSIVE {paragraph_packing_sql(256, 25)} SELECT * FROM packed),
cuts AS (SELECT 'fixed' AS strategy, len(chunk) AS n FROM ({windows_sql(128, 0, 2)}) UNION ALL SELECT 'sliding', len(chunk) FROM ({windows_sql(128, 64, 2)})
  UNION ALL SELECT 'sentence', len(chunk) FROM sc UNION ALL SELECT 'paragraph', len(chunk) FROM pc)
SELECT strategy, count(*) AS chunks, round(avg(n), 9) AS avg_chars, min(n) AS min_chars, max(n) AS max_chars FROM cuts GROUP BY 1""")
def chunking_strategies(spark, root):
    """Chunks and their sizes for fixed, sliding, sentence and paragraph cutting."""
    docs = corpus(spark, root)
    broken = docs.select("doc_id", F.regexp_replace("text", r"([.!?])\n", "$1\n\n").alias("text"))
    cuts = {"fixed": chunking.word_windows(docs, 128, 0), "sliding": chunking.word_windows(docs, 128, 64),
            "sentence": chunking.sentence_chunks(docs, 256, 25), "paragraph": chunking.document_chunks(broken, 256, 25)}
    out = None
    for name, frame in cuts.items():
        part = frame.select(F.lit(name).alias("strategy"), F.length("chunk").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("strategy").agg(F.count("*").alias("chunks"), F.round(F.avg("n"), 9).alias("avg_chars"), F.min("n").alias("min_chars"), F.max("n").alias("max_chars"))


PARENTS = f"""reps AS (SELECT doc_id * 100000 + chunk_index AS doc_id, chunk AS text FROM ({windows_sql(64, 6, 64)})
  UNION ALL SELECT doc_id * 100000 + 99999, source || ' ' || lang || ' ' || array_to_string(list_filter({sql.WORDS}, lambda w: len(w) > 8), ' ') FROM documents)"""
_PARENT_BM25 = sql.bm25(docs="SELECT doc_id, text FROM reps")


@query("parent_child_search", "I16 E14", f"""WITH {PARENTS}, {_PARENT_BM25},
p AS (SELECT query_id, doc_id // 100000 AS doc_id, max(score) AS score, count(*) AS matched FROM scores GROUP BY ALL) {sql.ranked('p', 10, ', matched')}""")
def parent_child_search(spark, root):
    """Search over chunks and keyword summaries, documents returned."""
    from corpusflow.functions.text import tokens

    docs = spread(table(spark, root, "documents").select("doc_id", "text", "source", "lang"))
    summary = F.concat_ws(" ", "source", "lang", F.array_join(F.filter(tokens("text"), lambda w: F.length(w) > 8), " "))
    hits, _ = search_parts(queries_of(spark, root), docs, [(64, 6)], 10, beside=summary)
    return hits.select("query_id", "doc_id", "score", "matched", "rank")


@query("overall_scores", "I14 I15", """
SELECT p_partkey, round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, (0.5::DOUBLE * p_size / 50 + 0.3::DOUBLE * greatest(0, 1 - (p_retailprice / 20) / 100) + 0.2::DOUBLE * greatest(0, 1 - (p_size / 10.0::DOUBLE * 0.05::DOUBLE) / 0.1::DOUBLE)) * 100)), 6) AS overall,
  round(p_size / 10.0::DOUBLE * 0.05::DOUBLE, 9) AS query_cost, round(p_size / 10.0::DOUBLE * 200, 6) AS indexing_cost, round(10000 * (p_size * 8) * 4 / 1048576.0::DOUBLE, 9) AS storage_mib FROM part""")
def overall_scores(spark, root):
    """Quality, speed and cost of models; parts stand for models (size for quality and price, retail price for time)."""
    size = F.col("p_size")
    price = size / 10.0
    return table(spark, root, "part").select(
        "p_partkey", F.round(evaluation.overall_score(size / 50, F.col("p_retailprice") / 20, evaluation.query_cost(price)), 6).alias("overall"),
        stable(evaluation.query_cost(price)).alias("query_cost"), F.round(evaluation.indexing_cost(price), 6).alias("indexing_cost"),
        stable(evaluation.storage_mib(F.lit(10000), size * 8)).alias("storage_mib"))


@query("model_shortlist", "G6 G5", """
SELECT * FROM (SELECT p_partkey, p_brand, p_retailprice, 'cheapest' AS list FROM part ORDER BY p_retailprice, p_partkey LIMIT 5) UNION ALL
SELECT * FROM (SELECT p_partkey, p_brand, p_retailprice, 'dearest' FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5) UNION ALL
SELECT p_partkey, p_brand, p_retailprice, 'best of brand' FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS n FROM part) WHERE n = 1""")
def model_shortlist(spark, root):
    """Cheapest and dearest models and the largest of every brand."""
    parts = table(spark, root, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    low = parts.orderBy("p_retailprice", "p_partkey").limit(5).withColumn("list", F.lit("cheapest"))
    high = parts.orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(5).withColumn("list", F.lit("dearest"))
    best = top_k(parts, ["p_brand"], [F.col("p_size").desc(), F.col("p_partkey")], 1, "_n").drop("_n").withColumn("list", F.lit("best of brand"))
    return low.unionByName(high).unionByName(best).drop("p_size")
