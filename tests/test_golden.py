"""Small cases with known results."""

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import evaluation, formulas, fusion, querytext, sparse
from corpusflow.functions import guards


def _analyzed(spark, text):
    return formulas.analyze(spark.createDataFrame([(1, text)], "query_id long, text string"))


def test_formula_found(spark):
    row = _analyzed(spark, "Solve $x^2 + 5x + 6 = 0$").first()
    assert row.has_latex and row.formulas == ["x^2 + 5x + 6 = 0"] and "x" in row.vars and row.query_type == "solve_equation"


def test_no_formula(spark):
    row = _analyzed(spark, "What is machine learning?").first()
    assert not row.has_latex and row.query_type == "general"


def test_two_formulas_in_order(spark):
    assert _analyzed(spark, "Compare $f(x) = x^2$ and $g(x) = 2x + 1$").first().formulas == ["f(x) = x^2", "g(x) = 2x + 1"]


def test_routes(spark):
    texts = ["Solve $x^2 = 4$", "Compare python versus java", "implement a sorting algorithm", "What is the capital"]
    frame = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    got = {r.query_id: r.rule_route for r in querytext.route_by_rules(querytext.features(frame)).collect()}
    assert [got[i] for i in range(3)] == ["math_formula", "comparative", "code_search"]
    assert got[3] == "standard_rag"  # one keyword alone does not reach the limit


def test_intents(spark):
    frame = spark.createDataFrame([(1, "how to buy and download"), (2, "zzz")], "query_id long, text string")
    rows = {r.query_id: r for r in querytext.intents(frame).collect()}
    assert rows[1].intent == "transactional" and rows[2].method == "default" and rows[2].confidence == 0.5


def test_keyword_match(spark):
    docs = spark.createDataFrame([(1, "machine learning is fun"), (2, "cooking recipes"), (3, "deep machine learning")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "machine learning")], "query_id long, text string")
    hits = sparse.bm25_topk(asked, docs, 100).collect()
    assert {h.doc_id for h in hits} == {1, 3}


def test_bm25_blocks_give_the_scores_of_the_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 23}" for j in range(i % 9))) for i in range(60)] + [(60, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(f"q{i}", f"w{i % 23} w{i % 7} w{i % 7} none") for i in range(50)], "query_id string, text string")
    for name, value in (("QUERY_BLOCK", 8), ("WORD_BLOCK", 40), ("BLOCK_CELLS", 60), ("WEIGHT_BYTES", 10 ** 9)):
        monkeypatch.setattr(sparse, name, value)  # many blocks and tiles, joined by key
    rows = lambda hits: sorted((h.query_id, h.rank, h.doc_id, round(h.score, 6)) for h in hits.collect())
    got = sparse.bm25_topk(asked, docs.filter("text IS NOT NULL"), 5)
    assert rows(got) == rows(sparse.best_hits(sparse.bm25_scores(asked, docs.filter("text IS NOT NULL")), 5))
    assert sparse.bm25_topk(asked, docs, 5).count() > 0 and sparse.bm25_topk(asked, docs.limit(0), 5).collect() == []


@pytest.mark.parametrize("kind", ["struct<a: bigint, b: string>", "string", "bigint"])
def test_bm25_takes_query_ids_of_any_type(spark, kind):
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5}") for i in range(20)], "doc_id long, text string")
    made = "named_struct('a', id, 'b', nullif(concat('x', id), 'x1'))" if kind.startswith("struct") else f"cast(nullif(id, 1) AS {kind})"
    asked = spark.range(3).selectExpr("id", f"{made} AS query_id", "concat('w', id) AS text")
    plain = sparse.bm25_topk(asked.select(F.col("id").alias("query_id"), "text"), docs, 4).collect()
    got = sparse.bm25_topk(asked.select("query_id", "text"), docs, 4)
    assert got.schema["query_id"].dataType.simpleString() == kind.replace(": ", ":").replace(", ", ",")
    name = {r.id: r.query_id for r in asked.collect()}
    assert {(name[r.query_id], r["rank"], r.doc_id, r.score) for r in plain} == {(r.query_id, r["rank"], r.doc_id, r.score) for r in got.collect()}


def test_ordered_dedup_and_limit(spark):
    frame = spark.createDataFrame([("machine learning machine ai learning",)], "text string")
    assert frame.select(querytext.keywords(F.col("text"))).first()[0] == ["machine", "learning"]


def test_graded_ndcg(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 10, 1), (1, 12, 3), (1, 99, 2)], "query_id long, doc_id long, rel int")
    row = evaluation.per_query_metrics(run, qrels, (3,)).first()
    dcg = 1.0 + 7.0 / 2.0
    ideal = 7.0 + 3.0 / 1.584962500721156 + 1.0 / 2.0
    assert abs(row["ndcg@3"] - dcg / ideal) < 1e-12
    assert abs(row["map@3"] - (1.0 + 2.0 / 3.0) / 3) < 1e-12 and row["recall@3"] == 2 / 3 and row["precision@3"] == 2 / 3


def test_flat_lists(spark):
    from corpusflow.operators.ranking import min_max

    frame = spark.createDataFrame([(1, 5.0), (1, 5.0)], "query_id long, score double")
    got = [min_max(frame, ["query_id"], constant=c).first()["norm"] for c in ("keep", "one", "half")]
    assert got == [5.0, 1.0, 0.5]


def test_guards(spark):
    cases = {"hello world": None, "drop everything": "sql", "x" * 2001: "length", "onclick = 1": "xss", "a & b": "command"}
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.p for r in frame.select("t", guards.query_problem(F.col("t")).alias("p")).collect()} == cases


def test_rank_fusion_depth():
    assert [fusion.candidate_depth(k) for k in (5, 20, 50)] == [25, 100, 100]
