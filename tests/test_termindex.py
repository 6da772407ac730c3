"""The stored inverted index against the search that reads the texts, after adds, removals and with skipping."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import sparse, termindex
from corpusflow.operators.termindex import TermIndex


def made(n, seed=3):
    rng = random.Random(seed)
    return [(i, None if i % 17 == 5 else " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randint(0, 12)))) for i in range(n)]


def hits(found):
    return sorted((str(r.query_id), r["rank"], r.doc_id, round(r.score, 6)) for r in found.collect())


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(f"q{i}", f"w{i % 23} w{i % 7} w{i % 7} none") for i in range(25)] + [(None, "w3 w4")], "query_id string, text string")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("RANGE_DOCS", 7), ("PROBE", 4), ("QUERY_BLOCK", 8)):
        monkeypatch.setattr(termindex, name, value)


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_search_equals_the_one_over_texts(spark, asked, small, monkeypatch, limit):
    """Many ranges: some are probed first, the others skip queries; query blocks are broadcast or copied."""
    monkeypatch.setattr(termindex, "BROADCAST_BYTES", limit)
    docs = frame(spark, made(140))
    index = TermIndex(spark, buckets=3).add(docs)
    try:
        assert index._live("ranges").count() >= 2 * termindex.PROBE
        assert hits(index.search(asked, 4)) == hits(sparse.bm25_topk(asked, docs, 4))
        even = docs.filter("doc_id % 2 = 0").select("doc_id")
        assert hits(index.search(asked, 4, subset=even)) == hits(sparse.bm25_topk(asked, docs, 4, subset=even))
        assert index.search(asked.limit(0), 4).collect() == []
    finally:
        index.drop()


def test_adds_and_removals_equal_an_index_of_what_is_left(spark, asked, small):
    rows = made(60)
    index = TermIndex(spark, buckets=3).add(frame(spark, rows[:40]))
    try:
        index.add(frame(spark, rows[40:]))
        index.remove(frame(spark, [(i, None) for i in range(0, 60, 3)] + [(999, None)]))
        index.remove(frame(spark, [(0, None), (1, None)]))
        index.add(frame(spark, [(3, "w1 w2 w3 again"), (4, "w5 replaced")]))  # one that is gone, one that is there
        left = {i: t for i, t in rows if i % 3 and i != 1} | {3: "w1 w2 w3 again", 4: "w5 replaced"}
        docs = frame(spark, list(left.items()))
        assert hits(index.search(asked, 5)) == hits(sparse.bm25_topk(asked, docs, 5))
        lengths = {r.doc_id: r.doc_len for r in index.doc_lengths().collect()}
        assert lengths == {i: len((t or "").split()) for i, t in left.items()}
        row = index.stats().first()
        assert row.n_docs == len(left) and abs(row.avg_len - sum(lengths.values()) / len(left)) < 1e-12
        terms = {r.term: (r.df, r.occurrences) for r in index.occurrences().collect()}
        posts = {r.term: (r.df, r.occurrences) for r in sparse.postings(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences")).collect()}
        assert terms == posts and {r.term: r.df for r in index.frequencies().collect()} == {t: df for t, (df, _) in posts.items()}
    finally:
        index.drop()
    assert not index.exists()


def test_an_unfinished_segment_is_not_seen(spark, asked, small, monkeypatch):
    docs = frame(spark, made(30))
    index = TermIndex(spark, buckets=3).add(docs)
    try:
        want, plain = hits(index.search(asked, 5)), TermIndex._append

        def fails(self, rows, part):
            if part == "segments":
                raise RuntimeError("lost")
            plain(self, rows, part)

        monkeypatch.setattr(TermIndex, "_append", fails)
        with pytest.raises(RuntimeError):
            index.add(frame(spark, [(500, "w1 w2 w3 w4 w5")]))
        monkeypatch.setattr(TermIndex, "_append", plain)
        assert hits(index.search(asked, 5)) == want
    finally:
        index.drop()


def test_bounds_skip_queries_and_blocks():
    asking, words, weight = np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([2.0, 1.0, 1.0])
    most, least = np.array([3, 1]), np.array([4, 4])
    top = 2.0 * sparse.saturated_tf(3, 4, 5.0) + sparse.saturated_tf(1, 4, 5.0)
    can = lambda floor: termindex.reaching(asking, words, weight, np.array(floor), most, least, 5.0).tolist()
    assert can([top, 0.0]) == [True, True] and can([top * 1.01, 5.0]) == [False, False]


def test_a_search_reads_postings_and_no_text(spark, asked):
    index = TermIndex(spark, buckets=3).add(frame(spark, made(20)))
    try:
        plan = index.search(asked, 3)._jdf.queryExecution().optimizedPlan().toString()
        assert "postings" in plan and "regexp_extract_all" not in plan
        assert [c.name for c in spark.catalog.listColumns(f"{index.name}_postings") if c.isBucket] == ["term"]
    finally:
        index.drop()


def test_no_packed_row_holds_more_than_a_word_of_a_range(spark):
    """Parquet readers and Arrow take rows by the thousand; a whole range in each of them is more than an executor has."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 400}" for j in range(100))) for i in range(60)], "doc_id long, text string").coalesce(1)
    rows = termindex._packed(docs, 1).collect()
    ranges = [r for r in rows if r["term"] is None]
    assert sorted(i for r in ranges for i in r["ids"]) == list(range(60)) and all(r["docs"] is None for r in ranges)
    words = [r for r in rows if r["term"] is not None]
    assert len({(r["range"], r["term"]) for r in words}) == len(words) == 400 and all(r["ids"] is None for r in words)
    assert sum(sum(r["tfs"]) for r in words) == 6000
    assert all(len(r["docs"]) == len(r["tfs"]) <= 60 and r["most"] == max(r["tfs"]) and r["least"] == 100 for r in words)


def test_the_build_hands_small_batches_to_python_and_cuts_large_ranges(spark, monkeypatch):
    """Batches of 10 000 word lists took the executor's memory; small ranges took a row for each few places of a word."""
    key, seen, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", [], termindex.materialize
    monkeypatch.setattr(termindex, "materialize", lambda rows, name: (seen.append(int(spark.conf.get(key))), plain(rows, name))[1])
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 900}" for j in range(500))) for i in range(600)], "doc_id long, text string").coalesce(1)
    before = spark.conf.get(key)
    index = TermIndex(spark, buckets=2).add(docs)
    try:
        assert seen[0] <= 2048 and spark.conf.get(key) == before
        assert index._table("ranges").count() == 1 and index._table("postings").count() == 900
    finally:
        index.drop()


def test_buckets_grow_in_number_with_the_texts(spark, monkeypatch):
    """A bucket, which one task sorts, grew with the corpus; later segments keep the number of the first."""
    monkeypatch.setattr(termindex, "BUCKET_BYTES", 200)
    index = TermIndex(spark).add(frame(spark, made(40)))
    told = lambda: int(spark.sql(f"DESCRIBE EXTENDED {index.name}_postings").filter("col_name = 'Num Buckets'").first().data_type)
    first = told()
    assert first > int(spark.conf.get("spark.sql.shuffle.partitions"))
    more = frame(spark, [(1000 + i, text) for i, text in made(5)])
    assert TermIndex(spark, index.name).add(more).doc_lengths().count() == 45 and told() == first
    index.drop()
