"""Search for many queries by the grid of cells against the plain search of the same index."""

import numpy as np
import pyarrow as pa

from corpusflow.operators import maxscore, sparse, termindex
from corpusflow.operators.termindex import TermIndex


def lists(frame):
    return sorted((str(r.query_id), r["rank"], str(r.doc_id), round(r.score, 8)) for r in frame.collect())


def test_many_blocks_of_queries_make_no_copy_of_the_postings_each(spark, monkeypatch):
    """Each block had its own copy of the postings in the shuffle."""
    text = lambda i, n: " ".join(f"w{(i * j + j // 3 + (i * i) % 7) % 40}" for j in range(n))
    rows = [(None if i == 50 else i % 280, None if i % 37 == 0 else text(i, 3 + i % 29)) for i in range(300)]
    queries = spark.createDataFrame([(None if i == 5 else f"q{i % 45}", text(i + 3, 2 + i % 9)) for i in range(50)] + [("none", "nothing")], "query_id string, text string")
    monkeypatch.setattr(termindex, "RANGE_DOCS", 23)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    index = TermIndex(spark, buckets=3).add(docs.filter("doc_id < 200 OR doc_id IS NULL")).add(docs.filter("doc_id >= 200"))
    index.remove(spark.createDataFrame([(3,), (201,)], "doc_id long"))
    subset = docs.select("doc_id").filter("doc_id % 3 = 0")
    want, part = lists(index.search(queries, 4)), lists(index.search(queries, 4, subset))
    monkeypatch.setattr(termindex, "QUERY_BLOCK", 4)
    monkeypatch.setattr(TermIndex, "_hits", lambda *_: 1 / 0)
    for weights, at_once in ((10_000, 1024), (60, 3)):
        monkeypatch.setattr(termindex, "CELL_WEIGHTS", weights)
        monkeypatch.setattr(maxscore, "QUERIES_AT_ONCE", at_once)
        assert lists(index.search(queries, 4)) == want
    assert lists(index.search(queries, 4, subset)) == part
    index.drop()


def test_a_cell_scores_exactly_and_breaks_ties_by_id(monkeypatch):
    monkeypatch.setattr(maxscore, "WAITING", 5)
    rng, k, average = np.random.default_rng(1), 3, 6.0
    counts = rng.integers(0, 3, (60, 12)) * (rng.random((60, 12)) < 0.4)
    counts[30:45] = counts[0]  # equal documents
    ids, lens = rng.permutation(60), counts.sum(1)
    weight = rng.random((9, 12)) * (rng.random((9, 12)) < 0.5)
    cell = maxscore.Cell(k, average)
    for low in (0, 5):
        cell.queries(pa.array([{"query_id": q, "words": [{"term": f"t{w}", "weight": weight[q, w]} for w in np.flatnonzero(weight[q])]} for q in range(low, min(9, low + 5))]))
    for low in range(0, 60, 20):
        own = counts[low: low + 20]
        has = [w for w in range(12) if own[:, w].any()]
        places = [np.flatnonzero(own[:, w]) for w in has]
        cell.range(pa.array(ids[low: low + 20]), lens[low: low + 20], None, None, pa.array([f"t{w}" for w in has]), pa.array(places, pa.list_(pa.int32())),
                   pa.array([own[p, w] for p, w in zip(places, has)], pa.list_(pa.int32())))
    got = sorted((q, -s, d) for b in cell.hits() for q, d, s in zip(*(c.to_pylist() for c in b.columns)))
    scores = np.round(np.where(counts > 0, sparse.saturated_tf(counts, lens[:, None], average), 0) @ weight.T, 9)
    want = sorted(x for q in range(9) for x in sorted((q, -scores[d, q], ids[d]) for d in range(60) if scores[d, q] > 0)[:k])
    assert [(q, d) for q, _, d in got] == [(q, d) for q, _, d in want] and np.allclose([s for _, s, _ in got], [s for _, s, _ in want])
