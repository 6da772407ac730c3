"""Statistics of score lists whose scores are all equal."""

import math

from corpusflow.plans import analytics


def test_a_list_of_equal_scores_has_no_correlation_and_ends_no_job(spark, monkeypatch):
    rows = [(1, i, 2.5, "a b" if i % 2 else "a c") for i in range(6)] + [(2, i, float(i), "a b" if i % 2 else "a c") for i in range(6)] + [(3, i, float(i), "b") for i in range(3)]
    rows += [(1, 9, 8.0, None), (2, 9, 99.0, None)]  # no overlap: left out of the correlation
    monkeypatch.setattr(analytics, "candidates", lambda *_: spark.createDataFrame(rows, "query_id long, doc_id long, score double, text string"))
    monkeypatch.setattr(analytics, "queries_of", lambda *_: spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a b")], "query_id long, text string"))
    got = {r.query_id: r for r in analytics.score_statistics(spark, "").collect()}
    assert math.isnan(got[1].correlation) and got[1].n == 7 and got[1].low == 2.5 and got[1].high == 8.0
    assert got[2].correlation == 0.29277 and got[2].high == 99.0
    assert got[3].correlation is None
