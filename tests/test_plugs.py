"""Plug points, file drops and plan shape."""

import numpy as np
from pyspark.sql import functions as F

from corpusflow.functions import embed
from corpusflow.plans.registry import load_all
from corpusflow.session import fresh_path
from corpusflow.sources.files import dropped_files, parsed_logs
from corpusflow.sources.tables import table


def test_text_encoder(spark):
    def encoder():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

    frame = spark.createDataFrame([(1, "banana"), (2, "xyz")], "doc_id long, text string")
    assert {r.doc_id: list(r.vec) for r in embed.encoded(frame, "doc_id", encoder).collect()} == {1: [6.0, 3.0], 2: [3.0, 0.0]}


def test_pair_scorer(spark):
    def scorer():
        return lambda left, right: np.array([len(set(a) & set(b)) for a, b in zip(left, right)], dtype=float)

    frame = spark.createDataFrame([("abc", "bcd"), ("x", "y")], "query_text string, text string")
    assert sorted(r.logit for r in embed.scored_pairs(frame, scorer).collect()) == [0.0, 2.0]


def test_dropped_files(spark):
    import os

    folder = fresh_path(spark, "drop")
    os.makedirs(folder)
    for name, raw in {"a.txt": "café".encode(), "b.md": "café".encode("latin-1"), "c.pdf": b"%PDF"}.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(raw)
    got = {os.path.basename(r.path): (r.kind, r.text) for r in dropped_files(spark, folder).collect()}
    assert got == {"a.txt": ("txt", "café"), "b.md": ("md", "café"), "c.pdf": ("pdf", None)}


def test_log_time_formats(spark):
    lines = ['{"level": "WARN", "timestamp": "2024-01-02T03:04:05.000Z"}', '{"level": "info", "timestamp": "2024-01-02 03:04:05"}', '{"level": "x", "timestamp": "never"}']
    rows = parsed_logs(spark.createDataFrame([(line,) for line in lines], "value string")).collect()
    assert [r.level for r in rows] == ["warn", "info", "x"] and rows[0].ts == rows[1].ts and rows[2].ts is None


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_two_columns_and_pushes_filter(spark, root):
    plan = _plan(table(spark, root, "documents").filter("lang = 'en'").select("doc_id"))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan and "EqualTo(lang,en)" in plan


def test_no_pairwise_joins(spark, root):
    """Search plans hold no cartesian product and no nested-loop join."""
    catalog = load_all()
    for name in ("bm25_topk", "dense_topk", "weighted_fusion", "benchmark_containment", "maxsim_topk", "cache_lookup", "chunk_pages",
                 "query_intents", "rule_routing", "request_completions"):
        plan = _plan(catalog[name].job(spark, root))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
