"""Connected components of links, by alternating star contraction over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id that ``links`` (a, b) mention; component is the smallest id reachable.

    Each round hangs every node's larger neighbours on its smallest one, then every node's smaller neighbours on
    the smallest one. Minima are combining aggregates joined back, so a node with millions of links is never one
    group in a task. Rounds end when the links no longer change; each is written to the shared folder. Loops,
    repeated links and an empty table are fine; links with a null end are left out.
    """
    edges = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(below, "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
                 .unionByName(below.select("a", F.col("m").alias("b"))).distinct())
        edges = materialize(small, "links")
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
