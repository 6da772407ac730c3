"""Fusing result lists. Lists are united and grouped, so a fusion is one shuffle, not a chain of joins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusflow.operators.ranking import best_hits, min_max, stable

# Rank constant, list weights, share of the hypothetical answers, re-rank weights.
RRF_K = 60
DENSE_WEIGHT = 0.3
SPARSE_WEIGHT = 0.7
HYPOTHETICAL_WEIGHT = 0.2
RERANK_WEIGHTS = {"cross_encoder": 0.6, "overlap": 0.3, "original": 0.1}


def candidate_depth(k: int) -> int:
    """How many rows each list contributes before fusion."""
    return min(5 * k, 100)


def tagged(lists: Mapping[str, DataFrame], *columns: str) -> DataFrame:
    """All lists in one table with a source column."""
    out = None
    for name, frame in lists.items():
        part = frame.select("query_id", "doc_id", *columns).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def of_source(name: str, value: str) -> Column:
    return F.max(F.when(F.col("source") == name, F.col(value)))


def weighted(dense: DataFrame, sparse: DataFrame, k: int, dense_weight: float = DENSE_WEIGHT,
             sparse_weight: float = SPARSE_WEIGHT) -> DataFrame:
    """Min-max scaled lists, weighted sum, a missing score counts 0; scores of 0 are reported as null."""
    both = min_max(tagged({"dense": dense, "sparse": sparse}, "score"), ["query_id", "source"])
    pairs = both.groupBy("query_id", "doc_id").agg(
        F.coalesce(of_source("dense", "norm"), F.lit(0.0)).alias("d"),
        F.coalesce(of_source("sparse", "norm"), F.lit(0.0)).alias("s"))
    fused = pairs.select(
        "query_id", "doc_id", stable(dense_weight * F.col("d") + sparse_weight * F.col("s")).alias("score"),
        F.when(F.col("d") > 0, stable(F.col("d"))).alias("dense_score"),
        F.when(F.col("s") > 0, stable(F.col("s"))).alias("sparse_score"))
    return best_hits(fused, k)


def reciprocal_rank(lists: DataFrame, k: int, weight: Column | float = 1.0, constant: int = RRF_K) -> DataFrame:
    """Sum of weight / (constant + rank) over lists given as (query_id, doc_id, rank, ...)."""
    share = (F.lit(weight) if not isinstance(weight, Column) else weight) / (constant + F.col("rank"))
    return best_hits(lists.groupBy("query_id", "doc_id").agg(stable(F.sum(share)).alias("score")), k)


def weighted_reciprocal_rank(dense: DataFrame, sparse: DataFrame, k: int, dense_weight: float = DENSE_WEIGHT,
                             sparse_weight: float = SPARSE_WEIGHT) -> DataFrame:
    both = tagged({"dense": dense, "sparse": sparse}, "rank")
    return reciprocal_rank(both, k, F.when(F.col("source") == "dense", dense_weight).otherwise(sparse_weight))


def best_per_text(lists: DataFrame, k: int) -> DataFrame:
    """Union of sources, one row per query and text: the best score, smallest id among equals.

    ``lists`` is (query_id, doc_id, score, source, text_key).
    """
    winner = F.max_by(F.struct("doc_id", "score", "source"), F.struct("score", -F.col("doc_id"), "source")).alias("w")
    merged = lists.groupBy("query_id", "text_key").agg(winner)
    return best_hits(merged.select("query_id", "w.doc_id", "w.score", "w.source"), k)


def variation_fusion(runs: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """Confidence-weighted rank fusion over query variations.

    ``runs`` is (query_id, variation_id, confidence, doc_id, score, rank). Keeps
    the number of variations that found a document, its mean rank and both maps.
    """
    entry = F.struct(F.col("variation_id"), F.struct("rank", "score"))
    fused = runs.groupBy("query_id", "doc_id").agg(
        stable(F.sum(F.col("confidence") / (constant + F.col("rank")))).alias("score"),
        F.count_distinct("variation_id").alias("num_queries"),
        stable(F.avg("rank")).alias("avg_rank"),
        F.map_from_entries(F.collect_list(entry)).alias("positions"))
    return best_hits(fused, k)


STRATEGIES = ("weighted_average", "average_all", "average_hypothetical", "max", "rrf")


def fuse_scores(scores: DataFrame, strategy: str = "weighted_average", weight: float = HYPOTHETICAL_WEIGHT,
                normalize: bool = True, main: str = "query") -> DataFrame:
    """Fuse the query's own scores with those of its hypothetical answers.

    ``scores`` is (query_id, doc_id, source, score) with one row per source.
    """
    own = F.max(F.when(F.col("source") == main, F.col("score")))
    others = F.avg(F.when(F.col("source") != main, F.col("score")))
    if strategy == "rrf":
        order = W.partitionBy("query_id", "source").orderBy(F.col("score").desc(), "doc_id")
        ranked = scores.withColumn("_r", F.row_number().over(order))
        fused = ranked.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (RRF_K + F.col("_r"))).alias("score"))
    elif strategy in ("average_all", "max"):
        fold = F.avg if strategy == "average_all" else F.max
        fused = scores.groupBy("query_id", "doc_id").agg(fold("score").alias("score"))
    else:
        pair = scores.groupBy("query_id", "doc_id").agg(own.alias("_q"), others.alias("_h"))
        if strategy == "average_hypothetical":
            fused = pair.withColumn("score", F.col("_h"))
        elif strategy == "weighted_average":
            if normalize:
                pair = min_max(pair, ["query_id"], "_q", "_q", "half", 1e-8)
                pair = min_max(pair, ["query_id"], "_h", "_h", "half", 1e-8)
            fused = pair.withColumn("score", weight * F.col("_h") + (1 - weight) * F.col("_q"))
        else:
            raise ValueError(f"unknown strategy {strategy}")
    return fused.select("query_id", "doc_id", stable(F.col("score")).alias("score"))


def hybrid_rerank(hits: DataFrame, k: int, weights: Mapping[str, float] = RERANK_WEIGHTS) -> DataFrame:
    """Weighted sum of the scaled model score, the scaled overlap and the original score.

    ``hits`` is (query_id, doc_id, cross_encoder, overlap, original).
    """
    scaled = min_max(hits, ["query_id"], "cross_encoder", "_c", "one")
    scaled = min_max(scaled, ["query_id"], "overlap", "_o", "one")
    score = weights["cross_encoder"] * F.col("_c") + weights["overlap"] * F.col("_o") + weights["original"] * F.col("original")
    return best_hits(scaled.select("query_id", "doc_id", "original", stable(score).alias("score")), k)


def overlap_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per query: how many documents two rankings share."""
    both = left.select("query_id", "doc_id").intersect(right.select("query_id", "doc_id"))
    return both.groupBy("query_id").agg(F.count("*").alias("shared"))


def rerank_if_longer(hits: DataFrame, reranked: DataFrame, k: int) -> DataFrame:
    """Re-ranked top-k for queries with more than k candidates, the list as it is for the others."""
    sizes = hits.groupBy("query_id").agg((F.count("*") > k).alias("_long"))
    kept = hits.join(sizes, "query_id").filter(~F.col("_long")).select("query_id", "doc_id", "score", "rank", F.lit(False).alias("reranked"))
    new = reranked.join(sizes, "query_id").filter(F.col("_long") & (F.col("rank") <= k)).select(
        "query_id", "doc_id", "score", "rank", F.lit(True).alias("reranked"))
    return kept.unionByName(new)
