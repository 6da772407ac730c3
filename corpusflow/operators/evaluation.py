"""Retrieval metrics as aggregations over a ranked list joined to judgments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed value: the cut-offs at which metrics are reported.
CUTOFFS = (1, 3, 5, 10, 20, 100)


def _gain(rel):
    return F.pow(F.lit(2.0), rel) - 1.0


def _discount(position):
    return F.log2(position + 1.0)


def judged_hits(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Every ranked row with its grade (0 where not judged) and the running hit number."""
    return with_running_hits(run.join(qrels, ["query_id", "doc_id"], "left").withColumn(
        "rel", F.coalesce("rel", F.lit(0))
    ))


def with_running_hits(joined: DataFrame) -> DataFrame:
    """Adds hit and hits_so_far to (query_id, doc_id, rank, rel); a list holds at most k rows."""
    by_rank = W.partitionBy("query_id").orderBy("rank")
    return joined.withColumn("hit", (F.col("rel") > 0).cast("int")).withColumn(
        "hits_so_far", F.sum("hit").over(by_rank.rowsBetween(W.unboundedPreceding, 0))
    )


def ideal_gains(qrels: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """Per query: number of judged documents and the best reachable DCG at each cut-off.

    Only grade counts per query reach the window, so a query with very many
    judgments is still a handful of rows.
    """
    grades = qrels.filter("rel > 0").groupBy("query_id", "rel").agg(F.count("*").alias("n"))
    return ideal_of_grades(grades, cutoffs)


def ideal_of_grades(grades: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """The same from grade counts (query_id, rel, n)."""
    deeper = W.partitionBy("query_id").orderBy(F.col("rel").desc())
    spans = grades.withColumn(
        "before", F.coalesce(F.sum("n").over(deeper.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    best = []
    for k in cutoffs:
        # Positions this grade fills inside the first k.
        last = F.least(F.col("before") + F.col("n"), F.lit(k))
        dcg = F.when(
            last > F.col("before"),
            _gain(F.col("rel")) * F.aggregate(
                F.sequence(F.col("before") + 1, F.greatest(last, F.col("before") + 1)), F.lit(0.0),
                lambda total, i: total + F.lit(1.0) / _discount(i),
            ),
        ).otherwise(0.0)
        best.append(F.sum(dcg).alias(f"idcg_{k}"))
    return spans.groupBy("query_id").agg(F.sum("n").alias("n_judged"), *best)


def per_query_metrics(run: DataFrame, qrels: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """ndcg/map/recall/precision at each cut-off and mrr, one row per judged query.

    ``run`` is (query_id, doc_id, rank). Queries without ranked documents score 0.
    """
    return metrics_of(judged_hits(run.select("query_id", "doc_id", "rank"), qrels), ideal_gains(qrels, cutoffs), cutoffs)


def metrics_of(hits: DataFrame, ideal: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """Metrics from judged rows and the ideal gains of every judged query."""
    aggs = [F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit")]
    for k in cutoffs:
        inside = F.col("rank") <= k
        hit = inside & (F.col("hit") == 1)
        aggs += [
            F.sum(F.when(hit, _gain(F.col("rel")) / _discount(F.col("rank")))).alias(f"dcg_{k}"),
            F.sum(F.when(hit, F.col("hits_so_far") / F.col("rank"))).alias(f"ap_{k}"),
            F.sum(F.when(hit, 1)).alias(f"hits_{k}"),
            F.sum(F.when(inside, 1)).alias(f"seen_{k}"),
        ]
    found = hits.groupBy("query_id").agg(*aggs)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    joined = ideal.join(found, "query_id", "left")
    out = ["query_id", zero(1.0 / F.col("first_hit")).alias("mrr")]
    for k in cutoffs:
        out += [
            zero(F.col(f"dcg_{k}") / F.col(f"idcg_{k}")).alias(f"ndcg@{k}"),
            zero(F.col(f"ap_{k}") / F.col("n_judged")).alias(f"map@{k}"),
            zero(F.col(f"hits_{k}") / F.col("n_judged")).alias(f"recall@{k}"),
            zero(F.col(f"hits_{k}") / F.col(f"seen_{k}")).alias(f"precision@{k}"),
        ]
    return joined.select(*out)


def mean_metrics(per_query: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per metric (and group) with its mean over judged queries."""
    names = [c for c in per_query.columns if c == "mrr" or "@" in c]
    means = per_query.groupBy(*by).agg(*[F.avg(f"`{c}`").alias(c) for c in names])
    return means.unpivot(list(by), [F.col(f"`{c}`") for c in names], "metric", "value")


def evaluate(run: DataFrame, qrels: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    return mean_metrics(per_query_metrics(run, qrels, cutoffs))


def label_metrics(run: DataFrame, labels: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """Metrics where a document is relevant if it shares the query's label.

    ``labels`` is (id, label), ids of queries and documents alike. Relevant pairs
    are never listed: a hit is an equality of two labels, and the number of
    judged documents is the label's size without the query itself.
    """
    left = labels.select(F.col("id").alias("query_id"), F.col("label").alias("_ql"))
    right = labels.select(F.col("id").alias("doc_id"), F.col("label").alias("_dl"))
    graded = run.select("query_id", "doc_id", "rank").join(left, "query_id").join(right, "doc_id").select(
        "query_id", "doc_id", "rank", (F.col("_ql") == F.col("_dl")).cast("int").alias("rel"))
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("n"))
    grades = labels.join(sizes, "label").filter("n > 0").select(F.col("id").alias("query_id"), F.lit(1).alias("rel"), "n")
    return metrics_of(with_running_hits(graded), ideal_of_grades(grades, cutoffs), cutoffs)


def best_per_parent(hits: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Chunk hits to document hits: the best chunk score counts once per document."""
    return hits.groupBy("query_id", F.col(parent).alias("doc_id")).agg(F.max("score").alias("score"))


def overall_score(quality, milliseconds, cost):
    """0 to 100: half quality, 30 percent speed, 20 percent cost."""
    speed = F.greatest(F.lit(0.0), 1 - milliseconds / 100)
    cheap = F.greatest(F.lit(0.0), 1 - cost / 0.1)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (quality * 0.5 + speed * 0.3 + cheap * 0.2) * 100))


def query_cost(price, tokens: int = 50):
    """Price of 1000 queries."""
    return price * (1000 * tokens / 1_000_000)


def indexing_cost(price, tokens: int = 200):
    """Price of indexing a million documents."""
    return price * float(tokens)


def storage_mib(vectors, dim, bytes_per_value=4):
    return vectors * dim * bytes_per_value / F.lit(1048576.0)
