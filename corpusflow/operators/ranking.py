"""Top-k, ranks and per-group statistics over ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DIGITS = 9


def stable(score: Column) -> Column:
    """Scores are rounded before they are compared, so that equal scores tie in every plan."""
    return F.round(score, DIGITS)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark keeps at most k rows per key and task before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def best_hits(df: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id",
              score: str = "score") -> DataFrame:
    """Per-query top-k by descending score, document id breaking ties."""
    return top_k(df, [query], [F.col(score).desc(), F.col(doc).asc()], k)


def min_max(df: DataFrame, keys: Sequence[str], score: str = "score", out: str = "norm",
            constant: str = "keep", eps: float = 0.0) -> DataFrame:
    """Scale scores to 0..1 per group; ``constant`` rules lists without spread.

    keep: unchanged; one: all 1.0; half: all 0.5. Groups are ranked lists cut to
    their best k rows, so a window over one is small and the list is not computed twice.
    """
    flat = {"keep": F.col(score), "one": F.lit(1.0), "half": F.lit(0.5)}[constant]
    spread = F.col("_hi") - F.col("_lo")
    whole = W.partitionBy(*keys)
    stats = df.withColumns({"_lo": F.min(score).over(whole), "_hi": F.max(score).over(whole)})
    return stats.withColumn(
        out, F.when(spread <= eps, flat).otherwise((F.col(score) - F.col("_lo")) / spread)
    ).drop("_lo", "_hi")


def z_score(df: DataFrame, keys: Sequence[str], score: str = "score", out: str = "z") -> DataFrame:
    """Centre and divide by the population deviation; a flat list is only centred. Groups are cut lists."""
    whole = W.partitionBy(*keys)
    stats = df.withColumns({"_mean": F.avg(score).over(whole), "_std": F.stddev_pop(score).over(whole)})
    centred = F.col(score) - F.col("_mean")
    return stats.withColumn(
        out, F.when(F.col("_std") < 1e-8, centred).otherwise(centred / F.col("_std"))
    ).drop("_mean", "_std")


def running_total(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], value: str,
                  out: str) -> DataFrame:
    """Sum of all earlier rows of the group, exclusive, in two levels.

    Rows are summed inside a block (a coarse, order-preserving bucket of the
    order column); block totals are summed over blocks. No task sees more than
    one block of a group.
    """
    keys = list(keys)
    inner = W.partitionBy(*keys, block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    totals = (
        df.groupBy(*keys, block).agg(F.sum(value).alias("_rt_sum"))
        .withColumn("_rt_before", F.coalesce(F.sum("_rt_sum").over(across), F.lit(0)))
        .drop("_rt_sum")
    )
    return (
        df.withColumn("_rt_inside", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(totals, [*keys, block])
        .withColumn(out, F.col("_rt_inside") + F.col("_rt_before"))
        .drop("_rt_inside", "_rt_before")
    )
