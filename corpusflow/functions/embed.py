"""Text to vector: a plug point for models and a model-free default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import tokens

DIM = 64


def buckets(text: Column | str, dim: int = DIM) -> Column:
    """Hash bucket of every word, by the first two hexadecimal digits of its md5."""
    return F.transform(tokens(text), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int"), F.lit(dim)))


def hashed(df: DataFrame, key: str, text: str = "text", dim: int = DIM) -> DataFrame:
    """(key, vec): word counts per bucket; texts without words have none.

    Hashing runs in the JVM, a batch is counted at once in Arrow memory.
    """
    schema = pa.schema([(key, pa.int64()), ("vec", pa.list_(pa.float64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            if not sizes.sum():
                continue
            found = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            counts = np.bincount(rows * dim + found, minlength=len(sizes) * dim).reshape(-1, dim).astype(np.float64)
            keep = sizes > 0
            counts = counts[keep]
            offsets = np.arange(len(counts) + 1, dtype=np.int32) * dim
            yield pa.RecordBatch.from_arrays([
                pa.array(batch.column(0).to_numpy(zero_copy_only=False)[keep], type=pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.ravel()))], schema=schema)

    return df.select(key, buckets(text, dim).alias("_b")).mapInArrow(count, f"{key} long, vec array<double>")


Encoder = Callable[[list[str]], np.ndarray]


def encoded(df: DataFrame, key: str, encoder: Callable[[], Encoder], text: str = "text") -> DataFrame:
    """(key, vec) by a model: ``encoder()`` is called once per task and then fed batches of texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for batch in batches:
            yield pd.Series(list(np.asarray(model(batch.tolist()), dtype=np.float32)))

    return df.select(key, run(text).alias("vec"))


PairScorer = Callable[[list[str], list[str]], np.ndarray]


def scored_pairs(pairs: DataFrame, scorer: Callable[[], PairScorer], query_text: str = "query_text", text: str = "text",
                 out: str = "logit") -> DataFrame:
    """Adds a model's score for (query, text) pairs; one model per task, Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = scorer()
        for left, right in batches:
            yield pd.Series(np.asarray(model(left.tolist(), right.tolist()), dtype=np.float64))

    return pairs.withColumn(out, run(query_text, text))
