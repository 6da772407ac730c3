"""Payload maps: filters, split, previews and model limits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Payload keys that hold the text, and the aliases tried for the other fields.
TEXT_KEYS = ["text", "content", "page_content"]
ALIASES = {
    "link": ["url", "source_url", "link", "uri", "document_url"],
    "document_id": ["document_id", "id", "_id"],
    "document_type": ["document_type", "type", "source_type"],
    "author": ["author", "authors"],
    "publication_date": ["publication_date", "date", "published"],
}

# Context limits by model prefix, first match wins, and the limit of other models.
MODEL_LIMITS = [("gpt-4", 8192), ("gpt-4-32k", 32768), ("gpt-3.5-turbo", 4096), ("gpt-3.5-turbo-16k", 16384)]
OTHER_LIMIT = 4096


def matches(conditions: Mapping[str, object], payload: str | None = None) -> Column:
    """Conjunction of equalities on columns (or keys of a payload map); a list means any of."""
    test = F.lit(True)
    for key, value in conditions.items():
        column = F.col(key) if payload is None else F.col(payload)[key]
        test = test & (column.isin(list(value)) if isinstance(value, (list, tuple, set)) else column == F.lit(value))
    return test


def split_payload(payload: Column) -> tuple[Column, Column]:
    """(text, metadata map without the text keys)."""
    text = F.coalesce(*[F.nullif(payload[k], F.lit("")) for k in TEXT_KEYS], F.lit(""))
    return text, F.map_filter(payload, lambda k, v: ~k.isin(TEXT_KEYS))


def alias_of(payload: str, field: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(payload)[k], F.lit("")) for k in ALIASES[field]])


def preview(rows: DataFrame, answer: list[str], order: str, text: str, width: int, payload: str = "metadata") -> DataFrame:
    """Sources of an answer: title ("Source n" where missing), cut text, link and other fields."""
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy(*answer).orderBy(order)))
    title = F.coalesce(F.nullif(F.col(payload)["title"], F.lit("")), F.concat(F.lit("Source "), F.col("_n").cast("string")))
    cut = F.concat(F.substring(text, 1, width), F.when(F.length(text) > width, "...").otherwise(""))
    out = numbered.withColumn("title", title).withColumn("preview", cut)
    for field in ALIASES:
        out = out.withColumn(field if field != "document_id" else "source_id", alias_of(payload, field))
    return out.drop("_n")


def model_limit(model: Column) -> Column:
    limit = F.lit(OTHER_LIMIT)
    for prefix, size in reversed(MODEL_LIMITS):
        limit = F.when(model.startswith(prefix), size).otherwise(limit)
    return limit
