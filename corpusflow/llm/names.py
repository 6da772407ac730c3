"""Helper column names that no input column can clash with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it (Spark compares names without regard to case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of ``docs`` that can be hashed, to order rows that agree otherwise."""
    return F.xxhash64(*[docs[f"`{f.name}`"] for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])
