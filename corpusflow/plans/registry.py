"""Catalog of runnable queries: the Spark job, its oracle SQL and the survey ids it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    job: Job
    sql: str | None
    about: str
    home: str


CATALOG: dict[str, Entry] = {}


def _plain_types(df: DataFrame) -> DataFrame:
    """Widen to the types SQL engines report, so results compare across engines."""
    wide = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("long").alias(field.name)
        elif isinstance(field.dataType, T.FloatType):
            column = column.cast("double").alias(field.name)
        wide.append(column)
    return df.select(*wide)


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(spark, root)`` under a name with its oracle SQL."""

    def register(fn: Job) -> Job:
        if name in CATALOG:
            raise ValueError(f"query {name} is already registered")

        def job(spark: SparkSession, root: str) -> DataFrame:
            return _plain_types(fn(spark, root))

        about = (fn.__doc__ or "").strip().split("\n")[0]
        CATALOG[name] = Entry(name, tuple(ids.split()), job, sql, about, fn.__module__.rsplit(".", 1)[-1])
        return fn

    return register


def load_all() -> dict[str, Entry]:
    """Import every plan module once and return the catalog."""
    from importlib import import_module

    for module in ("retrieval", "corpus", "guards", "querytext", "formulas", "fusion", "evaluation",
                   "multivector", "analytics", "timeseries", "storage", "streams"):
        import_module(f"corpusflow.plans.{module}")
    return CATALOG
