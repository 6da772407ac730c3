"""Session construction and the few settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: str | int = "*", app: str = "corpusflow", shuffle_partitions: int = 8,
                  **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int, scan_rows: int | None = None) -> Iterator[None]:
    """Jobs that run inside hand at most ``rows`` rows and about ``size`` bytes at once to Python.

    By default a batch has up to 10 000 rows and 64 MB, in the executor's memory and again in the worker's. ``scan_rows``
    are held at once by a Parquet reader (4096 by default, which is a whole file where rows are large arrays).
    """
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    if scan_rows:
        wanted["spark.sql.parquet.columnarReaderBatchSize"] = scan_rows
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, str(value))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, for written tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests on one machine) a fresh folder is made and remembered in the session.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str, **options):
    """Write a result that several branches read, and return the written table. ``options`` go to the writer.

    Used where recomputing would repeat a scan of the whole corpus. The table
    lives in the shared folder, so a lost executor does not lose it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.parquet(path)
