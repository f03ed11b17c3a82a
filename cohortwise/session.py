"""Spark session and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCRATCH_KEY = "spark.checkpoint.dir"
_CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_folders: dict[str, str] = {}


def build_session(app: str = "cohortwise", master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """Session used by tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder, since there every task sees it.
    """
    path = spark.conf.get(_SCRATCH_KEY, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SCRATCH_KEY} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_folders[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, grouped by application for easy clean-up."""
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's ``key`` is ``value`` inside the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cleaned(spark: SparkSession):
    """Shuffle files of queries that are made and run in the block go when they end, not when the driver next collects garbage."""
    return setting(spark, _CLEAN_KEY, "true")


def materialize(df: DataFrame, label: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Cuts the lineage of iterative jobs and lets several branches share one
    evaluation; the table survives lost executors. The shuffle files of the write
    go when it ends, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with cleaned(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
