"""Resumable batch work: finished keys are read back and only the rest is done.

Inputs are finished files, so there is no unbounded stream; progress is kept as
an append-only table of completed keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items whose key has no saved result."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def expected_files(manifest: DataFrame, inventory: DataFrame, key: str = "directory") -> DataFrame:
    """Manifest rows with what is on storage: ``present``, ``empty`` or ``absent``."""
    state = (F.when(F.coalesce(F.col("files"), F.lit(0)) == 0, "absent")
             .when(F.col("non_empty_files") == 0, "empty").otherwise("present"))
    return manifest.join(inventory, key, "left").withColumn("state", state)


def resume(work: DataFrame, path: str, keys: Sequence[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``run`` on the pending part of ``work`` and append its rows to ``path``.

    A killed job loses only uncommitted output; the next call picks up the rest.
    """
    spark = work.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        done = None
    todo = work if done is None else pending(work, done, keys)
    run(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)
