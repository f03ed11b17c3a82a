"""Upserts and set algebra on keyed tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.selection import best_row


def upsert(existing: DataFrame, additions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyed merge in which the added row replaces the existing one."""
    both = (existing.withColumn("__prio", F.lit(1))
            .unionByName(additions.withColumn("__prio", F.lit(0)), allowMissingColumns=True))
    return best_row(both, keys, [F.col("__prio")]).drop("__prio")


def passing_everywhere(df: DataFrame, group: str, feature: str, passed: str, groups: DataFrame) -> DataFrame:
    """Features whose flag holds in every group of ``groups``."""
    total = groups.select(group).distinct().count()
    return (df.where(F.col(passed)).groupBy(feature).agg(F.count_distinct(group).alias("__k"))
            .where(F.col("__k") == total).select(feature))


def missing_required(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return required.select(*keys).distinct().join(present.select(*keys).distinct(), list(keys), "left_anti")


def universe(*columns: tuple[DataFrame, str]) -> DataFrame:
    """Distinct upper-cased names over several resources."""
    parts = [d.select(F.upper(F.trim(F.col(c))).alias("feature")) for d, c in columns]
    return reduce(DataFrame.unionByName, parts).where("feature <> ''").distinct()
