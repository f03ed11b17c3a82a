"""Typed tables and skip rules with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.numeric import finite

# Smallest group and class sizes for an association test.
MIN_ROWS = 10
MIN_PER_CLASS = 3


def typed_table(df: DataFrame, booleans: Sequence[str], integers: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Explicit types before writing: missing booleans are false, integers 0, text empty."""
    cols = []
    for c in df.columns:
        if c in keep:
            cols.append(F.col(c))
        elif c in booleans:
            cols.append(F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c))
        elif c in integers:
            cols.append(F.coalesce(finite(F.col(c).try_cast("double")).cast("bigint"), F.lit(0).cast("bigint")).alias(c))
        else:
            cols.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c))
    return df.select(*cols)


def group_eligibility(df: DataFrame, group: Sequence[str], outcome: str, value: str, min_rows: int = MIN_ROWS,
                      min_per_class: int = MIN_PER_CLASS) -> DataFrame:
    """One row per group: size, events, and why the group cannot be tested."""
    known = F.col(outcome).isNotNull() & F.col(value).isNotNull()
    g = df.groupBy(*group).agg(
        F.count_if(known).alias("n"),
        F.count_if(known & (F.col(outcome) == 1)).alias("events"),
        (F.max(F.when(known, F.col(value))) > F.min(F.when(known, F.col(value)))).alias("__varies"))
    few = F.least(F.col("events"), F.col("n") - F.col("events")) < min_per_class
    reason = (F.when(F.col("n") < min_rows, "too_few_rows").when(few, "too_few_per_class")
              .when(~F.coalesce(F.col("__varies"), F.lit(False)), "no_variation").otherwise(""))
    return (g.withColumn("skip_reason", reason)
            .withColumn("status", F.when(F.col("skip_reason") == "", "PASS").otherwise("SKIP")).drop("__varies"))
