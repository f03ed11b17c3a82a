"""Data-quality checks as tables, verdicts and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.numeric import ratio
from cohortwise.operators.ordering import quantiles
from cohortwise.operators.setops import upsert
from cohortwise.session import materialize

# Fixed value: bytes per TiB.
TIB = float(1024**4)


def check_rows(df: DataFrame, checks: dict[str, tuple[Column, Column, str]]) -> DataFrame:
    """Check table from one aggregate.

    Each check is ``(condition aggregate, detail aggregate, severity)`` with
    severity ``FAIL`` or ``WARN`` for a condition that does not hold.
    """
    aggs = []
    for name, (ok, detail, _) in checks.items():
        aggs += [F.coalesce(ok, F.lit(False)).alias(f"ok_{name}"), detail.cast("string").alias(f"d_{name}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(n).alias("check"), F.when(F.col(f"ok_{n}"), "PASS").otherwise(sev).alias("status"),
                     F.to_json(F.struct(F.col(f"d_{n}").alias("value"))).alias("details")) for n, (_, _, sev) in checks.items()]
    return one.select(F.inline(F.array(*rows)))


def verdict(checks: DataFrame) -> DataFrame:
    """Counts per status; the verdict is PASS when nothing failed."""
    n = {s: F.count_if(F.col("status") == s).alias(f"{s.lower()}_count") for s in ("PASS", "WARN", "FAIL")}
    return checks.agg(*n.values()).withColumn("verdict", F.when(F.col("fail_count") == 0, "PASS").otherwise("FAIL"))


def require_pass(v: DataFrame) -> None:
    """Refuse to go on unless the saved verdict is PASS."""
    row = v.select("verdict").first()
    if row is None or row["verdict"] != "PASS":
        raise RuntimeError(f"the previous step did not pass: {None if row is None else row['verdict']}")


def choose_target(directions: DataFrame) -> str:
    """Adverse factor with the largest mean correlation."""
    row = directions.where("adverse").orderBy(F.col("mean_r").desc(), "factor").select("factor").first()
    if row is None:
        raise RuntimeError("no adverse factor")
    return row["factor"]


def expected_counts(df: DataFrame, group: Sequence[str], expected: DataFrame) -> DataFrame:
    """Observed against expected rows per group, including absent and surplus groups."""
    seen = df.groupBy(*group).agg(F.count(F.lit(1)).alias("observed"))
    j = seen.join(expected.select(*group, "expected"), list(group), "full_outer")
    same = F.coalesce(F.col("observed"), F.lit(0)) == F.coalesce(F.col("expected"), F.lit(0))
    return j.select(*group, F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("expected", F.lit(0)).alias("expected"), F.when(same, "PASS").otherwise("FAIL").alias("status"))


def matrix_health(df: DataFrame, feature: Sequence[str], value: str) -> DataFrame:
    """Finite share, constant features, largest and p95 absolute feature mean, minimum.

    The means are written once: those of centred features are rounding noise,
    another in every evaluation, and :func:`quantiles` reads them twice.
    """
    v = F.col(value)
    finite_v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    per = df.groupBy(*feature).agg(F.count(F.lit(1)).alias("n"), F.count(finite_v).alias("n_finite"), F.abs(F.avg(finite_v)).alias("abs_mean"),
                                   F.min(finite_v).alias("lo"), F.max(finite_v).alias("hi"))
    per = materialize(per, "features")
    one = per.agg(F.count(F.lit(1)).alias("features"), F.sum("n").alias("cells"), (F.sum("n") - F.sum("n_finite")).alias("non_finite"),
                  F.count_if(F.col("lo") == F.col("hi")).alias("constant_features"), F.max("abs_mean").alias("max_abs_mean"), F.min("lo").alias("min_value"))
    p95 = quantiles(per.select("abs_mean"), [], "abs_mean", {"p95_abs_mean": 0.95})
    return one.withColumn("p95_abs_mean", p95.scalar())


def manifest_completeness(df: DataFrame, group: Sequence[str], present: Column, size: Column) -> DataFrame:
    """Expected and present entries, bytes and a downloaded/partial/missing status."""
    g = df.groupBy(*group).agg(F.count(F.lit(1)).alias("expected_files"), F.count_if(present).alias("actual_files"), F.sum(F.when(present, size)).cast("double").alias("bytes"))
    status = (F.when(F.col("actual_files") == 0, "missing").when(F.col("actual_files") >= F.col("expected_files"), "downloaded").otherwise("partial"))
    return (g.withColumn("bytes", F.coalesce("bytes", F.lit(0.0))).withColumn("tib", F.col("bytes") / TIB)
            .withColumn("share", ratio(F.col("actual_files"), F.col("expected_files"))).withColumn("status", status))


def scope_status(label: Column, done: Column, expected: Column) -> Column:
    """Text status of an optional extension from its scope label and count."""
    return (F.when(done == 0, F.concat(F.lit("not_run_"), label)).when(done < expected, F.concat(F.lit("partial_"), label))
            .otherwise(F.concat(F.lit("complete_"), label)))


def refresh_checks(checks: DataFrame, new: DataFrame) -> DataFrame:
    """Replace checks of the same name, keep the others."""
    return upsert(checks.select("check", "status", "details"), new.select("check", "status", "details"), ["check"])
