"""Group summaries of long values and of vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.numeric import ratio
from cohortwise.operators.ordering import medians, quantiles
from cohortwise.session import materialize


def collapse(df: DataFrame, keys: Sequence[str], value: str, how: str = "mean") -> DataFrame:
    """One row per key from duplicate rows."""
    return df.groupBy(*keys).agg((F.sum if how == "sum" else F.avg)(value).alias(value))


def observed_fraction(df: DataFrame, entities: DataFrame, cohort: str, feature: str, value: str) -> DataFrame:
    """Share of a cohort's entities with a value, per feature."""
    sizes = entities.groupBy(cohort).agg(F.count(F.lit(1)).alias("n_entities"))
    seen = df.groupBy(cohort, feature).agg(F.count(value).alias("n_observed"))
    return seen.join(sizes, cohort).withColumn("observed_fraction", ratio(F.col("n_observed"), F.col("n_entities")))


def median_abs_deviation(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Median and unscaled median absolute deviation per group."""
    med = medians(df, group, value, "median")
    dev = df.join(med, list(group)).withColumn("__dev", F.abs(F.col(value) - F.col("median")))
    return med.join(medians(dev, group, "__dev", "mad"), list(group))


def sorted_labels(df: DataFrame, keys: Sequence[str], label: str, out: str, sep: str = ";") -> DataFrame:
    return (df.select(*keys, label).distinct().groupBy(*keys)
            .agg(F.array_join(F.array_sort(F.collect_list(label)), sep).alias(out)))


def metric_summary(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean, median, 90th percentile and share above zero of the known values."""
    basic = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                   F.avg((F.col(value) > 0).cast("double")).alias("frac_gt0"))
    return basic.join(quantiles(df, group, value, {"median": 0.5, "p90": 0.9}), list(group))


def with_pooled(df: DataFrame, group: str, pooled: str = "pooled") -> DataFrame:
    """Each row twice: under its own group and under the pooled label.

    Group statistics of the result are the per-group and the overall level.
    """
    return df.withColumn(group, F.explode(F.array(F.col(group), F.lit(pooled))))


def vector_mean(df: DataFrame, keys: Sequence[str], vec: str, out: str = "x", weight: str | None = None) -> DataFrame:
    """Element-wise (weighted) mean per key without exploding the vectors."""
    args = [array_to_vector(F.col(vec).cast("array<double>"))]
    if weight is not None:
        args.append(F.col(weight).cast("double"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), vector_to_array(Summarizer.mean(*args)).alias(out))


def vector_mean_std(df: DataFrame, keys: Sequence[str], vec: str, out: str = "x") -> DataFrame:
    """Element-wise mean with the population deviation appended."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), Summarizer.metrics("mean", "variance").summary(v).alias("s"))
    shrink = (F.col("n_rows") - 1) / F.col("n_rows")
    std = F.transform(vector_to_array("s.variance"), lambda a: F.sqrt(F.greatest(a * shrink, F.lit(0.0))))
    return s.select(*keys, "n_rows", F.concat(vector_to_array("s.mean"), std).alias(out))


def vector_median(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Element-wise median per key as long ``(position, value)`` rows.

    Vectors are written first: means that are summed anew, in another order,
    differ in their last bits, and :func:`quantiles` reads its rows twice.
    """
    written = materialize(df.select(*keys, vec), "vectors")
    long = written.select(*keys, F.posexplode(vec).alias("position", "__v"))
    return medians(long, [*keys, "position"], "__v", "value")


def single_value(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The only value of ``column`` per key; fails on the first key with two."""
    g = df.groupBy(*keys).agg(F.min(column).alias(column), F.max(column).alias("__hi"))
    bad = g.where(F.col(column) != F.col("__hi")).limit(1).collect()
    if bad:
        raise ValueError(f"{column} has several values for {bad[0].asDict()}")
    return g.drop("__hi")


def instance_rollup(df: DataFrame, item: Sequence[str], kind: str, names: dict[int, str], area: Column) -> DataFrame:
    """Counts, fractions and densities of typed instances per item."""
    aggs = [F.count(F.lit(1)).alias("n_instances"), F.sum(area).alias("area")]
    aggs += [F.count_if(F.col(kind) == k).alias(f"{n}_count") for k, n in names.items()]
    g = df.groupBy(*item).agg(*aggs)
    g = g.withColumn("density_per_10k", ratio(F.col("n_instances") * 10000.0, F.greatest(F.col("area"), F.lit(1.0))))
    for n in names.values():
        g = g.withColumn(f"{n}_fraction", ratio(F.col(f"{n}_count"), F.col("n_instances")))
    return g


def rollup_fractions(items: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Count-weighted fractions and mean density per group of items."""
    aggs = [F.count(F.lit(1)).alias("n_items"), F.sum("n_instances").alias("n_instances"), F.avg("density_per_10k").alias("mean_density")]
    aggs += [ratio(F.sum(f"{n}_count"), F.sum("n_instances")).alias(f"{n}_fraction") for n in names]
    return items.groupBy(*group).agg(*aggs)


def completeness(df: DataFrame, group: Sequence[str], columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Rows and the available number and share of each column per group."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        aggs += [F.count(c).alias(f"{c}_available_n"), F.round(ratio(F.count(c), F.count(F.lit(1))), digits).alias(f"{c}_completeness")]
    return df.groupBy(*group).agg(*aggs)
