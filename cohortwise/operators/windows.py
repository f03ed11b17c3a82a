"""Within-group standardisation, ranks, adjusted p-values and cuts.

Group statistics are aggregated (with map-side partial sums) and joined back;
adaptive execution broadcasts them when their measured size is small and splits
the skewed side of the join otherwise. Orders within a group use
:mod:`cohortwise.operators.ordering`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.numeric import ratio
from cohortwise.operators.ordering import average_rank, positions, quantiles, running
from cohortwise.session import materialize

# Smallest sample deviation that still counts as spread.
MIN_SD = 1e-8
MIN_SD_STRICT = 1e-10


def zscore_population(df: DataFrame, group: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """Population z-score; constant groups and missing values give 0."""
    return _scaled(df, population_stats(df, group, value), group, value, out)


def written_zscore(df: DataFrame, group: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """:func:`zscore_population` of rows and statistics that are written once.

    The rows are not computed twice, and as the statistics' size is known before
    the join, the rows are not shuffled for it where the statistics are small.
    """
    rows = materialize(df, "rows")
    return _scaled(rows, materialize(population_stats(rows, group, value), "stats"), group, value, out)


def population_stats(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*group).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))


def _scaled(df: DataFrame, stats: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    z = F.coalesce(F.try_divide(F.col(value) - F.col("__m"), F.col("__s")), F.lit(0.0))
    return df.join(stats, list(group)).withColumn(out, z).drop("__m", "__s")


def zscore_sample(df: DataFrame, group: Sequence[str], value: str, out: str = "z", min_sd: float = MIN_SD) -> DataFrame:
    """Sample z-score; tiny or undefined spread divides by 1, missing stays missing."""
    stats = df.groupBy(*group).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    sd = F.when(F.col("__s") > min_sd, F.col("__s")).otherwise(F.lit(1.0))
    return df.join(stats, list(group)).withColumn(out, (F.col(value) - F.col("__m")) / sd).drop("__m", "__s")


def percentile_rank(df: DataFrame, group: Sequence[str], value: str, tie: str, out: str = "percentile",
                    tie_key: str | None = None) -> DataFrame:
    """(position - 1) / (n - 1); ties keep the order of ``tie``, a single row gets 1."""
    ranked = positions(df, group, value, [F.col(value), F.col(tie)], tie_key=tie_key, out="__p")
    pct = F.when(F.col("n_group") == 1, F.lit(1.0)).otherwise(ratio(F.col("__p") - 1, F.col("n_group") - 1))
    return ranked.withColumn(out, pct).drop("__p", "n_group")


def row_rank(df: DataFrame, group: Sequence[str], key: str, order_by: Sequence[Column], out: str = "rank",
             descending: bool = True, tie_key: str | None = None) -> DataFrame:
    return positions(df, group, key, order_by, tie_key=tie_key, out=out, descending=descending).drop("n_group")


def attach_median(df: DataFrame, group: Sequence[str], value: str, out: str = "group_median") -> DataFrame:
    return df.join(quantiles(df, group, value, {out: 0.5}), list(group), "left")


def bh_adjust(df: DataFrame, family: Sequence[str], p: str, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values per family; missing p stays missing.

    Works on distinct p-values: tied tests share the largest rank of the tie.
    """
    known = df.where(F.col(p).isNotNull()).groupBy(*family, p).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(known, family, p, {"__n": "sum"})
    raw = F.col(p) * F.col("__n_total") / (F.col("__n_before") + F.col("__n"))
    ranked = ranked.select(*family, p, raw.alias("__raw"), (-F.col(p)).alias("__neg"))
    best = running(ranked, family, "__neg", {"__raw": "min"})
    q = F.least(F.lit(1.0), F.col("__raw"), F.col("__raw_before"))
    return df.join(best.select(*family, p, q.alias(out)), [*family, p], "left").select(*df.columns, out)


def share_of_total(df: DataFrame, group: Sequence[str], value: str, out: str = "share") -> DataFrame:
    totals = df.groupBy(*group).agg(F.sum(value).alias("__t"))
    safe = F.when(F.col("__t") > 0, F.col("__t")).otherwise(F.lit(1.0))
    return df.join(totals, list(group)).withColumn(out, F.col(value) / safe).drop("__t")


def dominant(df: DataFrame, group: Sequence[str], label: str, value: str) -> DataFrame:
    """Largest entry per group (smallest label on ties) and its share of the total."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(label).alias("l"))).alias("b")
    agg = df.groupBy(*group).agg(best, F.sum(value).alias("t"))
    lab, val = F.col("b.l"), -F.col("b.v")
    return agg.select(*group, lab.alias("dominant"), (val / F.when(F.col("t") > 0, F.col("t")).otherwise(F.lit(1.0))).alias("dominant_fraction"))


def softmax_pool(df: DataFrame, group: Sequence[str], logit: str, value: str) -> DataFrame:
    """Softmax weights of ``logit`` within the group and the pooled ``value``."""
    peak = df.groupBy(*group).agg(F.max(logit).alias("__m"))
    e = df.join(peak, list(group)).withColumn("__e", F.exp(F.col(logit) - F.col("__m")))
    sums = e.groupBy(*group).agg(F.sum("__e").alias("__t"), F.sum(F.col("__e") * F.col(value)).alias("__w"))
    return (e.join(sums, list(group)).withColumn("weight", F.col("__e") / F.col("__t"))
            .withColumn("pooled", F.col("__w") / F.col("__t")).drop("__m", "__e", "__t", "__w"))


def quantile_cut(df: DataFrame, group: Sequence[str], value: str, prob: float, low: str, high: str, missing: str,
                 out: str = "cut_label") -> DataFrame:
    """``value`` up to the group quantile is ``low``, above it ``high``."""
    cuts = quantiles(df, group, value, {"__cut": prob})
    label = (F.when(F.col(value).isNull() | F.col("__cut").isNull(), missing)
             .when(F.col(value) <= F.col("__cut"), low).otherwise(high))
    return df.join(cuts, list(group), "left").withColumn(out, label).withColumnRenamed("__cut", f"{out}_cutoff")


def cumulative_share(df: DataFrame, group: Sequence[str], index: str, value: str, threshold: float) -> DataFrame:
    """First index at which the running share of ``value`` reaches ``threshold``."""
    run = running(df, group, index, {value: "sum"})
    share = ratio(F.col(f"{value}_before") + F.col(value), F.col(f"{value}_total"))
    return run.withColumn("share", share).groupBy(*group).agg(
        F.min(F.when(F.col("share") >= threshold, F.col(index))).alias("first_index"),
        F.count(F.lit(1)).alias("n_index"))


def spearman_ranks(df: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    return average_rank(average_rank(df, group, a, "rank_a"), group, b, "rank_b")


def rank_within(df: DataFrame, group: Sequence[str], order_by: Sequence[Column], out: str = "rank") -> DataFrame:
    """Row number in groups that are small by definition (bags of one entity)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order_by)))
