"""Derived inputs shared by several queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.operators.windows import zscore_sample
from cohortwise.plans.views import table, view
from cohortwise.session import materialize


def survival(spark: SparkSession, sf: str) -> DataFrame:
    """Time from the first event to the first large purchase, else censored at the last event."""
    big = (F.col("event_type") == "purchase") & (F.col("value") > 100)
    g = table(spark, sf, "events").groupBy(F.col("user_id").alias("entity")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min(F.when(big, F.col("ts"))).alias("hit_ts"),
        F.count(F.lit(1)).alias("n_events"), F.avg("value").alias("mean_value"),
        F.avg((F.col("event_type") == "error").cast("double")).alias("error_share"))
    seconds = F.expr("CAST(CAST(coalesce(hit_ts, last_ts) - first_ts AS INTERVAL SECOND) AS DECIMAL(20,6))")
    days = seconds.cast("double") / F.lit(86400.0)
    return g.select("entity", days.alias("days"), F.col("hit_ts").isNotNull().cast("int").alias("event"), "n_events", "mean_value", "error_share")


def xy_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Input and target blocks of the stored vectors: 48 inputs, 16 targets."""
    v = view(spark, sf, "v5").select("cohort", F.col("item").alias("entity"), F.col("embedding").cast("array<double>").alias("e"))
    return v.select("cohort", "entity", F.slice("e", 1, 48).alias("x"), F.slice("e", 49, 16).alias("y"))


def clinical(spark: SparkSession, sf: str) -> DataFrame:
    """Per entity: two outcomes and standardised covariates from its orders."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(
        F.max(((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).cast("int")).alias("y_urgent"),
        F.max(((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")).cast("int")).alias("y_pending"),
        F.avg("o_totalprice").alias("size"), F.count(F.lit(1)).cast("double").alias("count"))
    c = view(spark, sf, "v1").join(o, "entity", "left")
    c = c.select("cohort", "entity", "value", "size", "count", F.coalesce("y_urgent", F.lit(0)).alias("y_urgent"), F.coalesce("y_pending", F.lit(0)).alias("y_pending"),
                 (F.col("nation") % 2).cast("double").alias("flag"))
    for src, out in (("value", "age_z"), ("size", "size_z"), ("count", "count_z")):
        c = zscore_sample(c, ["cohort"], src, out)
    return materialize(c, "clinical")
