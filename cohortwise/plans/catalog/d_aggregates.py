"""Group summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions.numeric import ratio, rounded
from cohortwise.operators import aggregates as ag
from cohortwise.operators.selection import best_row
from cohortwise.plans.registry import query, r
from cohortwise.plans.views import table, view
from cohortwise.session import materialize

# Instance type labels.
TYPES = {1: "neoplastic", 2: "inflammatory", 3: "connective", 4: "dead", 5: "epithelial"}


@query("d1_collapse_duplicates", f"SELECT cohort, feature, {r('sum(value / 1e7)')} AS total, {r('avg(value)')} AS mean FROM v2 GROUP BY 1, 2", "v2")
def d1(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v2")
    s = ag.collapse(v.withColumn("total", F.col("value") / 1e7), ["cohort", "feature"], "total", "sum")
    return s.join(ag.collapse(v, ["cohort", "feature"], "value"), ["cohort", "feature"]).select("cohort", "feature", rounded(F.col("total")).alias("total"), rounded(F.col("value")).alias("mean"))


@query("d2_observed_fraction", f"""SELECT cohort, feature, count(value) AS n_observed, n AS n_entities, {r('count(value) / CAST(n AS DOUBLE)')} AS observed_fraction
FROM v2 JOIN (SELECT cohort, count(*) AS n FROM v1 GROUP BY 1) USING (cohort) GROUP BY cohort, feature, n""", "v1 v2")
def d2(spark: SparkSession, sf: str) -> DataFrame:
    return ag.observed_fraction(view(spark, sf, "v2"), view(spark, sf, "v1"), "cohort", "feature", "value").withColumn("observed_fraction", rounded(F.col("observed_fraction")))


@query("d3_median_mad", f"SELECT cohort, feature, {r('median(value)')} AS median, {r('mad(value)')} AS mad FROM v2 GROUP BY 1, 2", "v2")
def d3(spark: SparkSession, sf: str) -> DataFrame:
    m = ag.median_abs_deviation(materialize(view(spark, sf, "v2").select("cohort", "feature", "value")), ["cohort", "feature"], "value")
    return m.select("cohort", "feature", rounded(F.col("median")).alias("median"), rounded(F.col("mad")).alias("mad"))


@query("d4_pivot_mean", f"""SELECT cohort, {', '.join(r(f"avg(value) FILTER (WHERE feature = 'Brand#{i}')") + f' AS b{i}' for i in range(1, 26))} FROM v2 GROUP BY 1""", "v2")
def d4(spark: SparkSession, sf: str) -> DataFrame:
    names = [f"Brand#{i}" for i in range(1, 26)]
    p = view(spark, sf, "v2").groupBy("cohort").pivot("feature", names).agg(F.avg("value"))
    return p.select("cohort", *[rounded(F.col(f"`{n}`")).alias(f"b{i + 1}") for i, n in enumerate(names)])


@query("d5_group_counts", f"""SELECT cohort, status, count(*) AS n, count(DISTINCT entity) AS n_entities, count(*) FILTER (WHERE priority = '1-URGENT') AS n_urgent,
{r('CAST(sum(CAST(size AS DECIMAL(18,2))) AS DOUBLE) / count(*)')} AS mean_size, {r('median(size)')} AS median_size FROM v3 GROUP BY 1, 2""", "v3")
def d5(spark: SparkSession, sf: str) -> DataFrame:
    from cohortwise.operators.ordering import medians

    v = view(spark, sf, "v3")
    g = v.groupBy("cohort", "status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("n_entities"), F.count_if(F.col("priority") == "1-URGENT").alias("n_urgent"),
                                          rounded(ratio(F.sum(F.col("size").cast("decimal(18,2)")), F.count(F.lit(1)))).alias("mean_size"))
    return g.join(medians(v, ["cohort", "status"], "size", "median_size"), ["cohort", "status"]).withColumn("median_size", rounded(F.col("median_size")))


@query("d6_sorted_label_concat", "SELECT entity, string_agg(DISTINCT priority, ';' ORDER BY priority) AS labels FROM v3 GROUP BY 1", "v3")
def d6(spark: SparkSession, sf: str) -> DataFrame:
    return ag.sorted_labels(view(spark, sf, "v3"), ["entity"], "priority", "labels")


@query("d7_named_aggregates", f"""SELECT cohort, count(*) AS n, count(score) AS n_known, sum(y)::BIGINT AS events, {r('avg(y)')} AS event_rate, {r('avg(score)')} AS mean_score FROM v6 GROUP BY 1""", "v6")
def d7(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v6").groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_known"), F.sum("y").alias("events"),
                                                       rounded(F.avg("y")).alias("event_rate"), rounded(F.avg("score")).alias("mean_score"))


@query("d8_metric_summary", f"""SELECT cohort, count(value) AS n, {r('avg(value)')} AS mean, {r('median(value)')} AS median, {r('quantile_cont(value, 0.9)')} AS p90,
{r('avg(CASE WHEN value > 0 THEN 1e0 ELSE 0e0 END)')} AS frac_gt0 FROM v1 GROUP BY 1""", "v1")
def d8(spark: SparkSession, sf: str) -> DataFrame:
    m = ag.metric_summary(view(spark, sf, "v1"), ["cohort"], "value")
    return m.select("cohort", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "median", "p90", "frac_gt0")])


@query("d9_group_and_pooled", f"""SELECT coalesce(cohort, 'pooled') AS cohort, count(*) AS n, {r('avg(score)')} AS mean_score, {r('corr(score, y)')} AS r
FROM v6 GROUP BY GROUPING SETS ((cohort), ())""", "v6")
def d9(spark: SparkSession, sf: str) -> DataFrame:
    g = view(spark, sf, "v6").rollup("cohort").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("score")).alias("mean_score"), rounded(F.corr("score", F.col("y").cast("double"))).alias("r"))
    return g.withColumn("cohort", F.coalesce("cohort", F.lit("pooled")))


def _long(df: DataFrame, keys: list[str], vec: str = "x") -> DataFrame:
    return df.select(*keys, F.posexplode(vec).alias("position", "v")).select(*keys, F.col("position").cast("bigint").alias("position"), rounded(F.col("v")).alias("value"))


_V5 = "(SELECT cohort, entity, bag, item, label, i AS position, CAST(embedding[i + 1] AS DOUBLE) AS v FROM v5, (SELECT unnest(range(0, 64)) AS i))"


@query("d10_vector_mean", f"SELECT cohort, entity, bag, position, {r('avg(v)')} AS value FROM {_V5} GROUP BY 1, 2, 3, 4", "v5")
def d10(spark: SparkSession, sf: str) -> DataFrame:
    return _long(ag.vector_mean(view(spark, sf, "v5"), ["cohort", "entity", "bag"], "embedding"), ["cohort", "entity", "bag"])


@query("d11_vector_mean_std", f"""SELECT bag, position, {r('avg(v)')} AS value FROM {_V5} GROUP BY 1, 2
UNION ALL SELECT bag, position + 64, {r('stddev_pop(v)')} FROM {_V5} GROUP BY bag, position""", "v5")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    return _long(ag.vector_mean_std(view(spark, sf, "v5"), ["bag"], "embedding"), ["bag"])


@query("d12_vector_median", f"""WITH b AS (SELECT cohort, entity, bag, position, avg(v) AS v FROM {_V5} GROUP BY 1, 2, 3, 4)
SELECT cohort, entity, position, {r('median(v)')} AS value FROM b GROUP BY 1, 2, 3""", "v5")
def d12(spark: SparkSession, sf: str) -> DataFrame:
    bags = ag.vector_mean(view(spark, sf, "v5"), ["cohort", "entity", "bag"], "embedding")
    m = ag.vector_median(bags.withColumnRenamed("x", "v"), ["cohort", "entity"], "v")
    return m.select("cohort", "entity", F.col("position").cast("bigint").alias("position"), rounded(F.col("value")).alias("value"))


@query("d13_weighted_vector_mean", f"""SELECT cohort, entity, position, {r('sum(v * greatest(label, 1)) / sum(greatest(label, 1))')} AS value FROM {_V5} GROUP BY 1, 2, 3""", "v5")
def d13(spark: SparkSession, sf: str) -> DataFrame:
    w = view(spark, sf, "v5").withColumn("w", F.when(F.col("label") > 0, F.col("label")).otherwise(F.lit(1)))
    return _long(ag.vector_mean(w, ["cohort", "entity"], "embedding", weight="w"), ["cohort", "entity"])


_D14 = "SELECT item, any_value(cohort) AS c, count(*) AS n_instances, sum(box_w * box_h) AS area, " + ", ".join(f"count(*) FILTER (WHERE type_id = {k}) AS {n}_count" for k, n in TYPES.items()) + " FROM v9 GROUP BY item"


@query("d14_instance_rollup", f"""WITH t AS ({_D14}) SELECT item, n_instances, {r('n_instances * 10000e0 / greatest(area, 1)')} AS density_per_10k,
{', '.join(f"{n}_count, {r(f'{n}_count / CAST(n_instances AS DOUBLE)')} AS {n}_fraction" for n in TYPES.values())} FROM t""", "v9")
def d14(spark: SparkSession, sf: str) -> DataFrame:
    t = ag.instance_rollup(view(spark, sf, "v9"), ["item"], "type_id", TYPES, F.col("box_w") * F.col("box_h"))
    return t.select("item", "n_instances", rounded(F.col("density_per_10k")).alias("density_per_10k"),
                    *[c for n in TYPES.values() for c in (F.col(f"{n}_count"), rounded(F.col(f"{n}_fraction")).alias(f"{n}_fraction"))])


@query("d14_group_fractions", f"""WITH t AS (SELECT cohort, item, count(*) AS n_instances, sum(box_w * box_h) AS area, {", ".join(f"count(*) FILTER (WHERE type_id = {k}) AS {n}_count" for k, n in TYPES.items())} FROM v9 GROUP BY 1, 2)
SELECT cohort, count(*) AS n_items, sum(n_instances)::BIGINT AS n_instances, {r('avg(n_instances * 10000e0 / greatest(area, 1))')} AS mean_density,
{', '.join(f"{r(f'sum({n}_count) / CAST(sum(n_instances) AS DOUBLE)')} AS {n}_fraction" for n in TYPES.values())} FROM t GROUP BY 1""", "v9")
def d14_group(spark: SparkSession, sf: str) -> DataFrame:
    t = ag.instance_rollup(view(spark, sf, "v9"), ["cohort", "item"], "type_id", TYPES, F.col("box_w") * F.col("box_h"))
    g = ag.rollup_fractions(t, ["cohort"], list(TYPES.values()))
    return g.select("cohort", "n_items", "n_instances", rounded(F.col("mean_density")).alias("mean_density"), *[rounded(F.col(f"{n}_fraction")).alias(f"{n}_fraction") for n in TYPES.values()])


@query("d15_completeness", """SELECT cohort, priority, count(*) AS n_rows, count(stage) AS stage_available_n, round(count(stage) / CAST(count(*) AS DOUBLE), 4) AS stage_completeness,
count(n_stage) AS n_stage_available_n, round(count(n_stage) / CAST(count(*) AS DOUBLE), 4) AS n_stage_completeness FROM v11 GROUP BY 1, 2""", "v11")
def d15(spark: SparkSession, sf: str) -> DataFrame:
    return ag.completeness(view(spark, sf, "v11"), ["cohort", "priority"], ["stage", "n_stage"])


@query("d16_dedupe_first_last", """SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type, min(ts) AS first_ts FROM events GROUP BY 1""")
def d16(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    first = best_row(ev, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", F.col("event_type").alias("first_type"), F.col("ts").alias("first_ts"))
    last = ev.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    return first.join(last, "user_id").select("user_id", "first_type", "last_type", "first_ts")


@query("d17_single_value_metadata", "SELECT entity, min(cohort) AS cohort FROM v5 GROUP BY 1", "v5")
def d17(spark: SparkSession, sf: str) -> DataFrame:
    return ag.single_value(view(spark, sf, "v5"), ["entity"], "cohort")


@query("d18_status_counts", "SELECT stage, count(*) AS n FROM v11 GROUP BY 1", "v11")
def d18(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v11").groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
