"""Within-group statistics and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions.numeric import rounded
from cohortwise.operators import windows as wn
from cohortwise.operators.ordering import average_rank
from cohortwise.plans.registry import query, r
from cohortwise.plans.views import view


@query("e1_zscore_population", f"""SELECT cohort, entity, feature, {r("coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0)")} AS z
FROM v2 WINDOW w AS (PARTITION BY cohort, feature)""", "v2")
def e1(spark: SparkSession, sf: str) -> DataFrame:
    return wn.zscore_population(view(spark, sf, "v2"), ["cohort", "feature"], "value").select("cohort", "entity", "feature", rounded(F.col("z")).alias("z"))


@query("e2_zscore_sample", f"""SELECT cohort, entity, feature, {r("(value - avg(value) OVER w) / CASE WHEN stddev_samp(value) OVER w > 1e-8 THEN stddev_samp(value) OVER w ELSE 1 END")} AS z
FROM v2 WINDOW w AS (PARTITION BY cohort, feature)""", "v2")
def e2(spark: SparkSession, sf: str) -> DataFrame:
    return wn.zscore_sample(view(spark, sf, "v2"), ["cohort", "feature"], "value").select("cohort", "entity", "feature", rounded(F.col("z")).alias("z"))


@query("e3_average_rank", """SELECT cohort, item, rank() OVER (PARTITION BY cohort ORDER BY quantity) + (count(*) OVER (PARTITION BY cohort, quantity) - 1) / 2e0 AS avg_rank FROM v4""", "v4")
def e3(spark: SparkSession, sf: str) -> DataFrame:
    return average_rank(view(spark, sf, "v4").select("cohort", "item", "quantity"), ["cohort"], "quantity").select("cohort", "item", "avg_rank")


@query("e4_percentile_rank", f"""SELECT bag, item, {r("CASE WHEN count(*) OVER (PARTITION BY bag) = 1 THEN 1e0 ELSE (row_number() OVER (PARTITION BY bag ORDER BY score, item) - 1) / CAST(count(*) OVER (PARTITION BY bag) - 1 AS DOUBLE) END")} AS percentile FROM v4""", "v4")
def e4(spark: SparkSession, sf: str) -> DataFrame:
    return wn.percentile_rank(view(spark, sf, "v4").select("bag", "item", "score", "y"), ["bag"], "score", "item", tie_key=None).select("bag", "item", rounded(F.col("percentile")).alias("percentile"))


@query("e5_rank_within_entity", """SELECT entity, bag, row_number() OVER w AS rank, row_number() OVER w = 1 AS is_representative
FROM v3 WINDOW w AS (PARTITION BY cohort, entity ORDER BY size DESC, bag)""", "v3")
def e5(spark: SparkSession, sf: str) -> DataFrame:
    k = wn.row_rank(view(spark, sf, "v3").select("cohort", "entity", "bag", "size"), ["cohort", "entity"], "size", [F.col("size").desc(), F.col("bag")], tie_key="bag")
    return k.select("entity", "bag", F.col("rank").cast("bigint").alias("rank"), (F.col("rank") == 1).alias("is_representative"))


@query("e6_group_median_class", """SELECT v3.cohort, bag, CASE WHEN size >= m THEN 'higher' ELSE 'lower' END AS size_class
FROM v3 JOIN (SELECT cohort, median(size) AS m FROM v3 GROUP BY 1) g ON v3.cohort = g.cohort""", "v3")
def e6(spark: SparkSession, sf: str) -> DataFrame:
    m = wn.attach_median(view(spark, sf, "v3").select("cohort", "bag", "size"), ["cohort"], "size")
    return m.select("cohort", "bag", F.when(F.col("size") >= F.col("group_median"), "higher").otherwise("lower").alias("size_class"))


_P = "SELECT cohort, entity, CASE WHEN value >= 0 THEN least(round(value, 0) / 10000e0, 1e0) END AS p FROM v1"


@query("e7_bh_adjust", f"""WITH t AS ({_P}), k AS (SELECT *, count(*) OVER (PARTITION BY cohort) AS n, row_number() OVER (PARTITION BY cohort ORDER BY p, entity) AS rn FROM t WHERE p IS NOT NULL),
a AS (SELECT cohort, entity, p, least(1, min(p * n / rn) OVER (PARTITION BY cohort ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM k)
SELECT t.cohort, t.entity, t.p, {r('a.q')} AS q FROM t LEFT JOIN a ON t.entity = a.entity""", "v1")
def e7(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "v1").select("cohort", "entity", F.when(F.col("value") >= 0, F.least(F.round("value", 0) / F.lit(10000.0), F.lit(1.0))).alias("p"))
    return wn.bh_adjust(t, ["cohort"], "p").withColumn("q", rounded(F.col("q")))


@query("e8_loading_rank_share", f"""SELECT cohort, bag, row_number() OVER (PARTITION BY cohort ORDER BY size DESC, bag) AS loading_rank, {r('size / sum(size) OVER (PARTITION BY cohort)', 9)} AS share FROM v3""", "v3")
def e8(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v3").select("cohort", "bag", "size")
    k = wn.row_rank(wn.share_of_total(v, ["cohort"], "size"), ["cohort"], "size", [F.col("size").desc(), F.col("bag")], out="loading_rank", tie_key="bag")
    return k.select("cohort", "bag", F.col("loading_rank").cast("bigint").alias("loading_rank"), rounded(F.col("share"), 9).alias("share"))


@query("e9_dominant_entry", f"""WITH t AS (SELECT entity, priority, count(*) AS n FROM v3 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, priority) AS rn, sum(n) OVER (PARTITION BY entity) AS total FROM t)
SELECT entity, priority AS dominant, {r('n / CAST(total AS DOUBLE)')} AS dominant_fraction FROM k WHERE rn = 1""", "v3")
def e9(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "v3").groupBy("entity", "priority").agg(F.count(F.lit(1)).alias("n"))
    return wn.dominant(t, ["entity"], "priority", "n").withColumn("dominant_fraction", rounded(F.col("dominant_fraction")))


@query("e10_softmax_pool", f"""WITH e AS (SELECT bag, item, quantity, exp(score / 20000 - max(score / 20000) OVER (PARTITION BY bag)) AS e FROM v4)
SELECT bag, item, {r('e / sum(e) OVER (PARTITION BY bag)', 9)} AS weight, {r('sum(e * quantity) OVER (PARTITION BY bag) / sum(e) OVER (PARTITION BY bag)')} AS pooled FROM e""", "v4")
def e10(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v4").select("bag", "item", "quantity", (F.col("score") / 20000).alias("logit"))
    return wn.softmax_pool(v, ["bag"], "logit", "quantity").select("bag", "item", rounded(F.col("weight"), 9).alias("weight"), rounded(F.col("pooled")).alias("pooled"))


@query("e11_quantile_cut", f"""SELECT v.cohort, v.entity, CASE WHEN v.value IS NULL THEN 'missing' WHEN v.value <= c THEN 'low' ELSE 'high' END AS cut_label, {r('c')} AS cut_label_cutoff
FROM (SELECT cohort, entity, CASE WHEN nation <> 3 THEN value END AS value FROM v1) v JOIN (SELECT cohort, quantile_cont(value, 0.75) AS c FROM v1 WHERE nation <> 3 GROUP BY 1) g ON v.cohort = g.cohort""", "v1")
def e11(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v1").select("cohort", "entity", F.when(F.col("nation") != 3, F.col("value")).alias("value"))
    return wn.quantile_cut(v, ["cohort"], "value", 0.75, "low", "high", "missing").select("cohort", "entity", "cut_label", rounded(F.col("cut_label_cutoff")).alias("cut_label_cutoff"))


@query("e12_cumulative_share", """WITH t AS (SELECT cohort, nation, sum(value + 1000) AS s FROM v1 GROUP BY 1, 2), c AS (SELECT cohort, nation, sum(s) OVER (PARTITION BY cohort ORDER BY nation) / sum(s) OVER (PARTITION BY cohort) AS share FROM t)
SELECT cohort, min(nation) FILTER (WHERE share >= 0.8) AS first_index, count(*) AS n_index FROM c GROUP BY 1""", "v1")
def e12(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "v1").groupBy("cohort", "nation").agg(F.sum(F.col("value") + 1000).alias("s"))
    return wn.cumulative_share(t, ["cohort"], "nation", "s", 0.8)
