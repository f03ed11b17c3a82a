"""Best rows, top-k and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions.numeric import rounded
from cohortwise.operators import aggregates as ag
from cohortwise.operators import selection as sel
from cohortwise.plans.registry import query, r
from cohortwise.plans.views import table, view
from cohortwise.session import materialize

_SEED = 20260609


@query("f1_best_row_per_entity", """SELECT cohort, entity, case_id FROM (SELECT *, row_number() OVER (PARTITION BY cohort, entity ORDER BY
  CASE WHEN sample_type LIKE '%rimary%' THEN 0 WHEN sample_type IS NULL THEN 1 ELSE 2 END, price, case_id) AS rn FROM v11) WHERE rn = 1""", "v11")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    prio = F.when(F.col("sample_type").contains("rimary"), 0).when(F.col("sample_type").isNull(), 1).otherwise(2)
    v = view(spark, sf, "v11").select("cohort", "entity", "case_id", "sample_type", "price")
    return sel.best_row(v, ["cohort", "entity"], [prio, F.col("price"), F.col("case_id")]).select("cohort", "entity", "case_id")


@query("f2_representative_bag", "SELECT cohort, entity, bag FROM (SELECT *, row_number() OVER (PARTITION BY cohort, entity ORDER BY size DESC, bag) AS rn FROM v3) WHERE rn = 1", "v3")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    return sel.best_row(view(spark, sf, "v3").select("cohort", "entity", "bag", "size"), ["cohort", "entity"], [-F.col("size"), F.col("bag")]).select("cohort", "entity", "bag")


@query("f3_representative_by_status", """SELECT cohort, entity, bag, status, candidates, passed, CASE WHEN status = 'PASS' THEN 'best_passing' ELSE 'no_candidate_passed' END AS reason FROM (
SELECT *, count(*) OVER p AS candidates, count(*) FILTER (WHERE status = 'PASS') OVER p AS passed,
  row_number() OVER (PARTITION BY cohort, entity ORDER BY CASE WHEN status = 'PASS' THEN 0 ELSE 1 END, size DESC, priority, bag) AS rn FROM v3 WINDOW p AS (PARTITION BY cohort, entity)) WHERE rn = 1""", "v3")
def f3(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.when(F.col("status") == "PASS", 0).otherwise(1), -F.coalesce("size", F.lit(0.0)), F.coalesce("priority", F.lit("999999")), F.col("bag")]
    b = sel.best_row(view(spark, sf, "v3"), ["cohort", "entity"], order,
                     [F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("status") == "PASS").alias("passed")])
    return b.select("cohort", "entity", "bag", "status", "candidates", "passed", F.when(F.col("status") == "PASS", "best_passing").otherwise("no_candidate_passed").alias("reason"))


@query("f4_representative_by_flags", """SELECT l_partkey AS entity, l_orderkey AS bag FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'R' DESC, l_linestatus = 'F' DESC, l_quantity DESC, l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def f4(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("bag"), "l_returnflag", "l_linestatus", "l_quantity", "l_linenumber", "l_suppkey")
    order = [F.col("l_returnflag") != "R", F.col("l_linestatus") != "F", -F.col("l_quantity"), F.col("bag"), F.col("l_linenumber"), F.col("l_suppkey")]
    return sel.best_row(li, ["entity"], order).select("entity", "bag")


@query("f5_bounded_pilot", """WITH t AS (SELECT *, count(*) FILTER (WHERE size BETWEEN 100000 AND 100500) OVER (PARTITION BY cohort, priority) AS n_in FROM v3)
SELECT cohort, priority, bag, rank FROM (SELECT *, row_number() OVER (PARTITION BY cohort, priority ORDER BY size, bag) AS rank FROM t WHERE size BETWEEN 100000 AND 100500 OR n_in = 0) WHERE rank <= 3""", "v3")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v3").select("cohort", "priority", "bag", "size")
    return sel.bounded_pilot(v, ["cohort", "priority"], "size", 100000, 100500, [F.col("size"), F.col("bag")], 3).select("cohort", "priority", "bag", "rank")


@query("f6_top_features_by_dispersion", f"""SELECT feature, {r('avg(m)')} AS mean_mad FROM (SELECT cohort, feature, mad(value) AS m FROM v2 GROUP BY 1, 2) GROUP BY 1 ORDER BY avg(m) DESC, feature LIMIT 10""", "v2")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    m = ag.median_abs_deviation(materialize(view(spark, sf, "v2").select("cohort", "feature", "value")), ["cohort", "feature"], "value")
    g = m.groupBy("feature").agg(F.avg("mad").alias("m")).orderBy(F.col("m").desc(), "feature").limit(10)
    return g.select("feature", rounded(F.col("m")).alias("mean_mad"))


@query("f7_top_items_per_bag", "SELECT cohort, bag, item, x, y, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY score DESC, item) AS rank FROM v4) WHERE rank <= 20", "v4")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v4").select("cohort", "bag", "item", "x", "y", "score")
    return sel.top_per_group(v, ["bag"], [F.col("score").desc(), F.col("item")], 20)


@query("f7_top_items_global", "SELECT cohort, bag, item, score FROM v4 ORDER BY score DESC, item LIMIT 100", "v4")
def f7_global(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v4").select("cohort", "bag", "item", "score").orderBy(F.col("score").desc(), "item").limit(100)


@query("f8_group_head", "SELECT cohort, status, priority, bag, rank FROM (SELECT *, row_number() OVER (PARTITION BY cohort, status, priority ORDER BY bag) AS rank FROM v3) WHERE rank <= 5", "v3")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    return sel.top_per_group(view(spark, sf, "v3").select("cohort", "status", "priority", "bag"), ["cohort", "status", "priority"], [F.col("bag")], 5)


@query("f9_control_sample", f"""WITH t AS (SELECT bag, item, score, score <= median(score) OVER (PARTITION BY bag) AS low, count(*) OVER (PARTITION BY bag) AS n FROM v4),
u AS (SELECT *, count(*) FILTER (WHERE low) OVER (PARTITION BY bag) AS n_low FROM t),
k AS (SELECT bag, item, row_number() OVER (PARTITION BY bag ORDER BY md5('{_SEED}|' || item), item) AS rn FROM u WHERE low OR n_low < 30 OR n <= 30)
SELECT bag, item FROM k WHERE rn <= 30""", "v4")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    return sel.control_sample(view(spark, sf, "v4").select("bag", "item", "score"), ["bag"], "score", "item", 30, _SEED).select("bag", "item")


@query("f10_seeded_sample", f"SELECT bag, item FROM (SELECT bag, item, row_number() OVER (PARTITION BY bag ORDER BY md5('{_SEED}|' || item), item) AS rn FROM v4) WHERE rn <= 64", "v4")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return sel.sample_per_group(view(spark, sf, "v4").select("bag", "item"), ["bag"], "item", 64, _SEED)


@query("f11_evenly_spaced", """WITH t AS (SELECT bag, item, row_number() OVER (PARTITION BY bag ORDER BY score, item) - 1 AS i, count(*) OVER (PARTITION BY bag) AS n FROM v4),
s AS (SELECT DISTINCT bag, n, CAST(round_even(j * ((n - 1) / 99e0), 0) AS BIGINT) AS i FROM (SELECT DISTINCT bag, n FROM t), (SELECT unnest(range(0, 100)) AS j))
SELECT t.bag, t.item FROM t JOIN s ON t.bag = s.bag AND t.i = s.i""", "v4")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v4").select("bag", "item", "score")
    return sel.evenly_spaced(v, ["bag"], "score", [F.col("score"), F.col("item")], 100).select("bag", "item")


@query("f12_centre_representatives", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY abs(quantity - 25), score DESC, item) AS cr FROM v4)
SELECT bag, item, selection_rank FROM (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY CASE WHEN occupancy >= 0.70 THEN 0 ELSE 1 END, cr) AS selection_rank FROM c WHERE cr <= 24) WHERE selection_rank <= 8""", "v4")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v4").select("bag", "item", "score", F.abs(F.col("quantity") - 25).alias("d"), F.when(F.col("occupancy") >= 0.70, "PASS").otherwise("WARN").alias("status"))
    return sel.representatives_near_centre(v, ["bag"], "d", "score", "item", "status", 24, 8).select("bag", "item", "selection_rank")


@query("f13_top_by_abs_correlation", f"""WITH c AS (SELECT v2.cohort, feature, corr(v2.value, v1.value) AS c FROM v2 JOIN v1 ON v1.entity = v2.entity GROUP BY 1, 2)
SELECT cohort, feature, {r('c')} AS r, rank FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY abs(c) DESC, feature) AS rank FROM c) WHERE rank <= 5""", "v1 v2")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    j = view(spark, sf, "v2").join(view(spark, sf, "v1").select("entity", F.col("value").alias("target")), "entity")
    c = j.groupBy("cohort", "feature").agg(F.corr("value", "target").alias("c"))
    return sel.top_per_group(c, ["cohort"], [F.abs(F.col("c")).desc(), F.col("feature")], 5).select("cohort", "feature", rounded(F.col("c")).alias("r"), "rank")


@query("f14_best_level", """WITH t AS (SELECT l_suppkey AS bag, l_orderkey AS level, l_partkey, 0.1e0 + l_quantity / 25 AS res, l_linenumber AS frames FROM lineitem)
SELECT bag, level FROM (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY abs(log2(res * greatest(round_even(0.5e0 / res, 0), 1) / 0.5e0)), abs(log2(res / 0.5e0)), frames, level, l_partkey) AS rn FROM t) WHERE rn = 1""")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("bag"), F.col("l_orderkey").alias("level"), "l_partkey", (F.lit(0.1) + F.col("l_quantity") / 25).alias("res"), F.col("l_linenumber").alias("frames"))
    return sel.best_row(li, ["bag"], [*sel.level_order(F.col("res"), F.col("frames"), 0.5), F.col("level"), F.col("l_partkey")]).select("bag", "level")
