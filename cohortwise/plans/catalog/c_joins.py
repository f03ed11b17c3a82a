"""Joins and key algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.operators import aggregates as ag
from cohortwise.operators import joins as jn
from cohortwise.operators.selection import best_row
from cohortwise.plans.registry import query
from cohortwise.plans.views import table, view
from cohortwise.streaming.resume import pending


@query("c1_validated_left_join", "SELECT v1.cohort, v1.entity, v1.value, v6.y FROM v1 LEFT JOIN v6 ON v1.cohort = v6.cohort AND v1.entity = v6.entity", "v1 v6")
def c1(spark: SparkSession, sf: str) -> DataFrame:
    right = view(spark, sf, "v6").select("cohort", "entity", "y")
    return jn.validated_join(view(spark, sf, "v1").select("cohort", "entity", "value"), right, ["cohort", "entity"], "left", required=["y"])


@query("c2_validated_inner_join", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def c2(spark: SparkSession, sf: str) -> DataFrame:
    return jn.validated_join(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"], "inner")


@query("c3_many_to_one_lookup", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def c3(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return jn.lookup(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "o_custkey", "c_mktsegment")


@query("c4_map_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'PROMO'")
def c4(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_type") != "PROMO", F.col("p_brand")).alias("p_brand"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return jn.map_values(li, m, "l_partkey", "p_partkey", "p_brand", "symbol").select("l_orderkey", "l_linenumber", "l_partkey", "symbol")


@query("c5_semi_join", "SELECT cohort, entity, value FROM v1 WHERE EXISTS (SELECT 1 FROM v3 WHERE v3.cohort = v1.cohort AND v3.entity = v1.entity AND v3.status = 'PASS')", "v1 v3")
def c5(spark: SparkSession, sf: str) -> DataFrame:
    keys = view(spark, sf, "v3").where("status = 'PASS'")
    return jn.members(view(spark, sf, "v1").select("cohort", "entity", "value"), keys, ["cohort", "entity"])


@query("c5_selected_entities", "SELECT DISTINCT cohort, entity FROM v3 WHERE status = 'PASS'", "v3")
def c5_selected(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v3").where("status = 'PASS'").select("cohort", "entity").distinct()


@query("c6_pending_work", "SELECT DISTINCT cohort, entity FROM v3 WHERE NOT EXISTS (SELECT 1 FROM v3 d WHERE d.cohort = v3.cohort AND d.entity = v3.entity AND d.status = 'FAILED')", "v3")
def c6(spark: SparkSession, sf: str) -> DataFrame:
    v3 = view(spark, sf, "v3")
    return pending(v3.select("cohort", "entity").distinct(), v3.where("status = 'FAILED'"), ["cohort", "entity"])


@query("c7_common_keys", """SELECT entity FROM (SELECT entity FROM v1 INTERSECT SELECT entity FROM v3 WHERE status = 'PASS'
INTERSECT SELECT CAST(user_id AS BIGINT) FROM events)""", "v1 v3")
def c7(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select(F.col("user_id").alias("entity"))
    return jn.common_keys([view(spark, sf, "v1"), view(spark, sf, "v3").where("status = 'PASS'"), ev], ["entity"])


_C8 = """
WITH o AS (SELECT * FROM (SELECT o_custkey AS entity, o_orderpriority AS stage, o_orderstatus AS grade,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders) WHERE rn = 1),
e AS (SELECT user_id AS entity, min(event_type) AS stage, max(event_type) AS source FROM events GROUP BY 1),
c AS (SELECT c_custkey AS entity, c_mktsegment AS cohort, CASE WHEN c_acctbal > 5000 THEN 'high' END AS grade FROM customer),
k AS (SELECT entity FROM o UNION SELECT entity FROM e UNION SELECT entity FROM c)
SELECT k.entity, coalesce(c.cohort, 'Not Reported') AS cohort, coalesce(o.stage, e.stage, 'Not Reported') AS stage,
  coalesce(c.grade, o.grade, 'Not Reported') AS grade, coalesce(e.source, 'Not Reported') AS source,
  c.entity IS NOT NULL AS clinical_available, o.entity IS NOT NULL AS bags_available, e.entity IS NOT NULL AS events_available
FROM k LEFT JOIN c USING (entity) LEFT JOIN o USING (entity) LEFT JOIN e USING (entity)"""


@query("c8_master_table", _C8)
def c8(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("grade"), "o_orderkey")
    o = best_row(o, ["entity"], [F.col("stage"), F.col("o_orderkey")]).drop("o_orderkey")
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("entity")).agg(F.min("event_type").alias("stage"), F.max("event_type").alias("source"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("cohort"), F.when(F.col("c_acctbal") > 5000, "high").alias("grade"))
    keys = jn.key_union(o, e, c, keys=["entity"])
    fields = ["cohort", "stage", "grade", "source"]
    m = jn.fill_by_priority(keys, [("clinical", c), ("bags", o), ("events", e)], ["entity"], fields)
    return m.select("entity", *[F.coalesce(f, F.lit("Not Reported")).alias(f) for f in fields], "clinical_available", "bags_available", "events_available")


@query("c9_dense_zero_fill", """
SELECT e.cohort, e.entity, c.priority AS cluster, (SELECT count(*) FROM v3 x WHERE x.entity = e.entity AND x.priority = c.priority) AS n
FROM (SELECT DISTINCT cohort, entity FROM v1) e, (SELECT DISTINCT priority FROM v3) c""", "v1 v3")
def c9(spark: SparkSession, sf: str) -> DataFrame:
    counts = view(spark, sf, "v3").groupBy("cohort", "entity", F.col("priority").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return jn.dense_counts(counts, view(spark, sf, "v1"), ["cohort", "entity"], "cluster", "n")


@query("c10_overlapping_name_join", "SELECT a.entity, a.cohort AS cohort_a, b.cohort AS cohort_b, a.score AS score_a, b.score AS score_b, b.y FROM (SELECT cohort, entity, value AS score FROM v1) a JOIN v6b b ON a.entity = b.entity", "v1 v6b")
def c10(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "v1").select("cohort", "entity", F.col("value").alias("score"))
    return jn.join_suffixed(a, view(spark, sf, "v6b").select("cohort", "entity", "score", "y"), ["entity"], ("_a", "_b"))


@query("c11_key_equality", """SELECT o_custkey AS entity, CAST(count(*) FILTER (WHERE s = 1) - count(*) FILTER (WHERE s = 2) AS BIGINT) AS difference
FROM (SELECT o_custkey, 1 AS s FROM orders UNION ALL SELECT c_custkey, 2 FROM customer) GROUP BY 1 HAVING count(*) FILTER (WHERE s = 1) <> count(*) FILTER (WHERE s = 2)""")
def c11(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"))
    return jn.key_difference(a, table(spark, sf, "customer").select(F.col("c_custkey").alias("entity")), ["entity"])


@query("c12_entity_endpoints", """
SELECT v1.cohort, v1.entity, coalesce(string_agg(DISTINCT v3.priority, ';' ORDER BY v3.priority), '') AS analysis_sets, max(v6.y) AS endpoint
FROM v1 LEFT JOIN v3 ON v1.entity = v3.entity AND v3.status = 'PASS' JOIN v6 ON v6.entity = v1.entity GROUP BY v1.cohort, v1.entity""", "v1 v3 v6")
def c12(spark: SparkSession, sf: str) -> DataFrame:
    sets = ag.sorted_labels(view(spark, sf, "v3").where("status = 'PASS'"), ["cohort", "entity"], "priority", "analysis_sets")
    base = view(spark, sf, "v6").select("cohort", "entity", F.col("y").alias("endpoint"))
    return base.join(sets, ["cohort", "entity"], "left").withColumn("analysis_sets", F.coalesce("analysis_sets", F.lit("")))
