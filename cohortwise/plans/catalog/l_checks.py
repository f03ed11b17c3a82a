"""Check lists, gates and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions.numeric import rounded
from cohortwise.operators import checks as ck
from cohortwise.operators import scoring as sc
from cohortwise.plans.registry import query, r
from cohortwise.plans.views import table, view
from cohortwise.session import materialize


def _checks(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count(F.lit(1))
    return ck.check_rows(view(spark, sf, "v3"), {
        "rows_present": (n > 0, n, "FAIL"),
        "sizes_known": (F.count("size") == n, F.count("size"), "FAIL"),
        "all_passing": (F.count_if(F.col("status") != "PASS") == 0, F.count_if(F.col("status") != "PASS"), "WARN"),
        "cohorts": (F.count_distinct("cohort") == 6, F.count_distinct("cohort"), "FAIL")})


_L1 = """SELECT 'rows_present' AS "check", CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END AS status, '{"value":"' || count(*) || '"}' AS details FROM v3
UNION ALL SELECT 'sizes_known', CASE WHEN count(size) = count(*) THEN 'PASS' ELSE 'FAIL' END, '{"value":"' || count(size) || '"}' FROM v3
UNION ALL SELECT 'all_passing', CASE WHEN count(*) FILTER (WHERE status <> 'PASS') = 0 THEN 'PASS' ELSE 'WARN' END, '{"value":"' || count(*) FILTER (WHERE status <> 'PASS') || '"}' FROM v3
UNION ALL SELECT 'cohorts', CASE WHEN count(DISTINCT cohort) = 6 THEN 'PASS' ELSE 'FAIL' END, '{"value":"' || count(DISTINCT cohort) || '"}' FROM v3"""


@query("l1_check_list", _L1, "v3")
def l1(spark: SparkSession, sf: str) -> DataFrame:
    return _checks(spark, sf)


@query("l1_verdict", f"""WITH c AS ({_L1}) SELECT count(*) FILTER (WHERE status = 'PASS') AS pass_count, count(*) FILTER (WHERE status = 'WARN') AS warn_count, count(*) FILTER (WHERE status = 'FAIL') AS fail_count,
CASE WHEN count(*) FILTER (WHERE status = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c""", "v3")
def l1_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return ck.verdict(_checks(spark, sf))


@query("l2_gated_selection", "SELECT cohort, count(*) AS n FROM v1 GROUP BY 1", "v1")
def l2(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v1")
    n = F.count(F.lit(1))
    ck.require_pass(ck.verdict(ck.check_rows(v, {"rows": (n > 0, n, "FAIL"), "values": (F.count("value") == n, n, "FAIL")})))
    return v.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


@query("l2_target_choice", """SELECT factor AS target FROM (SELECT factor, avg(r) AS m FROM (SELECT v2.cohort, feature AS factor, corr(value, y) AS r FROM v2 JOIN v6 ON v6.entity = v2.entity GROUP BY 1, 2) GROUP BY 1) ORDER BY m DESC, factor LIMIT 1""", "v2 v6")
def l2_target(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "v2").join(view(spark, sf, "v6").select("entity", "y"), "entity")
    tests = t.groupBy("cohort", F.col("feature").alias("factor")).agg(F.corr("value", F.col("y").cast("double")).alias("r"), F.lit(1.0).alias("p"))
    return spark.createDataFrame([(ck.choose_target(sc.direction_table(materialize(tests, "tests"))),)], "target string")


@query("l3_expected_counts", """SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS observed, coalesce(b.e, 0) AS expected, CASE WHEN coalesce(a.n, 0) = coalesce(b.e, 0) THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT n_nationkey + 1 AS k, 60::BIGINT AS e FROM nation) b ON a.k = b.k""")
def l3(spark: SparkSession, sf: str) -> DataFrame:
    want = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("nation"), F.lit(60).cast("bigint").alias("expected"))
    return ck.expected_counts(table(spark, sf, "customer").withColumnRenamed("c_nationkey", "nation"), ["nation"], want)


_Z = "SELECT cohort, entity, upper(feature) AS feature, coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0) AS z FROM v2 WINDOW w AS (PARTITION BY cohort, feature)"


@query("l4_matrix_health", f"""WITH z AS ({_Z}), f AS (SELECT cohort, feature, count(*) AS n, abs(avg(z)) AS m, min(z) AS lo, max(z) AS hi FROM z GROUP BY 1, 2)
SELECT count(*) AS features, sum(n)::BIGINT AS cells, 0::BIGINT AS non_finite, count(*) FILTER (WHERE lo = hi) AS constant_features, {r('max(m)')} AS max_abs_mean, {r('min(lo)')} AS min_value, {r('quantile_cont(m, 0.95)')} AS p95_abs_mean FROM f""", "v2")
def l4(spark: SparkSession, sf: str) -> DataFrame:
    h = ck.matrix_health(materialize(sc.standardised(view(spark, sf, "v2")), "z"), ["cohort", "feature"], "z")
    for c in ("max_abs_mean", "min_value", "p95_abs_mean"):
        h = h.withColumn(c, rounded(F.col(c)))
    return h


@query("l6_manifest_completeness", f"""SELECT cohort, count(*) AS expected_files, count(*) FILTER (WHERE status <> 'FAILED') AS actual_files, {r("coalesce(sum(CAST(size AS DECIMAL(18,2))) FILTER (WHERE status <> 'FAILED'), 0) / 7e9")} AS scaled_bytes,
{r("count(*) FILTER (WHERE status <> 'FAILED') / CAST(count(*) AS DOUBLE)")} AS share, CASE WHEN count(*) FILTER (WHERE status <> 'FAILED') = 0 THEN 'missing' WHEN count(*) FILTER (WHERE status <> 'FAILED') >= count(*) THEN 'downloaded' ELSE 'partial' END AS status FROM v3 GROUP BY 1""", "v3")
def l6(spark: SparkSession, sf: str) -> DataFrame:
    m = ck.manifest_completeness(view(spark, sf, "v3").withColumn("size", F.col("size").cast("decimal(18,2)")), ["cohort"], F.col("status") != "FAILED", F.col("size"))
    return m.select("cohort", "expected_files", "actual_files", rounded(F.col("bytes") / 7e9).alias("scaled_bytes"), rounded(F.col("share")).alias("share"), "status")


@query("l7_scope_status", """SELECT cohort, CASE WHEN d = 0 THEN 'not_run_' WHEN d < n THEN 'partial_' ELSE 'complete_' END || lower(cohort) AS scope_status FROM (SELECT cohort, count(*) AS n, count(*) FILTER (WHERE status = 'PASS') AS d FROM v3 GROUP BY 1)""", "v3")
def l7(spark: SparkSession, sf: str) -> DataFrame:
    g = view(spark, sf, "v3").groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "PASS").alias("d"))
    return g.select("cohort", ck.scope_status(F.lower("cohort"), F.col("d"), F.col("n")).alias("scope_status"))


@query("l8_verdict_refresh", f"""WITH c AS ({_L1}), u AS (SELECT "check", CASE WHEN "check" = 'cohorts' THEN 'PASS' ELSE status END AS status FROM c UNION ALL SELECT 'extension', 'WARN')
SELECT count(*) FILTER (WHERE status = 'PASS') AS pass_count, count(*) FILTER (WHERE status = 'WARN') AS warn_count, count(*) FILTER (WHERE status = 'FAIL') AS fail_count,
CASE WHEN count(*) FILTER (WHERE status = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM u""", "v3")
def l8(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count_distinct("cohort")
    new = ck.check_rows(view(spark, sf, "v3"), {"cohorts": (n == 5, n, "FAIL"), "extension": (n == 9, n, "WARN")})
    return ck.verdict(ck.refresh_checks(_checks(spark, sf), new))
