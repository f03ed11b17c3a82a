"""Set algebra, upserts, grids and colour statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions.numeric import rounded
from cohortwise.operators import aggregates as ag
from cohortwise.operators import grid as gr
from cohortwise.operators import joins as jn
from cohortwise.operators import setops as so
from cohortwise.operators.selection import evenly_spaced
from cohortwise.plans.registry import query, r
from cohortwise.plans.views import table, view
from cohortwise.sources.tables import union_rows


@query("g1_union_frames", "SELECT c_custkey AS id, c_acctbal AS balance, NULL AS price FROM customer UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return union_rows(c, table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")))


@query("g2_keyed_upsert", "SELECT c_custkey AS id, CASE WHEN l.doc_id IS NULL THEN c_name ELSE 'doc ' || CAST(l.quality AS VARCHAR) END AS name FROM customer LEFT JOIN labels l ON l.doc_id = c_custkey UNION ALL SELECT doc_id, 'doc ' || CAST(quality AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT c_custkey FROM customer)")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc "), F.col("quality").cast("string")).alias("name"))
    return so.upsert(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), new, ["id"])


@query("g3_passing_everywhere", """SELECT feature FROM (SELECT cohort, feature, count(*) AS c FROM v2 GROUP BY 1, 2) JOIN (SELECT cohort, count(*) AS n FROM v1 GROUP BY 1) USING (cohort)
WHERE c / CAST(n AS DOUBLE) >= 0.70 GROUP BY feature HAVING count(*) = (SELECT count(DISTINCT cohort) FROM v1)""", "v1 v2")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    f = ag.observed_fraction(view(spark, sf, "v2"), view(spark, sf, "v1"), "cohort", "feature", "value")
    return so.passing_everywhere(f.withColumn("ok", F.col("observed_fraction") >= 0.70), "cohort", "feature", "ok", view(spark, sf, "v1"))


@query("g4_key_union", "SELECT o_custkey AS entity FROM orders UNION SELECT c_custkey FROM customer UNION SELECT user_id FROM events")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    return jn.key_union(table(spark, sf, "orders").select(F.col("o_custkey").alias("entity")), table(spark, sf, "customer").select(F.col("c_custkey").alias("entity")),
                        table(spark, sf, "events").select(F.col("user_id").alias("entity")), keys=["entity"])


@query("g5_missing_required", "SELECT c_custkey AS entity FROM customer EXCEPT SELECT user_id FROM events")
def g5(spark: SparkSession, sf: str) -> DataFrame:
    return so.missing_required(table(spark, sf, "customer").select(F.col("c_custkey").alias("entity")), table(spark, sf, "events").select(F.col("user_id").alias("entity")), ["entity"])


@query("g6_name_universe", "SELECT upper(p_brand) AS feature FROM part UNION SELECT upper(p_type) FROM part UNION SELECT upper(p_name) FROM part")
def g6(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return so.universe((p, "p_brand"), (p, "p_type"), (p, "p_name"))


@query("g7_set_membership", """SELECT * FROM (SELECT cohort, case_id, unnest([CASE WHEN status = 'F' THEN 'set_f' END, CASE WHEN price > 200000 THEN 'set_large' END,
CASE WHEN status = 'F' AND price > 200000 THEN 'set_both' END, CASE WHEN stage IS NOT NULL THEN 'set_staged' END, CASE WHEN priority = '5-LOW' THEN 'set_low' END]) AS set_name FROM v11) WHERE set_name IS NOT NULL""", "v11")
def g7(spark: SparkSession, sf: str) -> DataFrame:
    f, large = F.col("status") == "F", F.col("price") > 200000
    rules = {"set_f": f, "set_large": large, "set_both": f & large, "set_staged": F.col("stage").isNotNull(), "set_low": F.col("priority") == "5-LOW"}
    return jn.label_rows(view(spark, sf, "v11"), rules, ["cohort", "case_id"])


@query("g8_grid_step", """SELECT p_partkey, CAST(round_even(128e0 / res, 0) AS BIGINT) AS step FROM (SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size / 40e0 END, 10e0 / (p_size % 40 + 1)) AS res FROM part)""")
def g8(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    stated = F.when(size % 3 == 0, (size / F.lit(40.0)).cast("string")).otherwise("n/a")
    return table(spark, sf, "part").select("p_partkey", gr.grid_step(gr.native_resolution(stated, (size % 40 + 1).cast("string"))).alias("step"))


_CELLS = """SELECT bag, CAST(floor(x / 256e0) AS BIGINT) AS cell_x, CAST(floor(y / 2048e0) AS BIGINT) AS cell_y, avg(CASE WHEN occupancy >= 0.6 THEN 1e0 ELSE 0e0 END) AS coverage, count(*) AS n_points
FROM v4 GROUP BY 1, 2, 3 HAVING avg(CASE WHEN occupancy >= 0.6 THEN 1e0 ELSE 0e0 END) >= 0.70"""


@query("g9_covered_cells", f"SELECT bag, cell_x, cell_y, {r('coverage')} AS coverage, n_points FROM ({_CELLS})", "v4")
def g9(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v4").withColumn("ys", F.col("y") / 8)
    return gr.covered_cells(v, ["bag"], "x", "ys", F.col("occupancy") >= 0.6, F.lit(256.0)).withColumn("coverage", rounded(F.col("coverage")))


@query("g9_capped_cells", f"""WITH c AS ({_CELLS}), t AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY cell_y, cell_x) - 1 AS i, count(*) OVER (PARTITION BY bag) AS n FROM c),
s AS (SELECT DISTINCT bag, CAST(round_even(j * ((n - 1) / 19e0), 0) AS BIGINT) AS i FROM (SELECT DISTINCT bag, n FROM t), (SELECT unnest(range(0, 20)) AS j))
SELECT t.bag, cell_x, cell_y FROM t JOIN s ON t.bag = s.bag AND t.i = s.i""", "v4")
def g9_capped(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v4").withColumn("ys", F.col("y") / 8)
    c = gr.covered_cells(v, ["bag"], "x", "ys", F.col("occupancy") >= 0.6, F.lit(256.0))
    return evenly_spaced(c, ["bag"], "cell_y", [F.col("cell_y"), F.col("cell_x")], 20, tie_key="cell_x").select("bag", "cell_x", "cell_y")


@query("g10_colour_statistics", f"""SELECT item, {r('avg(CASE WHEN least(r, g, b) > 240 THEN 1e0 ELSE 0e0 END)')} AS white_fraction, {r('avg(CASE WHEN (r + g + b) / 3e0 < 20 THEN 1e0 ELSE 0e0 END)')} AS dark_fraction,
{r('avg(greatest(r, g, b) - least(r, g, b))')} AS mean_saturation, {r('avg(CASE WHEN (r+g+b)/3e0 < 235 AND (greatest(r,g,b)-least(r,g,b) > 8 OR (r+g+b)/3e0 < 220) THEN 1e0 ELSE 0e0 END)')} AS foreground_fraction FROM v10 GROUP BY 1""", "v10")
def g10(spark: SparkSession, sf: str) -> DataFrame:
    c = gr.colour_statistics(view(spark, sf, "v10"), ["item"])
    return c.select("item", *[rounded(F.col(x)).alias(x) for x in ("white_fraction", "dark_fraction", "mean_saturation", "foreground_fraction")])


@query("g11_quality_rollup", f"""SELECT bag, count(*) AS n_items, count(*) FILTER (WHERE s = 'PASS') AS pass_items, count(*) FILTER (WHERE s = 'WARN') AS warn_items, count(*) FILTER (WHERE s = 'FAILED') AS failed_items,
{r("avg(score) FILTER (WHERE s <> 'FAILED')", 4)} AS mean_score, {r("avg(quantity) FILTER (WHERE s <> 'FAILED')")} AS mean_quantity, count(*) FILTER (WHERE s = 'PASS') = 0 AS artifact_like
FROM (SELECT *, CASE WHEN occupancy >= 0.8 THEN 'PASS' WHEN occupancy >= 0.6 THEN 'WARN' ELSE 'FAILED' END AS s FROM v4) GROUP BY 1""", "v4")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v4").withColumn("status", F.when(F.col("occupancy") >= 0.8, "PASS").when(F.col("occupancy") >= 0.6, "WARN").otherwise("FAILED"))
    q = gr.quality_rollup(v, ["bag"], "status", ["score", "quantity"])
    return q.withColumn("mean_score", rounded(F.col("mean_score"), 4)).withColumn("mean_quantity", rounded(F.col("mean_quantity")))
