"""Tests, metrics and meta-analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions.numeric import rounded
from cohortwise.operators import consensus as cs
from cohortwise.operators import stats as st
from cohortwise.operators.aggregates import vector_mean
from cohortwise.operators.selection import top_per_group
from cohortwise.operators.vectors import best_match
from cohortwise.plans.registry import query, r
from cohortwise.plans.views import table, view
from cohortwise.session import materialize


def _r(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, rounded(F.col(c)))
    return df


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(view(spark, sf, "v13"), "pairs")


def _t_p(source: str, keys: str, t: str, dof: str) -> str:
    """SQL for two-sided t p-values: Simpson's rule over the density from 0 to abs(t)."""
    return f"""(SELECT {keys}, any_value(tt) AS t, CASE WHEN any_value(tt) IS NOT NULL THEN greatest(0, 1 - 2 * any_value(c) * any_value(abs(tt)) / 12000 * sum(w * pow(1 + (i * abs(tt) / 4000) * (i * abs(tt) / 4000) / dd, -(dd + 1) / 2))) END AS p
FROM (SELECT {keys}, {t} AS tt, {dof} AS dd, exp(lgamma(({dof} + 1) / 2e0) - lgamma({dof} / 2e0)) / sqrt(pi() * {dof}) AS c FROM {source}),
     (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM (SELECT unnest(range(0, 4001)) AS i)) GROUP BY {keys})"""


def _bh(source: str, family: str) -> str:
    """SQL for Benjamini-Hochberg q within a family; rows without p have none."""
    part = f"PARTITION BY {family} " if family else ""
    return f"""(SELECT *, CASE WHEN p IS NOT NULL THEN least(1e0, min(p * m / rk) OVER ({part}ORDER BY p DESC NULLS LAST ROWS UNBOUNDED PRECEDING)) END AS q
FROM (SELECT *, count(p) OVER ({part}) AS m, row_number() OVER ({part}ORDER BY p NULLS LAST) AS rk FROM {source}))"""


#: SQL for the upper tail of the normal deviate z: half minus a series of positive terms.
_NORMAL = "CASE WHEN z IS NULL THEN NULL WHEN abs(z) > 8 THEN CASE WHEN z > 0 THEN 0e0 ELSE 1e0 END ELSE 0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda k: z * exp(k * ln(greatest(z * z, 1e-300)) - (lgamma(2 * k + 2) - k * ln(2e0) - lgamma(k + 1))))) END"


_RK = """ranks AS (SELECT cohort, feature, rank() OVER (PARTITION BY cohort, feature ORDER BY value) + (count(*) OVER (PARTITION BY cohort, feature, value) - 1) / 2e0 AS ra,
rank() OVER (PARTITION BY cohort, feature ORDER BY pred) + (count(*) OVER (PARTITION BY cohort, feature, pred) - 1) / 2e0 AS rb FROM v13)"""


@query("i1_pearson", f"SELECT cohort, feature, count(*) AS n, {r('corr(value, pred)')} AS pearson FROM v13 GROUP BY 1, 2", "v13")
def i1(spark: SparkSession, sf: str) -> DataFrame:
    return _r(st.pearson(view(spark, sf, "v13"), ["cohort", "feature"], "value", "pred"), "pearson")


@query("i2_spearman", f"WITH {_RK} SELECT cohort, feature, count(*) AS n, {r('corr(ra, rb)')} AS spearman FROM ranks GROUP BY 1, 2", "v13")
def i2(spark: SparkSession, sf: str) -> DataFrame:
    return _r(st.spearman(_pairs(spark, sf), ["cohort", "feature"], "value", "pred"), "spearman")


@query("i3_error_metrics", f"""SELECT cohort, feature, count(*) AS n, {r('avg((value - pred) * (value - pred)) / 1e9', 9)} AS mse, {r('sqrt(avg((value - pred) * (value - pred))) / 7')} AS rmse,
{r('avg(abs(value - pred)) / 7')} AS mae, {r('1 - sum((value - pred) * (value - pred)) / nullif(var_pop(value) * count(*), 0)')} AS r2 FROM v13 GROUP BY 1, 2""", "v13")
def i3(spark: SparkSession, sf: str) -> DataFrame:
    m = st.error_metrics(view(spark, sf, "v13"), ["cohort", "feature"], "value", "pred")
    return m.select("cohort", "feature", "n", rounded(F.col("mse") / 1e9, 9).alias("mse"), rounded(F.col("rmse") / 7).alias("rmse"), rounded(F.col("mae") / 7).alias("mae"), rounded(F.col("r2")).alias("r2"))


@query("i4_roc_auc", f"""WITH k AS (SELECT cohort, y, rank() OVER (PARTITION BY cohort ORDER BY score) + (count(*) OVER (PARTITION BY cohort, score) - 1) / 2e0 AS rk FROM v6b)
SELECT cohort, count(*) AS n, sum(y)::BIGINT AS events, {r('(sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2e0) / nullif(CAST(sum(y) AS DOUBLE) * (count(*) - sum(y)), 0)')} AS auc FROM k GROUP BY 1""", "v6b")
def i4(spark: SparkSession, sf: str) -> DataFrame:
    return _r(st.roc_auc(view(spark, sf, "v6b"), ["cohort"], "y", "score"), "auc")


@query("i5_average_precision", f"""WITH g AS (SELECT cohort, score, sum(y) AS pos, count(*) AS c FROM v6b GROUP BY 1, 2),
k AS (SELECT cohort, pos, sum(pos) OVER (PARTITION BY cohort) AS tp_all, sum(pos) OVER w AS tp, sum(c) OVER w AS fl FROM g WINDOW w AS (PARTITION BY cohort ORDER BY score DESC))
SELECT cohort, {r('sum(CAST(pos AS DOUBLE) / nullif(tp_all, 0) * tp / fl)')} AS average_precision FROM k GROUP BY 1""", "v6b")
def i5(spark: SparkSession, sf: str) -> DataFrame:
    return _r(st.average_precision(view(spark, sf, "v6b"), ["cohort"], "y", "score"), "average_precision")


@query("i6_brier_calibration", f"""SELECT cohort, count(*) AS n, {r('avg((p - y) * (p - y))')} AS brier, {r('avg(y)')} AS observed_event_rate, {r('avg(p)')} AS predicted_event_rate, {r('sum(p) / greatest(sum(y), 1e-8)')} AS e_over_o
FROM (SELECT cohort, y, least(score / 20000, 1e0) AS p FROM v6b) GROUP BY 1""", "v6b")
def i6(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v6b").withColumn("p", F.least(F.col("score") / 20000, F.lit(1.0)))
    return _r(st.calibration_sums(v, ["cohort"], "y", "p"), "brier", "observed_event_rate", "predicted_event_rate", "e_over_o")


def _classed(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v2").join(view(spark, sf, "v6").select("entity", "y"), "entity")


_W = "SELECT v2.cohort, feature, value, y FROM v2 JOIN v6 ON v6.entity = v2.entity"


@query("i7_welch_associations", f"""WITH t AS ({_W}), g AS (SELECT cohort, feature, count(*) AS n, count(*) FILTER (WHERE y = 1) AS events, count(*) FILTER (WHERE y = 0) AS nonevents,
avg(value) FILTER (WHERE y = 1) AS m1, avg(value) FILTER (WHERE y = 0) AS m0, var_samp(value) FILTER (WHERE y = 1) / count(*) FILTER (WHERE y = 1) AS a, var_samp(value) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 0) AS b, corr(value, y) AS r FROM t GROUP BY 1, 2)
SELECT cohort, feature, n, events, nonevents, CASE WHEN ok THEN {r('(m1 - m0) / 7')} END AS mean_diff, CASE WHEN ok THEN {r('r')} END AS r, CASE WHEN ok THEN {r('(m1 - m0) / sqrt(a + b)')} END AS t,
CASE WHEN ok THEN {r('(a + b) * (a + b) / (a * a / (events - 1) + b * b / (nonevents - 1))')} END AS dof FROM (SELECT *, n >= 10 AND events >= 3 AND nonevents >= 3 AS ok FROM g)""", "v2 v6")
def i7(spark: SparkSession, sf: str) -> DataFrame:
    t = st.two_class_tests(_classed(spark, sf), ["cohort", "feature"], "value", "y").withColumn("mean_diff", F.col("mean_diff") / 7)
    return _r(t.select("cohort", "feature", "n", "events", "nonevents", "mean_diff", "r", "t", "dof"), "mean_diff", "r", "t", "dof")


@query("i7_welch_tests_with_q", f"""WITH w AS ({_W}), g AS (SELECT cohort, feature, count(*) AS n, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0,
avg(value) FILTER (WHERE y = 1) - avg(value) FILTER (WHERE y = 0) AS d, var_samp(value) FILTER (WHERE y = 1) / count(*) FILTER (WHERE y = 1) AS a, var_samp(value) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 0) AS b FROM w GROUP BY 1, 2),
k AS (SELECT cohort, feature, CASE WHEN n >= 10 AND n1 >= 3 AND n0 >= 3 THEN d / sqrt(a + b) END AS st, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)) AS dof FROM g),
pv AS {_t_p('k', 'cohort, feature', 'st', 'dof')} SELECT cohort, feature, {r('t')} AS t, {r('p')} AS p, {r('q')} AS q FROM {_bh('pv', 'cohort')}""", "v2 v6")
def i7_q(spark: SparkSession, sf: str) -> DataFrame:
    t = st.two_class_tests(_classed(spark, sf), ["cohort", "feature"], "value", "y", family=["cohort"])
    return _r(t.select("cohort", "feature", "t", "p", "q"), "t", "p", "q")


@query("i8_point_biserial", f"SELECT cohort, count(*) AS n, {r('corr(score, y)')} AS r FROM v6 GROUP BY 1", "v6")
def i8(spark: SparkSession, sf: str) -> DataFrame:
    return _r(st.pearson(view(spark, sf, "v6"), ["cohort"], "score", "y", "r"), "r")


_MW = """WITH k AS (SELECT cohort, y, rank() OVER (PARTITION BY cohort ORDER BY {v}) + (count(*) OVER (PARTITION BY cohort, {v}) - 1) / 2e0 AS rk FROM {t}),
ti AS (SELECT cohort, sum(c * c * c - c) AS tie FROM (SELECT cohort, CAST(count(*) AS DOUBLE) AS c FROM {t} GROUP BY cohort, {v}) GROUP BY 1),
g AS (SELECT cohort, CAST(sum(y) AS DOUBLE) AS n1, CAST(count(*) - sum(y) AS DOUBLE) AS n0, sum(rk * y) AS rs FROM k GROUP BY 1),
u AS (SELECT g.*, tie, rs - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - tie / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM g JOIN ti USING (cohort))
"""


@query("i9_mann_whitney", _MW.format(v="score", t="v6b") + f"SELECT cohort, n1::BIGINT AS n1, n0::BIGINT AS n0, CASE WHEN n1 > 0 AND n0 > 0 THEN u END AS u, CASE WHEN n1 > 0 AND n0 > 0 THEN {r('(abs(u - n1 * n0 / 2) - 0.5) / sd')} END AS z FROM u", "v6b")
def i9(spark: SparkSession, sf: str) -> DataFrame:
    return _r(st.mann_whitney(view(spark, sf, "v6b"), ["cohort"], "score", "y", with_p=False), "z")


@query("i9_mann_whitney_less", _MW.format(v="quantity", t="q").replace("WITH k", "WITH q AS (SELECT cohort, quantity, CASE WHEN occupancy >= 0.7 THEN 1 ELSE 0 END AS y FROM v4), k") + f"SELECT cohort, n1::BIGINT AS n1, n0::BIGINT AS n0, u, {r('(n1 * n0 / 2 - u - 0.5) / sd')} AS z FROM u", "v4")
def i9_less(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v4").select("cohort", "quantity", (F.col("occupancy") >= 0.7).cast("int").alias("y"))
    return _r(st.mann_whitney(v, ["cohort"], "quantity", "y", "less", with_p=False), "z")


@query("i9_mann_whitney_with_p", _MW.format(v="score", t="v6b") + f""", t AS (SELECT *, CASE WHEN n1 > 0 AND n0 > 0 THEN greatest((abs(u - n1 * n0 / 2) - 0.5) / sd, 0) END AS z FROM u)
SELECT cohort, n1::BIGINT AS n1, n0::BIGINT AS n0, CASE WHEN z IS NOT NULL THEN u END AS u, {r('2 * (' + _NORMAL + ')')} AS p, CASE WHEN z IS NOT NULL THEN 'large' END AS p_method FROM t""", "v6b")
def i9_p(spark: SparkSession, sf: str) -> DataFrame:
    return _r(st.mann_whitney(view(spark, sf, "v6b"), ["cohort"], "score", "y", method="large").select("cohort", "n1", "n0", "u", "p", "p_method"), "p")


# The twelve best customers of each country and segment, high spenders against the rest: small samples without ties.
_FEW = """few AS (SELECT * FROM (SELECT nation, entity, value, row_number() OVER (PARTITION BY nation ORDER BY value DESC, entity) AS rn, CASE WHEN entity % 3 = 0 THEN 1 ELSE 0 END AS y FROM v1) WHERE rn <= 12)"""


@query("i9_mann_whitney_exact", f"""WITH {_FEW},
k AS (SELECT nation, y, rank() OVER (PARTITION BY nation ORDER BY value) AS rk FROM few),
g AS (SELECT nation, sum(y)::BIGINT AS n1, (count(*) - sum(y))::BIGINT AS n0, sum(rk * y)::DOUBLE AS rs, max(c) AS c FROM k JOIN (SELECT nation, max(c) AS c FROM (SELECT nation, count(*) AS c FROM few GROUP BY nation, value) GROUP BY 1) USING (nation) GROUP BY 1),
u AS (SELECT *, rs - n1 * (n1 + 1) / 2e0 AS u FROM g),
draws AS (SELECT nation, n1, n0, unnest(range(0, (1 << (n1 + n0))::BIGINT)) AS s FROM u WHERE n1 > 0 AND n0 > 0 AND c = 1),
sums AS (SELECT nation, list_sum(list_transform(range(0, n1 + n0), lambda i: CASE WHEN (s >> i) & 1 = 1 THEN i + 1 ELSE 0 END)) - n1 * (n1 + 1) / 2 AS us FROM draws WHERE bit_count(s) = n1),
tails AS (SELECT nation, count(*) FILTER (WHERE us <= u) / CAST(count(*) AS DOUBLE) AS low, count(*) FILTER (WHERE us >= u) / CAST(count(*) AS DOUBLE) AS high FROM sums JOIN u USING (nation) GROUP BY 1)
SELECT nation, n1, n0, u, {r('least(1, 2 * least(low, high))')} AS p, {r('low')} AS p_less, 'exact' AS p_method FROM u JOIN tails USING (nation)""", "v1")
def i9_exact(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v1")
    best = top_per_group(v.select("nation", "entity", "value"), ["nation"], [F.col("value").desc(), F.col("entity")], 12, None).withColumn("y", (F.col("entity") % 3 == 0).cast("int"))
    tied = best.groupBy("nation", "value").count().where("count > 1").select("nation").distinct()
    best = materialize(best.join(tied, "nation", "left_anti"))
    two = st.mann_whitney(best, ["nation"], "value", "y").where("u IS NOT NULL")
    less = st.mann_whitney(best, ["nation"], "value", "y", "less").select("nation", F.col("p").alias("p_less"))
    return _r(two.join(less, "nation").select("nation", "n1", "n0", "u", "p", "p_less", "p_method"), "p", "p_less")


_WX = """WITH d AS (SELECT cohort, feature, value - 2 * pred AS d FROM v13 WHERE value - 2 * pred <> 0), k AS (SELECT cohort, feature, d, rank() OVER (PARTITION BY cohort, feature ORDER BY abs(d)) + (count(*) OVER (PARTITION BY cohort, feature, abs(d)) - 1) / 2e0 AS rk FROM d),
ti AS (SELECT cohort, feature, sum(c * c * c - c) AS tie FROM (SELECT cohort, feature, CAST(count(*) AS DOUBLE) AS c FROM d GROUP BY cohort, feature, abs(d)) GROUP BY 1, 2),
g AS (SELECT cohort, feature, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w FROM k GROUP BY 1, 2)
"""


@query("i10_wilcoxon_signed_rank", _WX + f"SELECT g.cohort, g.feature, n, w AS w_plus, {r('(w - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - tie / 48)')} AS z FROM g JOIN ti ON ti.cohort = g.cohort AND ti.feature = g.feature", "v13")
def i10(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf).withColumn("p2", 2 * F.col("pred"))
    return _r(st.wilcoxon_greater(p, ["cohort", "feature"], "value", "p2", with_p=False), "z")


@query("i10_wilcoxon_with_p", _WX + f""", n AS (SELECT cohort, feature, count(*) AS pairs FROM v13 GROUP BY 1, 2), t AS (SELECT g.cohort, g.feature, n, w, tie, pairs, (w - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS z FROM g JOIN ti ON ti.cohort = g.cohort AND ti.feature = g.feature JOIN n ON n.cohort = g.cohort AND n.feature = g.feature)
SELECT cohort, feature, n, w AS w_plus, {r(_NORMAL)} AS p, 'large' AS p_method FROM t WHERE n > 50""", "v13")
def i10_p(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf).withColumn("p2", 2 * F.col("pred"))
    return _r(st.wilcoxon_greater(p, ["cohort", "feature"], "value", "p2").where("n > 50").select("cohort", "feature", "n", "w_plus", "p", "p_method"), "p")


@query("i10_wilcoxon_exact", f"""WITH d AS (SELECT nation, value - 4000 AS d FROM (SELECT nation, value, row_number() OVER (PARTITION BY nation ORDER BY value DESC, entity) AS rn FROM v1) WHERE rn <= 14 AND value <> 4000),
k AS (SELECT nation, d, rank() OVER (PARTITION BY nation ORDER BY abs(d)) + (count(*) OVER (PARTITION BY nation, abs(d)) - 1) / 2e0 AS rk FROM d),
g AS (SELECT nation, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus, list(rk ORDER BY rk) AS rks FROM k GROUP BY 1),
s AS (SELECT nation, w_plus, list_sum(list_transform(range(0, n), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN rks[i + 1] ELSE 0 END)) AS ws FROM (SELECT *, unnest(range(0, (1 << n)::BIGINT)) AS m FROM g WHERE n >= 3))
SELECT nation, n, g.w_plus, {r('p')} AS p, 'exact' AS p_method FROM g JOIN (SELECT nation, avg(CASE WHEN ws >= w_plus THEN 1e0 ELSE 0e0 END) AS p FROM s GROUP BY 1) USING (nation)""", "v1")
def i10_exact(spark: SparkSession, sf: str) -> DataFrame:
    best = top_per_group(view(spark, sf, "v1").select("nation", "entity", "value"), ["nation"], [F.col("value").desc(), F.col("entity")], 14, None)
    w = st.wilcoxon_greater(best.withColumn("zero", F.lit(4000.0)), ["nation"], "value", "zero", method="exact")
    return _r(w.where("n >= 3").select("nation", "n", "w_plus", "p", "p_method"), "p")


@query("i11_count_enrichment", f"""WITH t AS (SELECT line AS cluster, score > 60000 AS top FROM v4), g AS (SELECT cluster, count(*) FILTER (WHERE top) AS a, count(*) FILTER (WHERE NOT top) AS c FROM t GROUP BY 1)
SELECT cluster, a, (sum(a) OVER () - a)::BIGINT AS b, c, (sum(c) OVER () - c)::BIGINT AS d, {r('CAST(a AS DOUBLE) * (sum(c) OVER () - c) / nullif(CAST(sum(a) OVER () - a AS DOUBLE) * c, 0)')} AS odds_ratio FROM g""", "v4")
def i11(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v4").select(F.col("line").alias("cluster"), (F.col("score") > 60000).alias("top"))
    return _r(st.count_enrichment(v, "cluster", "top", with_p=False), "odds_ratio")


@query("i11_fisher_tests_with_q", f"""WITH t AS (SELECT line AS cluster, score > 60000 AS top FROM v4), g AS (SELECT cluster, count(*) FILTER (WHERE top) AS a, count(*) FILTER (WHERE NOT top) AS c FROM t GROUP BY 1),
f AS (SELECT cluster, a, (sum(a) OVER () - a)::BIGINT AS b, c, (sum(c) OVER () - c)::BIGINT AS d FROM g),
h AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS k FROM f),
l AS (SELECT *, -lgamma(k + 1e0) - lgamma(a + b - k + 1e0) - lgamma(a + c - k + 1e0) - lgamma(d - a + k + 1e0) AS lw FROM h),
m AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY cluster)) AS w FROM l), o AS (SELECT cluster, w AS wo FROM m WHERE k = a),
pv AS (SELECT cluster, a, b, c, d, least(1e0, sum(CASE WHEN w <= wo * (1 + 1e-7) THEN w ELSE 0 END) / sum(w)) AS p FROM m JOIN o USING (cluster) GROUP BY ALL)
SELECT cluster, a, b, c, d, {r('p')} AS p, {r('q')} AS q FROM {_bh('pv', '')}""", "v4")
def i11_q(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v4").select(F.col("line").alias("cluster"), (F.col("score") > 60000).alias("top"))
    return _r(st.count_enrichment(v, "cluster", "top").drop("odds_ratio"), "p", "q")


@query("i12_sign_share", f"SELECT cohort, count(*) AS n, count(*) FILTER (WHERE value > 0) AS n_positive, {r('count(*) FILTER (WHERE value > 0) / CAST(count(*) AS DOUBLE)')} AS share_positive FROM v1 GROUP BY 1", "v1")
def i12(spark: SparkSession, sf: str) -> DataFrame:
    return _r(st.sign_share(view(spark, sf, "v1"), ["cohort"], "value", with_p=False), "share_positive")


@query("i12_sign_test", f"""WITH g AS (SELECT cohort, count(*) AS n, count(*) FILTER (WHERE value > 4500) AS x FROM v1 GROUP BY 1), k AS (SELECT *, unnest(range(x, n + 1)) AS k FROM g)
SELECT cohort, n, x AS n_positive, {r('sum(exp(lgamma(n + 1e0) - lgamma(k + 1e0) - lgamma(n - k + 1e0) - n * ln(2e0)))')} AS p FROM k GROUP BY ALL""", "v1")
def i12_p(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v1").withColumn("over", F.col("value") - 4500)
    return _r(st.sign_share(v, ["cohort"], "over").select("cohort", "n", "n_positive", "p"), "p")


@query("i13_null_summary", f"""WITH o AS (SELECT cohort, avg(value) AS observed FROM v1 GROUP BY 1), u AS (SELECT cohort, nation, avg(value) AS v FROM v1 GROUP BY 1, 2)
SELECT o.cohort, {r('observed')} AS observed, count(*) AS n_null, {r('avg(v)')} AS null_mean, {r('stddev_samp(v)')} AS null_sd, {r('quantile_cont(v, 0.95)')} AS null_p95, {r('(1e0 + count(*) FILTER (WHERE v >= observed)) / (count(*) + 1)')} AS empirical_p,
{r('observed - avg(v)')} AS difference, CASE WHEN observed > quantile_cont(v, 0.95) AND (1e0 + count(*) FILTER (WHERE v >= observed)) / (count(*) + 1) <= 0.05 THEN 'PASS' ELSE 'WARN' END AS status FROM o JOIN u USING (cohort) GROUP BY o.cohort, observed""", "v1")
def i13(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v1")
    obs = v.groupBy("cohort").agg(F.avg("value").alias("obs"))
    null = materialize(v.groupBy("cohort", "nation").agg(F.avg("value").alias("v")))
    return _r(st.null_summary(obs, null, ["cohort"], "obs", "v"), "observed", "null_mean", "null_sd", "null_p95", "empirical_p", "difference")


@query("i15_adjusted_rand", f"""WITH c AS (SELECT cohort, a.label AS la, b.label AS lb, count(*) AS c FROM (SELECT * FROM v14 WHERE start = 0) a JOIN (SELECT entity, label FROM v14 WHERE start = 3) b USING (entity) GROUP BY 1, 2, 3),
s AS (SELECT cohort, sum(c * (c - 1) / 2e0) AS s, sum(c) AS n FROM c GROUP BY 1), x AS (SELECT cohort, sum(n * (n - 1) / 2e0) AS sa FROM (SELECT cohort, la, sum(c) AS n FROM c GROUP BY 1, 2) GROUP BY 1), y AS (SELECT cohort, sum(n * (n - 1) / 2e0) AS sb FROM (SELECT cohort, lb, sum(c) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT cohort, n::BIGINT AS n, {r('(s - sa * sb / (n * (n - 1) / 2e0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2e0))')} AS ari FROM s JOIN x USING (cohort) JOIN y USING (cohort)""", "v14")
def i15(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v14")
    j = v.where("start = 0").select("cohort", "entity", F.col("label").alias("a")).join(v.where("start = 3").select("entity", F.col("label").alias("b")), "entity")
    return _r(st.adjusted_rand(j, ["cohort"], "a", "b"), "ari")


_PAIR = "p AS (SELECT a.entity AS i, b.entity AS j, count(*) FILTER (WHERE a.label = b.label) / 8e0 AS c FROM v14 a JOIN v14 b ON a.start = b.start AND a.entity <> b.entity GROUP BY 1, 2)"
_FINAL = "f AS (SELECT c_custkey AS entity, c_nationkey % 4 AS cluster FROM customer)"


def _final(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), (F.col("c_nationkey") % 4).alias("cluster"))


@query("i16_silhouette", f"""WITH {_PAIR}, {_FINAL}, g AS (SELECT i, fi.cluster AS own, fj.cluster AS other, avg(1 - c) AS d, count(*) AS n FROM p JOIN f fi ON fi.entity = i JOIN f fj ON fj.entity = j GROUP BY 1, 2, 3),
s AS (SELECT i, own, max(d) FILTER (WHERE own = other) AS a, min(d) FILTER (WHERE own <> other) AS b FROM g GROUP BY 1, 2)
SELECT i AS entity, own AS cluster, {r('coalesce((b - a) / nullif(greatest(a, b), 0), 0)')} AS silhouette FROM s""", "v14")
def i16(spark: SparkSession, sf: str) -> DataFrame:
    return _r(cs.silhouette(cs.cluster_agreement(view(spark, sf, "v14"), _final(spark, sf))), "silhouette")


@query("i17_consensus_dispersion", f"""WITH {_PAIR} SELECT (SELECT count(DISTINCT entity) FROM v14) AS n, 8::BIGINT AS starts, {r('avg(c)')} AS mean_consensus, {r('avg(4 * (c - 0.5) * (c - 0.5))')} AS dispersion FROM p""", "v14")
def i17(spark: SparkSession, sf: str) -> DataFrame:
    return _r(cs.dispersion(view(spark, sf, "v14")).withColumn("starts", F.col("starts").cast("bigint")), "mean_consensus", "dispersion")


@query("i18_best_cosine_match", f"""WITH e AS (SELECT bag, label, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS v FROM v5, (SELECT unnest(range(0, 64)) AS i) GROUP BY GROUPING SETS ((bag, i), (label, i))),
a AS (SELECT bag, i, v FROM e WHERE bag IS NOT NULL), b AS (SELECT label, i, v FROM e WHERE bag IS NULL),
s AS (SELECT bag, label, sum(a.v * b.v) / sqrt(sum(a.v * a.v)) / sqrt(sum(b.v * b.v)) AS c FROM a JOIN b ON a.i = b.i GROUP BY 1, 2)
SELECT bag, matched, {r('c')} AS cosine FROM (SELECT bag, 'L' || CAST(label AS VARCHAR) AS matched, c, row_number() OVER (PARTITION BY bag ORDER BY c DESC, label) AS rn FROM s) WHERE rn = 1""", "v5")
def i18(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v5")
    ref = vector_mean(v, ["label"], "embedding").select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"), "x")
    return _r(best_match(vector_mean(v, ["bag"], "embedding"), ["bag"], "x", ref, "label", "x"), "cosine")


@query("i19_entity_concordance", f"""WITH l AS (SELECT cohort, entity, ln(1 + value) AS a, ln(1 + pred) AS b FROM v13), k AS (SELECT cohort, entity, rank() OVER (PARTITION BY entity ORDER BY a) + (count(*) OVER (PARTITION BY entity, a) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY entity ORDER BY b) + (count(*) OVER (PARTITION BY entity, b) - 1) / 2e0 AS rb FROM l),
c AS (SELECT cohort, entity, CASE WHEN count(*) >= 15 THEN round(corr(ra, rb), 9) END AS rho FROM k GROUP BY 1, 2)
SELECT cohort, count(rho) AS n, count(*) FILTER (WHERE rho > 0) AS n_positive, {r('count(*) FILTER (WHERE rho > 0) / CAST(count(rho) AS DOUBLE)')} AS share_positive, {r('median(rho)')} AS median_rho, CASE WHEN count(rho) >= 20 AND median(rho) > 0 THEN 'PASS' ELSE 'WARN' END AS status FROM c GROUP BY 1""", "v13")
def i19(spark: SparkSession, sf: str) -> DataFrame:
    v = _pairs(spark, sf).select("cohort", "entity", F.log1p("value").alias("a"), F.log1p("pred").alias("b"))
    c = materialize(st.entity_concordance(v, ["cohort", "entity"], "a", "b", 15).withColumn("rho", F.round("rho", 9)))
    return _r(st.concordance_summary(c, ["cohort"], "rho", with_p=False), "share_positive", "median_rho")


@query("i20_head_to_head_features", f"""SELECT cohort, feature, count(*) AS n, {r('corr(value, pred)')} AS a_pearson, {r('corr(value, sqrt(pred))')} AS b_pearson, {r('corr(value - pred, value - 300 * sqrt(pred))')} AS residual_pearson,
{r('sqrt(avg((value - pred) * (value - pred))) / 7')} AS a_rmse, {r('sqrt(avg((value - 300 * sqrt(pred)) * (value - 300 * sqrt(pred)))) / 7')} AS b_rmse FROM v13 GROUP BY 1, 2""", "v13")
def i20(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v13").withColumn("b", 300 * F.sqrt("pred"))
    h = st.head_to_head(v, "value", "pred", "b").withColumn("a_rmse", F.col("a_rmse") / 7).withColumn("b_rmse", F.col("b_rmse") / 7)
    return _r(h.drop("a_mae", "b_mae"), "a_pearson", "b_pearson", "residual_pearson", "a_rmse", "b_rmse")


@query("i20_head_to_head_summary", f"""WITH f AS (SELECT cohort, feature, corr(value, pred) AS ap, corr(value, 300 * sqrt(pred)) AS bp, sqrt(avg((value - pred) * (value - pred))) AS ar, sqrt(avg((value - 300 * sqrt(pred)) * (value - 300 * sqrt(pred)))) AS br FROM v13 GROUP BY 1, 2),
s AS (SELECT coalesce(cohort, 'pooled') AS cohort, count(*) AS features, avg(CASE WHEN bp > ap THEN 1e0 ELSE 0e0 END) AS sp, avg(CASE WHEN br < ar THEN 1e0 ELSE 0e0 END) AS sr, median(ap) AS map, median(bp) AS mbp, median(ar) AS mar, median(br) AS mbr FROM f GROUP BY GROUPING SETS ((cohort), ())),
c AS (SELECT coalesce(cohort, 'pooled') AS cohort, corr(value - pred, value - 300 * sqrt(pred)) AS rp FROM v13 GROUP BY GROUPING SETS ((cohort), ())),
d AS (SELECT cohort, ar - br AS d FROM f UNION ALL SELECT 'pooled', ar - br FROM f), k AS (SELECT cohort, d, rank() OVER (PARTITION BY cohort ORDER BY abs(d)) AS rk FROM d),
w AS (SELECT cohort, coalesce(sum(rk) FILTER (WHERE d > 0), 0)::DOUBLE AS w_plus, count(*) AS n FROM k GROUP BY 1)
SELECT s.cohort, features, {r('sp')} AS share_b_higher_pearson, {r('sr')} AS share_b_lower_rmse, {r('map')} AS median_a_pearson, {r('mbp')} AS median_b_pearson, {r('mar / 7')} AS median_a_rmse, {r('mbr / 7')} AS median_b_rmse,
w_plus AS rmse_w_plus, {r('(w_plus - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24)')} AS rmse_z, {r('rp')} AS residual_pearson FROM s JOIN c USING (cohort) JOIN w USING (cohort)""", "v13")
def i20_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = _pairs(spark, sf).withColumn("b", 300 * F.sqrt("pred"))
    m = materialize(st.head_to_head(v, "value", "pred", "b"))
    h = st.head_to_head_summary(v, m, "value", "pred", "b").withColumn("median_a_rmse", F.col("median_a_rmse") / 7).withColumn("median_b_rmse", F.col("median_b_rmse") / 7)
    return _r(h, "share_b_higher_pearson", "share_b_lower_rmse", "median_a_pearson", "median_b_pearson", "median_a_rmse", "median_b_rmse", "rmse_z", "residual_pearson")


@query("i21_metric_associations", f"""WITH t AS (SELECT bag, count(*) AS n_items, avg(occupancy) AS occupancy, avg(score) AS score FROM v4 GROUP BY 1), m AS (SELECT 'n_items' AS metric, CAST(n_items AS DOUBLE) AS value, score FROM t UNION ALL SELECT 'occupancy', occupancy, score FROM t),
k AS (SELECT metric, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY metric ORDER BY score) + (count(*) OVER (PARTITION BY metric, score) - 1) / 2e0 AS rb FROM m)
SELECT metric, count(*) AS n, {r('corr(ra, rb)')} AS rho, CASE WHEN corr(ra, rb) IS NULL THEN 'SKIP' ELSE 'PASS' END AS status FROM k GROUP BY 1""", "v4")
def i21(spark: SparkSession, sf: str) -> DataFrame:
    t = materialize(view(spark, sf, "v4").groupBy("bag").agg(F.count(F.lit(1)).alias("n_items"), F.avg("occupancy").alias("occupancy"), F.avg("score").alias("score")))
    return _r(st.metric_associations(t, "score", ["n_items", "occupancy"], with_p=False), "rho")


@query("i21_artifact_flags_with_q", f"""WITH t AS (SELECT bag, count(*) AS n_items, avg(occupancy) AS occupancy, avg(score) AS score FROM v4 GROUP BY 1), m AS (SELECT 'n_items' AS metric, CAST(n_items AS DOUBLE) AS value, score FROM t UNION ALL SELECT 'occupancy', occupancy, score FROM t),
k AS (SELECT metric, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY metric ORDER BY score) + (count(*) OVER (PARTITION BY metric, score) - 1) / 2e0 AS rb FROM m),
c AS (SELECT metric, count(*) AS n, CASE WHEN count(*) >= 10 THEN corr(ra, rb) END AS rho FROM k GROUP BY 1), s AS (SELECT *, rho * sqrt((n - 2) / greatest(1 - rho * rho, 1e-300)) AS st, n - 2e0 AS dof FROM c),
pv AS {_t_p('s', 'metric, n, rho', 'st', 'dof')}
SELECT metric, n, {r('rho')} AS rho, {r('p')} AS p, {r('q')} AS q, coalesce(abs(rho) >= 0.35 AND q <= 0.10, false) AS flag_large_correlation,
CASE WHEN rho IS NULL THEN 'SKIP' WHEN abs(rho) >= 0.35 AND q <= 0.10 THEN 'WARN' ELSE 'PASS' END AS status FROM {_bh('pv', '')}""", "v4")
def i21_q(spark: SparkSession, sf: str) -> DataFrame:
    t = materialize(view(spark, sf, "v4").groupBy("bag").agg(F.count(F.lit(1)).alias("n_items"), F.avg("occupancy").alias("occupancy"), F.avg("score").alias("score")))
    return _r(st.metric_associations(t, "score", ["n_items", "occupancy"]), "rho", "p", "q")


_META = """e AS (SELECT feature, cohort, avg(value) / 7e4 AS coef, stddev_samp(value) / 7e4 / sqrt(count(*)) AS se FROM v2 GROUP BY 1, 2),
f AS (SELECT feature, count(*) AS k, sum(1 / (se * se)) AS sw, sum(1 / (se * se) / (se * se)) AS sw2, sum(coef / (se * se)) / sum(1 / (se * se)) AS fx FROM e GROUP BY 1),
q AS (SELECT f.*, q FROM f JOIN (SELECT e.feature, sum((coef - fx) * (coef - fx) / (se * se)) AS q FROM e JOIN f ON f.feature = e.feature GROUP BY 1) USING (feature)),
t AS (SELECT *, greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM q),
n AS (SELECT t.feature, sum(coef / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS rn, sqrt(1 / sum(1 / (se * se + tau2))) AS rse FROM e JOIN t ON t.feature = e.feature GROUP BY 1),
b AS (SELECT t.*, 'fixed' AS method, fx AS coef, sqrt(1 / sw) AS se FROM t UNION ALL SELECT t.*, 'random', rn, rse FROM t JOIN n USING (feature))"""


@query("i22_meta_analysis", f"""WITH {_META} SELECT 'mean' AS endpoint, feature, k AS k_groups, method, {r('q')} AS q_het, {r('tau2')} AS tau2, {r('greatest((q - (k - 1)) / q, 0) * 100')} AS i2, {r('coef')} AS coef, {r('se')} AS se,
{r('coef / se')} AS z, {r('exp(coef)')} AS odds_ratio, {r('exp(coef - 1.96 * se)')} AS ci95_low, {r('exp(coef + 1.96 * se)')} AS ci95_high FROM b""", "v2")
def i22(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "v2").groupBy(F.lit("mean").alias("endpoint"), "feature", "cohort").agg((F.avg("value") / 7e4).alias("coef"), (F.stddev_samp("value") / 7e4 / F.sqrt(F.count(F.lit(1)))).alias("se"))
    m = st.meta_analysis(materialize(e), ["endpoint", "feature"], with_p=False)
    return _r(m, "q_het", "tau2", "i2", "coef", "se", "z", "odds_ratio", "ci95_low", "ci95_high")


@query("i23_baseline_delta", f"""WITH t AS (SELECT cohort, priority, CAST(sum(CAST(size AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 7e5 AS metric FROM v3 GROUP BY 1, 2)
SELECT t.cohort, t.priority, {r('t.metric')} AS metric, {r('b.metric')} AS baseline, {r('t.metric - b.metric')} AS delta, CASE WHEN t.metric - b.metric >= -0.005 THEN 'PASS' ELSE 'WARN' END AS status FROM t JOIN t b ON b.cohort = t.cohort AND b.priority = '1-URGENT'""", "v3")
def i23(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "v3").groupBy("cohort", "priority").agg((F.sum(F.col("size").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) / 7e5).alias("metric"))
    return _r(st.baseline_delta(t, ["cohort"], "priority", "metric", "1-URGENT", 0.005), "metric", "baseline", "delta")
