"""Imputation, feature selection and set scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions.numeric import rounded
from cohortwise.operators import impute as im
from cohortwise.operators import scoring as sc
from cohortwise.operators.windows import zscore_population
from cohortwise.plans.registry import query, r
from cohortwise.plans.views import table, view
from cohortwise.session import materialize

_Z = "SELECT cohort, entity, upper(feature) AS feature, coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0) AS z FROM v2 WINDOW w AS (PARTITION BY cohort, feature)"


def _v2(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v2")


_KNN = """WITH f AS (SELECT DISTINCT feature FROM v2), e AS (SELECT DISTINCT cohort, entity FROM v2),
gap AS (SELECT e.cohort, e.entity, f.feature FROM e, f WHERE NOT EXISTS (SELECT 1 FROM v2 x WHERE x.entity = e.entity AND x.feature = f.feature)),
d AS (SELECT a.cohort, a.entity, b.entity AS donor, sqrt(sum((a.value - b.value) * (a.value - b.value)) * (SELECT count(*) FROM f) / count(*)) AS dist
  FROM v2 a JOIN v2 b ON a.cohort = b.cohort AND a.feature = b.feature AND a.entity <> b.entity
  WHERE a.entity IN (SELECT entity FROM gap) GROUP BY 1, 2, 3),
k AS (SELECT g.cohort, g.entity, g.feature, d.dist, v.value, row_number() OVER (PARTITION BY g.entity, g.feature ORDER BY d.dist, d.donor) AS rn
  FROM gap g JOIN d ON d.entity = g.entity JOIN v2 v ON v.entity = d.donor AND v.feature = g.feature),
est AS (SELECT cohort, entity, feature, coalesce(avg(value) FILTER (WHERE dist = 0), sum(value / dist) / sum(1 / dist)) AS value FROM k WHERE rn <= 10 GROUP BY 1, 2, 3),
full_m AS (SELECT cohort, entity, feature, value, false AS imputed FROM v2
UNION ALL SELECT g.cohort, g.entity, g.feature, coalesce(est.value, m.value), true FROM gap g LEFT JOIN est USING (cohort, entity, feature)
  LEFT JOIN (SELECT cohort, feature, avg(value) AS value FROM v2 GROUP BY 1, 2) m ON m.cohort = g.cohort AND m.feature = g.feature)"""


@query("h1_knn_impute", _KNN + f" SELECT cohort, entity, feature, imputed, {r('ln(1 + value)')} AS value FROM full_m", "v2")
def h1(spark: SparkSession, sf: str) -> DataFrame:
    return im.knn_impute(materialize(_v2(spark, sf))).select("cohort", "entity", "feature", "imputed", rounded(F.log1p("value")).alias("value"))


@query("h1_knn_impute_zscore", _KNN + f""" SELECT cohort, entity, feature, {r("coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0)")} AS z FROM full_m WINDOW w AS (PARTITION BY cohort, feature)""", "v2")
def h1_z(spark: SparkSession, sf: str) -> DataFrame:
    full = materialize(im.knn_impute(materialize(_v2(spark, sf))), "imputed")
    return zscore_population(full, ["cohort", "feature"], "value").select("cohort", "entity", "feature", rounded(F.col("z")).alias("z"))


@query("h2_median_impute", """WITH t AS (SELECT cohort, case_id, CASE WHEN isfinite(TRY_CAST(raw_value AS DOUBLE)) THEN TRY_CAST(raw_value AS DOUBLE) END AS v FROM v11)
SELECT t.cohort, case_id, coalesce(v, m, 0) AS value FROM t LEFT JOIN (SELECT cohort, median(v) AS m FROM t GROUP BY 1) g ON g.cohort = t.cohort""", "v11")
def h2(spark: SparkSession, sf: str) -> DataFrame:
    from cohortwise.functions.numeric import to_number

    t = view(spark, sf, "v11").select("cohort", "case_id", to_number(F.col("raw_value")).alias("value"))
    return im.median_fill(t, ["cohort"], "value").select("cohort", "case_id", "value")


@query("h3_common_feature_selection", f"""WITH s AS (SELECT cohort, feature, count(*) AS c, mad(value) AS m FROM v2 GROUP BY 1, 2), n AS (SELECT cohort, count(*) AS n FROM v1 GROUP BY 1)
SELECT feature, {r('avg(m) / 3e4')} AS mean_mad FROM s JOIN n USING (cohort) GROUP BY feature
HAVING count(*) FILTER (WHERE c / CAST(n AS DOUBLE) >= 0.70) = (SELECT count(*) FROM n) ORDER BY avg(m) DESC, feature LIMIT 12""", "v1 v2")
def h3(spark: SparkSession, sf: str) -> DataFrame:
    v2, v1 = materialize(_v2(spark, sf)), view(spark, sf, "v1")
    chosen = im.select_features(materialize(im.feature_statistics(v2, v1, 0.70)), v1, 12)
    return chosen.select("feature", rounded(F.col("mean_mad") / 3e4).alias("mean_mad"))


_CHOSEN = """sel AS (SELECT feature FROM (SELECT cohort, feature, count(*) AS c, mad(value) AS m FROM v2 GROUP BY 1, 2) JOIN (SELECT cohort, count(*) AS n FROM v1 GROUP BY 1) n USING (cohort)
GROUP BY feature HAVING count(*) FILTER (WHERE c / CAST(n AS DOUBLE) >= 0.70) = (SELECT count(DISTINCT cohort) FROM v1) ORDER BY avg(m) DESC, feature LIMIT 12),
v2s AS (SELECT v2.* FROM v2 WHERE feature IN (SELECT feature FROM sel))"""
_KNN_CHOSEN = f"WITH {_CHOSEN}, " + _KNN[5:].replace("v2", "v2s")


@query("h3_common_feature_matrix", _KNN_CHOSEN + f""" SELECT cohort, entity, feature, imputed, {r("coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0)")} AS z FROM full_m WINDOW w AS (PARTITION BY cohort, feature)""", "v1 v2")
def h3_matrix(spark: SparkSession, sf: str) -> DataFrame:
    z, _ = im.common_feature_matrix(_v2(spark, sf), view(spark, sf, "v1"), 0.70, 12)
    return z.select("cohort", "entity", "feature", "imputed", rounded(F.col("z")).alias("z"))


@query("h3_feature_quality_rows", f"""WITH {_CHOSEN} SELECT cohort, count(DISTINCT entity) AS samples, count(DISTINCT feature) AS features_selected,
round(1 - count(*) / CAST(count(DISTINCT entity) * count(DISTINCT feature) AS DOUBLE), 6) AS imputed_fraction FROM v2s GROUP BY 1""", "v1 v2")
def h3_quality(spark: SparkSession, sf: str) -> DataFrame:
    return im.common_feature_matrix(_v2(spark, sf), view(spark, sf, "v1"), 0.70, 12)[1]


_SETS = "s AS (SELECT set_name, upper(feature) AS feature, weight FROM v8)"


@query("h4_unweighted_set_score", f"""WITH z AS ({_Z}), {_SETS}, u AS (SELECT s.*, count(*) OVER (PARTITION BY set_name) AS n FROM s WHERE feature IN (SELECT feature FROM z))
SELECT cohort, entity, set_name AS score, n AS features_used, {r('avg(z)')} AS value FROM z JOIN u ON z.feature = u.feature WHERE n >= 5 GROUP BY 1, 2, 3, 4""", "v2 v8")
def h4(spark: SparkSession, sf: str) -> DataFrame:
    out = sc.set_scores(sc.standardised(materialize(_v2(spark, sf))), view(spark, sf, "v8"))
    return out.withColumn("value", rounded(F.col("value")))


_H5 = f"""z AS ({_Z}), {_SETS}, u AS (SELECT s.*, count(*) OVER (PARTITION BY set_name) AS n, sum(abs(weight)) OVER (PARTITION BY set_name) AS norm FROM s WHERE feature IN (SELECT feature FROM z))"""


@query("h5_weighted_set_score", f"""WITH {_H5} SELECT cohort, entity, set_name AS score, n AS features_used, {r('sum(z * weight) / max(norm)')} AS value FROM z JOIN u ON z.feature = u.feature WHERE n >= 5 AND norm > 0 GROUP BY 1, 2, 3, 4""", "v2 v8")
def h5(spark: SparkSession, sf: str) -> DataFrame:
    out = sc.weighted_scores(sc.standardised(materialize(_v2(spark, sf))), view(spark, sf, "v8"))
    return out.withColumn("value", rounded(F.col("value")))


@query("h6_composed_set_matrix", f"""WITH {_H5}
SELECT cohort, entity, 'NET__' || set_name AS score, n AS features_used, {r('sum(z * weight) / max(norm)')} AS value FROM z JOIN u ON z.feature = u.feature WHERE n >= 5 AND norm > 0 GROUP BY 1, 2, 3, 4
UNION ALL SELECT cohort, entity, 'SET5__' || set_name, n, {r('avg(z)')} FROM z JOIN u ON z.feature = u.feature WHERE n >= 5 GROUP BY 1, 2, 3, 4
UNION ALL SELECT cohort, entity, 'SET10__' || set_name, n, {r('avg(z)')} FROM z JOIN u ON z.feature = u.feature WHERE n >= 10 GROUP BY 1, 2, 3, 4""", "v2 v8")
def h6(spark: SparkSession, sf: str) -> DataFrame:
    z, sets = materialize(sc.standardised(_v2(spark, sf))), view(spark, sf, "v8")
    out = sc.composed_scores(sc.weighted_scores(z, sets, 5, "NET__"), sc.set_scores(z, sets, 5, "SET5__"), sc.set_scores(z, sets, 10, "SET10__"))
    return out.withColumn("value", rounded(F.col("value")))


def _mapping(spark: SparkSession, sf: str) -> DataFrame:
    b = F.regexp_replace("p_brand", "Brand#", "")
    target = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("P"), b, F.lit("-2"))).otherwise(F.concat(F.lit("P"), b))
    status = F.when(F.col("p_brand") == "Brand#13", "failed").otherwise("mapped")
    return table(spark, sf, "part").select(F.concat(F.lit("NP_"), b).alias("accession"), target.alias("target"), F.concat(F.lit("P"), b).alias("canonical"), status.alias("status")).distinct()


_MAP = """m AS (SELECT DISTINCT 'NP_' || b AS accession, unnest([CASE WHEN p_type = 'PROMO' THEN 'P' || b || '-2' ELSE 'P' || b END, 'P' || b]) AS target
  FROM (SELECT replace(p_brand, 'Brand#', '') AS b, p_type, p_brand FROM part) WHERE p_brand <> 'Brand#13')"""
_SITEMAP = """ids AS (SELECT DISTINCT feature, split_part(feature, ':', 1) AS accession, unnest(regexp_extract_all(upper(split_part(feature, ':', 2)), '[A-Z][0-9]+')) AS site FROM v12),
sm AS (SELECT ids.*, m.target, CASE WHEN m.target IS NULL THEN '' ELSE m.target || ';' || site || '-p' END AS site_key FROM ids LEFT JOIN m ON m.accession = ids.accession)"""
_SITEZ = f"""{_MAP}, {_SITEMAP}, sv AS (SELECT cohort, entity, site_key AS feature, avg(value) AS value FROM v12 JOIN (SELECT DISTINCT feature AS f, site_key FROM sm WHERE site_key <> '') k ON k.f = v12.feature GROUP BY 1, 2, 3),
z AS (SELECT cohort, entity, feature, coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0) AS z FROM sv WINDOW w AS (PARTITION BY cohort, feature))"""


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    v = materialize(view(spark, sf, "v12"), "sites")
    return sc.site_matrix(v, sc.site_map(v, _mapping(spark, sf)))


@query("h7_site_map", f"WITH {_MAP}, {_SITEMAP} SELECT feature, accession, site, target, site_key FROM sm", "v12")
def h7_map(spark: SparkSession, sf: str) -> DataFrame:
    return sc.site_map(view(spark, sf, "v12"), _mapping(spark, sf))


@query("h7_site_matrix", f"WITH {_SITEZ} SELECT cohort, entity, feature, {r('z')} AS z FROM z", "v12")
def h7(spark: SparkSession, sf: str) -> DataFrame:
    return _sites(spark, sf).withColumn("z", rounded(F.col("z")))


_EDGE = """e AS (SELECT p_type AS set_name, 'S' || CAST(p_size % 5 + 1 AS VARCHAR) AS site, 'P' || replace(p_brand, 'Brand#', '') || CASE WHEN p_size % 2 = 0 THEN '-2' ELSE '' END AS acc FROM part WHERE p_size % 7 <> 0)"""


@query("h8_substrate_score", f"""WITH {_SITEZ}, {_EDGE}, k AS (SELECT DISTINCT set_name, unnest([acc, split_part(acc, '-', 1)]) || ';' || site || '-p' AS feature FROM e),
u AS (SELECT *, count(*) OVER (PARTITION BY set_name) AS n FROM k WHERE feature IN (SELECT feature FROM z)),
q AS (SELECT cohort, entity, set_name AS score, n AS features_used, avg(z) AS v FROM z JOIN u ON u.feature = z.feature WHERE n >= 5 GROUP BY 1, 2, 3, 4)
SELECT cohort, entity, score, features_used, {r("coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0)")} AS value FROM q WINDOW w AS (PARTITION BY cohort, score)""", "v12")
def h8(spark: SparkSession, sf: str) -> DataFrame:
    b = F.regexp_replace("p_brand", "Brand#", "")
    edges = table(spark, sf, "part").select(
        F.col("p_type").alias("source"), F.concat(F.lit("s"), (F.col("p_size") % 5 + 1).cast("string")).alias("site"),
        F.concat(F.lit("P"), b, F.when(F.col("p_size") % 2 == 0, "-2").otherwise("")).alias("accession"),
        F.lit("Human").alias("source_organism"), F.when(F.col("p_size") % 7 == 0, "mouse").otherwise("human").alias("target_organism"))
    return sc.substrate_scores(_sites(spark, sf), edges, 5).withColumn("value", rounded(F.col("value")))


@query("h9_signed_set_score", f"""WITH {_SITEZ}, s AS (SELECT DISTINCT p_type AS set_name, 'P' || replace(p_brand, 'Brand#', '') || ';S' || CAST(p_size % 5 + 1 AS VARCHAR) || '-p' AS feature, CASE WHEN p_size % 4 = 0 THEN 'd' ELSE 'u' END AS d FROM part),
k AS (SELECT * FROM s WHERE feature IN (SELECT feature FROM z)), n AS (SELECT set_name, count(DISTINCT feature) AS features_used, count(*) FILTER (WHERE d = 'u') AS n_up, count(*) FILTER (WHERE d = 'd') AS n_down FROM k GROUP BY 1),
q AS (SELECT cohort, entity, k.set_name AS score, features_used, n_up, n_down, (coalesce(avg(z) FILTER (WHERE d = 'u'), 0) - coalesce(avg(z) FILTER (WHERE d = 'd'), 0)) / CASE WHEN n_up > 0 AND n_down > 0 THEN 2e0 ELSE 1e0 END AS v
  FROM z JOIN k ON k.feature = z.feature JOIN n ON n.set_name = k.set_name WHERE features_used >= 5 GROUP BY 1, 2, 3, 4, 5, 6)
SELECT cohort, entity, score, features_used, n_up, n_down, {r("coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0)")} AS value FROM q WINDOW w AS (PARTITION BY cohort, score)""", "v12")
def h9(spark: SparkSession, sf: str) -> DataFrame:
    b = F.regexp_replace("p_brand", "Brand#", "")
    member = F.concat(F.lit("P"), b, F.lit(";S"), (F.col("p_size") % 5 + 1).cast("string"), F.lit("-p;"), F.when(F.col("p_size") % 4 == 0, "Down").otherwise("u"))
    short = table(spark, sf, "part").select(F.col("p_type").alias("set_name"), F.concat(F.lit("P"), b).alias("member"))
    m = table(spark, sf, "part").select(F.col("p_type").alias("set_name"), member.alias("member")).unionByName(short)
    return sc.signed_scores(_sites(spark, sf), m, 5).withColumn("value", rounded(F.col("value")))


@query("h10_mapped_group_matrix", f"""SELECT cohort, entity, p_brand AS feature, {r('ln(1 + avg(value))')} AS value FROM v12 JOIN (SELECT DISTINCT p_brand, 'NP_' || replace(p_brand, 'Brand#', '') AS acc FROM part WHERE p_brand <> 'Brand#3') ON acc = split_part(feature, ':', 1) GROUP BY 1, 2, 3""", "v12")
def h10(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "part").select(F.concat(F.lit("NP_"), F.regexp_replace("p_brand", "Brand#", "")).alias("accession"),
                                        F.when(F.col("p_brand") == "Brand#3", "").otherwise(F.col("p_brand")).alias("symbol"))
    return sc.mapped_matrix(view(spark, sf, "v12"), m).select("cohort", "entity", "feature", rounded(F.log1p("value")).alias("value"))


@query("h11_loading_projection", f"""WITH w AS (SELECT set_name AS factor, feature, weight / sum(weight) OVER (PARTITION BY set_name) AS w FROM v8 WHERE weight > 0 AND set_name IN ('PROMO', 'SMALL') AND feature IN (SELECT feature FROM v2)),
q AS (SELECT cohort, entity, factor, sum(value * w) AS raw FROM v2 JOIN w ON w.feature = v2.feature GROUP BY 1, 2, 3),
z AS (SELECT *, (raw - avg(raw) OVER p) / CASE WHEN stddev_samp(raw) OVER p > 1e-8 THEN stddev_samp(raw) OVER p ELSE 1 END AS z FROM q WINDOW p AS (PARTITION BY cohort, factor)),
d AS (SELECT cohort, entity, sum(z) FILTER (WHERE factor = 'PROMO') - coalesce(sum(z) FILTER (WHERE factor = 'SMALL'), 0) AS proxy FROM z GROUP BY 1, 2)
SELECT cohort, entity, {r('proxy')} AS proxy, {r("(proxy - avg(proxy) OVER p) / CASE WHEN stddev_samp(proxy) OVER p > 1e-8 THEN stddev_samp(proxy) OVER p ELSE 1 END")} AS proxy_z FROM d WINDOW p AS (PARTITION BY cohort)""", "v2 v8")
def h11(spark: SparkSession, sf: str) -> DataFrame:
    load = view(spark, sf, "v8").select(F.col("set_name").alias("factor"), "feature", F.abs("weight").alias("loading"), F.lit("a").alias("target_set"),
                                        F.when(F.col("weight") > 0, "positive").otherwise("negative").alias("direction"))
    out = sc.loading_projection(materialize(_v2(spark, sf)), load, "a", "PROMO", "SMALL")
    return out.select("cohort", "entity", rounded(F.col("proxy")).alias("proxy"), rounded(F.col("proxy_z")).alias("proxy_z"))


_LAB = "(SELECT v2.cohort, v2.entity, v2.feature, v2.value, CASE WHEN v1.nation <> 4 THEN v6.y END AS y FROM v2 JOIN v6 ON v6.entity = v2.entity JOIN v1 ON v1.entity = v2.entity)"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    lab = view(spark, sf, "v6").select("entity", "y").join(view(spark, sf, "v1").select("entity", "nation"), "entity")
    return _v2(spark, sf).join(lab.select("entity", F.when(F.col("nation") != 4, F.col("y")).alias("y")), "entity")


@query("h12_contrast_signature", f"""WITH t AS {_LAB}, s AS (SELECT cohort, feature, avg(value) AS m, stddev_samp(value) AS s, (avg(value) FILTER (WHERE y = 1) - avg(value) FILTER (WHERE y = 0)) / stddev_samp(value) AS w FROM t WHERE y IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY abs(w) DESC, feature) AS rn FROM s WHERE s > 0 AND w IS NOT NULL), g AS (SELECT cohort, feature, m, s, w / sqrt(sum(w * w) OVER (PARTITION BY cohort)) AS w FROM k WHERE rn <= 15),
q AS (SELECT t.cohort, t.entity, t.y, sum((value - m) / s * w) AS raw FROM t JOIN g ON g.cohort = t.cohort AND g.feature = t.feature GROUP BY 1, 2, 3),
a AS (SELECT cohort, avg(raw) AS m, stddev_samp(raw) AS s FROM q WHERE y IS NOT NULL GROUP BY 1),
z AS (SELECT q.cohort, entity, y, (raw - m) / s AS score_z FROM q JOIN a ON a.cohort = q.cohort), c AS (SELECT cohort, quantile_cont(score_z, 0.75) AS cutoff FROM z WHERE y IS NOT NULL GROUP BY 1)
SELECT z.cohort, entity, y, {r('score_z')} AS score_z, score_z >= cutoff - 1e-12 AS high FROM z JOIN c ON c.cohort = z.cohort""", "v1 v2 v6")
def h12(spark: SparkSession, sf: str) -> DataFrame:
    out = sc.signature_scores(materialize(_labelled(spark, sf)), "y", size=15)
    return out.select("cohort", "entity", "y", rounded(F.col("score_z")).alias("score_z"), "high")


@query("h13_burden_scores", f"""WITH z AS ({_Z}), b AS (SELECT *, CASE WHEN feature LIKE 'BRAND#1%' THEN 'first' ELSE 'second' END AS block FROM z), d AS (SELECT cohort, entity, avg(z) AS adverse_score FROM z WHERE feature IN ('BRAND#2', 'BRAND#5', 'BRAND#11') GROUP BY 1, 2)
SELECT g.cohort, g.entity, block, {r('positive_burden')} AS positive_burden, {r('absolute_burden')} AS absolute_burden, {r('adverse_score')} AS adverse_score, '3_features' AS adverse_status FROM (
SELECT cohort, entity, block, avg(greatest(z, 0)) AS positive_burden, avg(abs(z)) AS absolute_burden FROM b GROUP BY 1, 2, 3 UNION ALL SELECT cohort, entity, 'all', avg(greatest(z, 0)), avg(abs(z)) FROM b GROUP BY 1, 2) g LEFT JOIN d ON d.cohort = g.cohort AND d.entity = g.entity""", "v2")
def h13(spark: SparkSession, sf: str) -> DataFrame:
    z = materialize(sc.standardised(_v2(spark, sf))).withColumnRenamed("z", "value")
    adverse = z.where(F.col("feature").isin("BRAND#2", "BRAND#5", "BRAND#11")).select("feature")
    out = sc.burden_scores(z, F.when(F.col("feature").startswith("BRAND#1"), "first").otherwise("second"), adverse)
    return out.select("cohort", "entity", "block", *[rounded(F.col(c)).alias(c) for c in ("positive_burden", "absolute_burden", "adverse_score")], "adverse_status")


def _factor_tests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = materialize(_v2(spark, sf).join(view(spark, sf, "v6").select("entity", "y"), "entity").withColumnRenamed("feature", "factor"))
    tests = t.groupBy("cohort", "factor").agg(F.corr("value", F.col("y").cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))
    return t, tests


@query("h14_direction_table", f"""WITH t AS (SELECT v2.cohort, feature AS factor, corr(value, y) AS r FROM v2 JOIN v6 ON v6.entity = v2.entity GROUP BY 1, 2)
SELECT factor, {r('avg(r)')} AS mean_r, count(*) AS n_cohorts, avg(r) > 0 AS positive FROM t GROUP BY 1""", "v2 v6")
def h14(spark: SparkSession, sf: str) -> DataFrame:
    from cohortwise.functions.tails import correlation_p

    _, tests = _factor_tests(spark, sf)
    d = sc.direction_table(materialize(tests.withColumn("p", correlation_p(F.col("r"), F.col("n")))))
    return d.select("factor", rounded(F.col("mean_r")).alias("mean_r"), "n_cohorts", (F.col("mean_r") > 0).alias("positive"))


# The strict branch: here 1 - |r| stands for p, so that the significant factors can be named in SQL.
@query("h14_strict_directions", """WITH t AS (SELECT v2.cohort, feature AS factor, corr(value, y) AS r FROM v2 JOIN v6 ON v6.entity = v2.entity GROUP BY 1, 2),
g AS (SELECT factor, avg(r) AS mean_r, count(r) AS n_cohorts, coalesce(bool_or(r > 0 AND 1 - abs(r) < 0.95), false) AS strict_adverse, coalesce(bool_or(r < 0 AND 1 - abs(r) < 0.95), false) AS strict_protective FROM t GROUP BY 1)
SELECT factor, n_cohorts, strict_adverse, strict_protective, CASE WHEN (SELECT bool_or(strict_adverse) FROM g) THEN strict_adverse ELSE mean_r > 0 END AS adverse,
CASE WHEN (SELECT bool_or(strict_protective) FROM g) THEN strict_protective ELSE mean_r < 0 END AS protective FROM g""", "v2 v6")
def h14_strict(spark: SparkSession, sf: str) -> DataFrame:
    _, tests = _factor_tests(spark, sf)
    d = sc.direction_table(materialize(tests.withColumn("p", 1 - F.abs("r"))), alpha=0.95)
    return d.select("factor", "n_cohorts", "strict_adverse", "strict_protective", "adverse", "protective")


@query("h14_direction_gated_risk", f"""WITH t AS (SELECT v2.cohort, v2.entity, feature AS factor, value, y FROM v2 JOIN v6 ON v6.entity = v2.entity),
g AS (SELECT factor, avg(r) AS mean_r FROM (SELECT cohort, factor, corr(value, y) AS r FROM t GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT cohort, entity, factor, (value - avg(value) OVER p) / CASE WHEN stddev_samp(value) OVER p > 1e-8 THEN stddev_samp(value) OVER p ELSE 1 END AS z FROM t WINDOW p AS (PARTITION BY cohort, factor)),
q AS (SELECT cohort, entity, avg(z) FILTER (WHERE mean_r > 0) - coalesce(avg(z) FILTER (WHERE mean_r < 0), 0) AS risk FROM z JOIN g USING (factor) GROUP BY 1, 2)
SELECT cohort, entity, {r('risk')} AS risk, {r("(risk - avg(risk) OVER p) / CASE WHEN stddev_samp(risk) OVER p > 1e-8 THEN stddev_samp(risk) OVER p ELSE 1 END")} AS risk_z FROM q WINDOW p AS (PARTITION BY cohort)""", "v2 v6")
def h14_risk(spark: SparkSession, sf: str) -> DataFrame:
    t, tests = _factor_tests(spark, sf)
    # With no significance level every factor falls back to the sign of its mean r.
    d = materialize(sc.direction_table(tests.withColumn("p", F.lit(1.0))))
    return sc.gated_risk(t, d).select("cohort", "entity", rounded(F.col("risk")).alias("risk"), rounded(F.col("risk_z")).alias("risk_z"))


@query("h15_quadrant_groups", """WITH t AS (SELECT v1.cohort, v1.entity, v1.value AS risk, x.residual FROM v1 LEFT JOIN (SELECT entity, max(size) AS residual FROM v3 GROUP BY 1) x ON x.entity = v1.entity),
c AS (SELECT cohort, median(risk) AS m, quantile_cont(residual, 0.75) AS q1, quantile_cont(residual, 2e0 / 3) AS q2, quantile_cont(residual, 0.6) AS q3 FROM t GROUP BY 1),
k AS (SELECT 'top25' AS cutoff UNION ALL SELECT 'top33' UNION ALL SELECT 'top40')
SELECT t.cohort, entity, cutoff, CASE WHEN residual IS NULL THEN 'unassigned' ELSE CASE WHEN risk <= m THEN 'low' ELSE 'high' END || CASE WHEN residual > CASE cutoff WHEN 'top25' THEN q1 WHEN 'top33' THEN q2 ELSE q3 END THEN '_high' ELSE '_low' END END AS quadrant
FROM t JOIN c ON c.cohort = t.cohort, k""", "v1 v3")
def h15(spark: SparkSession, sf: str) -> DataFrame:
    big = view(spark, sf, "v3").groupBy("entity").agg(F.max("size").alias("residual"))
    t = view(spark, sf, "v1").select("cohort", "entity", F.col("value").alias("risk")).join(big, "entity", "left")
    return sc.quadrant_groups(t).select("cohort", "entity", "cutoff", "quadrant")


@query("h16_candidate_classes", """WITH t AS (SELECT cohort, 'a' AS target_set, feature, corr(value, pred) AS pearson, (avg(pred) - 24000) / 4000 AS r, count(*) / 3000e0 AS q FROM v13 GROUP BY 1, 3),
g AS (SELECT cohort, median(pearson) AS m FROM t GROUP BY 1)
SELECT t.cohort, feature, CASE WHEN q <= 0.10 AND abs(r) >= 0.15 THEN CASE WHEN pearson > 0 AND pearson >= m THEN 'visible' ELSE 'blind_spot' END ELSE 'silent' END AS candidate_class FROM t JOIN g ON g.cohort = t.cohort""", "v13")
def h16(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "v13").groupBy("cohort", F.lit("a").alias("target_set"), "feature").agg(
        F.corr("value", "pred").alias("pearson"), ((F.avg("pred") - 24000) / 4000).alias("r"), (F.count(F.lit(1)) / F.lit(3000.0)).alias("q"))
    return sc.candidate_classes(materialize(t)).select("cohort", "feature", "candidate_class")


_M1 = f"""WITH s AS (SELECT cohort, feature, count(*) AS c, mad(value) AS m FROM v2 GROUP BY 1, 2), n AS (SELECT cohort, count(*) AS n FROM v1 GROUP BY 1),
f AS (SELECT feature FROM s JOIN n USING (cohort) GROUP BY feature HAVING count(*) FILTER (WHERE c / CAST(n AS DOUBLE) >= 0.60) = (SELECT count(*) FROM n) ORDER BY avg(m) DESC, feature LIMIT 15),
z AS (SELECT cohort, entity, upper(feature) AS feature, coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0) AS z FROM v2 WHERE feature IN (SELECT feature FROM f) WINDOW w AS (PARTITION BY cohort, feature)),
u AS (SELECT set_name, upper(feature) AS feature, count(*) OVER (PARTITION BY set_name) AS n FROM v8 WHERE upper(feature) IN (SELECT feature FROM z)),
q AS (SELECT cohort, entity, set_name AS score, avg(z) AS value FROM z JOIN u ON u.feature = z.feature WHERE n >= 5 GROUP BY 1, 2, 3)
SELECT cohort, score, entity, {r('value')} AS value FROM (SELECT *, row_number() OVER (PARTITION BY cohort, score ORDER BY value DESC, entity) AS rank FROM q) WHERE rank <= 25"""


@query("m1_set_score_ranking", _M1, "v1 v2 v8")
def m1(spark: SparkSession, sf: str) -> DataFrame:
    v2, v1 = materialize(_v2(spark, sf), "matrix"), view(spark, sf, "v1")
    stats = materialize(im.feature_statistics(v2, v1, 0.60), "stats")
    chosen = materialize(im.select_features(stats, v1, 15).select("feature"), "chosen")
    z = sc.standardised(v2.join(chosen, "feature", "left_semi"))
    scores = sc.set_scores(materialize(z, "z"), view(spark, sf, "v8"))
    return sc.ranked_entities(scores).select("cohort", "score", "entity", rounded(F.col("value")).alias("value"))
