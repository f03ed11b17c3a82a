"""Folds, out-of-fold models, survival, clustering and factorisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions.numeric import rounded
from cohortwise.operators import clustering as cl
from cohortwise.operators import factors as fa
from cohortwise.operators import folds as fo
from cohortwise.operators import logistic as lo
from cohortwise.operators import regression as rg
from cohortwise.operators import scoring as sc
from cohortwise.operators import stats as st
from cohortwise.operators import survival as sv
from cohortwise.operators import windows as wn
from cohortwise.operators.aggregates import vector_mean
from cohortwise.operators.vectors import best_match, feature_names, to_vectors
from cohortwise.plans.derived import clinical, survival, xy_vectors
from cohortwise.plans.registry import query, r
from cohortwise.plans.views import table, view
from cohortwise.session import materialize

SEED = 20260609


def _r(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, rounded(F.col(c)))
    return df


@query("j1_repeated_kfold", f"""SELECT cohort, entity, repeat, CAST((row_number() OVER (PARTITION BY cohort, repeat ORDER BY md5('{SEED}|' || repeat || '|' || entity), entity) - 1) % 5 AS INT) AS fold
FROM v1, (SELECT unnest(range(0, 5))::INT AS repeat)""", "v1")
def j1(spark: SparkSession, sf: str) -> DataFrame:
    return fo.kfold(view(spark, sf, "v1"), ["cohort"], "entity", 5, 5, SEED)


@query("j2_stratified_kfold", f"""WITH k AS (SELECT cohort, greatest(2, least(5, min(c))) AS k FROM (SELECT cohort, y, count(*) AS c FROM v6b GROUP BY 1, 2) GROUP BY 1)
SELECT v6b.cohort, entity, y, repeat, CAST((row_number() OVER (PARTITION BY v6b.cohort, y, repeat ORDER BY md5('{SEED}|' || repeat || '|' || entity), entity) - 1) % k AS INT) AS fold, k::INT AS n_folds
FROM v6b JOIN k ON k.cohort = v6b.cohort, (SELECT unnest(range(0, 2))::INT AS repeat)""", "v6b")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    return fo.stratified_kfold(view(spark, sf, "v6b"), ["cohort"], "entity", "y", 5, 2, SEED)


@query("j3_group_kfold", f"""WITH e AS (SELECT entity, CAST((row_number() OVER (ORDER BY md5('{SEED}|0|' || entity), entity) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT entity FROM v3))
SELECT v3.entity, bag, fold FROM v3 JOIN e ON e.entity = v3.entity""", "v3")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    return fo.group_kfold(view(spark, sf, "v3").select("entity", "bag"), ["entity"], 5, SEED)


@query("j3_leave_one_group_out", "SELECT cohort, entity, cohort AS fold FROM v1", "v1")
def j3_loo(spark: SparkSession, sf: str) -> DataFrame:
    return fo.leave_one_group_out(view(spark, sf, "v1").select("cohort", "entity"), "cohort")


def _oof(spark: SparkSession, sf: str, target_pca: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    data = xy_vectors(spark, sf)
    pred, models, _ = rg.crossfit(data, 5, 2, SEED, target_pca)
    return data, materialize(pred, "oof"), models


@query("j4_crossfit_predictions")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    _, pred, _ = _oof(spark, sf)
    return _r(rg.mean_prediction(pred, 2), "pred")


@query("j4_crossfit_target_axes")
def j4_pca(spark: SparkSession, sf: str) -> DataFrame:
    _, pred, _ = _oof(spark, sf, True)
    return _r(rg.mean_prediction(pred, 2), "pred")


@query("j5_oof_feature_metrics")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    data, pred, _ = _oof(spark, sf)
    j = materialize(rg.mean_prediction(pred, 2).join(rg.observed_long(data), ["cohort", "entity", "position"]), "pairs")
    return _r(st.feature_metrics(j, ["cohort", "position"], "obs", "pred"), "mse", "rmse", "mae", "r2", "pearson", "spearman")


@query("j6_logistic_single_flag", f"""WITH t AS (SELECT v6.cohort, y, CASE WHEN nation % 2 = 1 THEN 1 ELSE 0 END AS f FROM v6 JOIN v1 ON v1.entity = v6.entity),
g AS (SELECT cohort, sum(y * f)::DOUBLE AS a, sum((1 - y) * f)::DOUBLE AS b, sum(y * (1 - f))::DOUBLE AS c, sum((1 - y) * (1 - f))::DOUBLE AS d FROM t GROUP BY 1)
SELECT cohort, {r('ln(c / d)')} AS intercept, {r('ln(a * d / (b * c))')} AS coef, {r('sqrt(1 / a + 1 / b + 1 / c + 1 / d)')} AS se FROM g""", "v1 v6")
def j6_flag(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "v6").join(view(spark, sf, "v1").select("entity", "nation"), "entity")
    rows = materialize(t.select("cohort", F.col("y").cast("double").alias("y"), F.array((F.col("nation") % 2).cast("double")).alias("x")))
    fit = lo.newton_fit(rows, ["cohort"], 1, ridge=0.0)
    return fit.select("cohort", rounded(F.get("beta", F.lit(0))).alias("intercept"), rounded(F.get("beta", F.lit(1))).alias("coef"), rounded(F.get("se", F.lit(1))).alias("se"))


MODELS = {"clinic_only": ["age_z", "flag"], "size_only": ["size_z"], "count_only": ["count_z"], "size_and_count": ["size_z", "count_z"],
          "clinic_plus_size": ["age_z", "flag", "size_z"], "clinic_plus_all": ["age_z", "flag", "size_z", "count_z"]}


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = lo.spec_rows(clinical(spark, sf), MODELS, ["y_urgent", "y_pending"], 4)
    return lo.model_terms(rows, 4)


@query("j6_logistic_terms")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    rows = lo.spec_rows(clinical(spark, sf), {"clinic_plus_all": MODELS["clinic_plus_all"]}, ["y_urgent"], 4)
    return _r(lo.model_terms(rows, 4, metrics=False, with_p=False), "coef", "std_err", "z", "odds_ratio", "ci95_low", "ci95_high", "epv")


@query("j7_model_grid")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf)


# Newton's steps for intercept and slope, recursively; two unknowns are solved by hand.
_CALIBRATION = f"""WITH RECURSIVE o AS (SELECT cohort, y::DOUBLE AS y, least(greatest(score / 20000, 0.01), 0.99) AS pr FROM v6b), x AS (SELECT cohort, y, ln(pr / (1 - pr)) AS x FROM o),
u AS (SELECT cohort, min(y) < max(y) AND stddev_pop(x) > 1e-10 AS ok, avg(y) AS rate FROM x GROUP BY 1),
steps AS (SELECT cohort, 0 AS i, ln(rate / (1 - rate)) AS a, 0e0 AS b FROM u WHERE ok
UNION ALL SELECT cohort, i + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
  SELECT cohort, i, a, b, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11
  FROM (SELECT q.*, y, x, 1 / (1 + exp(-(q.a + q.b * x))) AS p FROM steps q JOIN x USING (cohort) WHERE q.i < 25) GROUP BY cohort, i, a, b))
SELECT cohort, {r('a')} AS calibration_intercept, {r('b')} AS calibration_slope, CASE WHEN ok THEN 'PASS' ELSE 'SKIP' END AS calibration_status FROM u LEFT JOIN (SELECT * FROM steps WHERE i = 25) USING (cohort)"""


@query("i14_calibration_refit", _CALIBRATION, "v6b")
def i14(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v6b").select("cohort", "y", F.least(F.greatest(F.col("score") / 20000, F.lit(0.01)), F.lit(0.99)).alias("prob"))
    return _r(lo.calibration(v, ["cohort"]), "calibration_intercept", "calibration_slope")


@query("l5_model_diagnostics")
def l5(spark: SparkSession, sf: str) -> DataFrame:
    return _r(lo.model_diagnostics(_terms(spark, sf)), "epv")


def _labelled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v5").select("cohort", F.col("item").alias("entity"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") < 5).cast("int").alias("y"))


@query("j8_balanced_oof_risk")
def j8(spark: SparkSession, sf: str) -> DataFrame:
    risk, _ = lo.balanced_oof(_labelled_vectors(spark, sf), 5, 2, SEED, 128)
    return _r(risk.select("cohort", "entity", "y", "risk", "risk_z"), "risk", "risk_z")


@query("j9_feature_block_benchmark")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    v = _labelled_vectors(spark, sf)
    parts = None
    for name, width, pcs in (("low_dim", 8, 8), ("half", 32, 10), ("all", 64, 10)):
        risk, _ = lo.balanced_oof(v.withColumn("x", F.slice("x", 1, width)), 3, 1, SEED, pcs)
        part = risk.select(F.lit(name).alias("block"), "cohort", "y", "risk")
        parts = part if parts is None else parts.unionByName(part)
    both = materialize(parts.withColumn("cohort", F.explode(F.array("cohort", F.lit("pooled")))), "blocks")
    m = materialize(st.classification_metrics(both, ["block", "cohort"], "y", "risk"), "metrics")
    return _r(st.baseline_delta(m.select("block", "cohort", "n", "events", "auc", "average_precision", "brier"), ["cohort"], "block", "auc", "low_dim"), "auc", "average_precision", "brier", "baseline", "delta")


def _survival_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = survival(spark, sf).select(F.concat(F.lit("U"), (F.col("entity") % 2).cast("string")).alias("cohort"), "entity", F.col("days").alias("time"), "event",
                                   F.log1p(F.col("n_events").cast("double")).alias("activity"), "mean_value", (F.col("entity") % 3 == 0).cast("double").alias("third"))
    return materialize(s, "survival")


COX_MODELS = {"activity_only": ["activity"], "value_only": ["mean_value"], "activity_and_value": ["activity", "mean_value"], "group": ["third"]}


@query("j10_cox_models")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    return _r(sv.cox_models(_survival_rows(spark, sf), COX_MODELS), "coef", "se", "z", "p", "hazard_ratio", "ci95_low", "ci95_high", "q")


# One yes-or-no predictor: the risk sets are four running counts, and Newton's steps are a recursion on one number.
_COX_GROUP = f"""WITH RECURSIVE e AS (SELECT user_id AS entity, epoch_us(coalesce(min(CASE WHEN event_type = 'purchase' AND value > 100 THEN ts END), max(ts))) - epoch_us(min(ts)) AS time,
CASE WHEN min(CASE WHEN event_type = 'purchase' AND value > 100 THEN ts END) IS NOT NULL THEN 1 ELSE 0 END AS event, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS x FROM events GROUP BY user_id),
s AS (SELECT 'U' || CAST(entity % 2 AS VARCHAR) AS cohort, * FROM e), m AS (SELECT cohort, count(*) AS n, sum(event)::BIGINT AS events, stddev_samp(x) AS sd FROM s GROUP BY 1),
t AS (SELECT cohort, time, sum(event) AS d, sum(event * x) AS d1, count(*) AS c, sum(x) AS c1 FROM s GROUP BY 1, 2),
k AS (SELECT *, sum(c) OVER w AS r, sum(c1) OVER w AS r1 FROM t WINDOW w AS (PARTITION BY cohort ORDER BY time DESC)),
v AS (SELECT cohort, d1 / CAST(d AS DOUBLE) AS up, (r1 - l / CAST(d AS DOUBLE) * d1)::DOUBLE AS a, ((r - r1) - l / CAST(d AS DOUBLE) * (d - d1))::DOUBLE AS b FROM (SELECT *, unnest(range(0, d::BIGINT)) AS l FROM k WHERE d > 0)),
steps AS (SELECT cohort, 0 AS i, 0e0 AS beta, 0e0 AS info FROM m WHERE events >= 10
UNION ALL SELECT q.cohort, q.i + 1, any_value(q.beta) + (sum(up - a * exp(q.beta) / (a * exp(q.beta) + b)) - any_value(n * {sv.PENALTY} * sd * sd * q.beta)) / (sum(a * exp(q.beta) * b / ((a * exp(q.beta) + b) * (a * exp(q.beta) + b))) + any_value(n * {sv.PENALTY} * sd * sd)),
sum(a * exp(q.beta) * b / ((a * exp(q.beta) + b) * (a * exp(q.beta) + b))) + any_value(n * {sv.PENALTY} * sd * sd) FROM steps q JOIN v ON v.cohort = q.cohort JOIN m ON m.cohort = q.cohort WHERE q.i < 25 GROUP BY q.cohort, q.i)
SELECT cohort, n, events, {r('beta')} AS coef, {r('1 / sqrt(info)')} AS se, {r('beta * sqrt(info)')} AS z, {r('exp(beta)')} AS hazard_ratio FROM steps JOIN m USING (cohort) WHERE i = 25"""


@query("j10_cox_group", _COX_GROUP)
def j10_group(spark: SparkSession, sf: str) -> DataFrame:
    out = sv.cox_models(_survival_rows(spark, sf), {"group": ["third"]}).where("status <> 'SKIP'")
    return _r(out.select("cohort", "n", "events", "coef", "se", "z", "hazard_ratio"), "coef", "se", "z", "hazard_ratio")


@query("j11_median_impute_loo_ridge")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    long = materialize(view(spark, sf, "v2"), "matrix")
    names = feature_names(long, "feature")
    y = clinical(spark, sf).select("cohort", "entity", F.array("age_z", "size_z", "count_z").alias("y")).where(~F.exists("y", lambda v: v.isNull()))
    data = materialize(to_vectors(long, ["cohort", "entity"], "feature", "value", names).join(y, ["cohort", "entity"]), "vectors")
    assign = materialize(fo.kfold(data, ["cohort"], "entity", 5, 1, SEED), "folds")
    med = to_vectors(rg.fold_medians(long.join(data.select("cohort", "entity"), ["cohort", "entity"], "left_semi"), assign, 5), ["cohort", "held"], "feature", "median", names, "med")
    rows = data.join(assign, ["cohort", "entity"]).withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(4)))).join(med, ["cohort", "held"])
    rows = materialize(rows.withColumn("x", F.zip_with("x", "med", lambda a, b: F.coalesce(a, b, F.lit(0.0)))).drop("med"), "filled")
    models = materialize(rg.loo_ridge_models(rows.where("fold <> held"), len(names), 3, rg.LOO_ALPHAS, ["cohort", "held"]), "models")
    pred = rg.apply_models(rows.where("fold = held"), models, ["cohort", "held"], ["entity"])
    return _r(pred.select("cohort", "entity", F.posexplode("pred").alias("position", "pred")), "pred")


def _net_rows(spark: SparkSession, sf: str) -> DataFrame:
    data = materialize(xy_vectors(spark, sf), "xy")
    return materialize(data.join(fo.kfold(data, ["cohort"], "entity", 5, 1, SEED), ["cohort", "entity"]), "rows")


def _net_predictions(rows: DataFrame, models: DataFrame) -> DataFrame:
    pred = rg.apply_models(rows, models, ["cohort", "fold"], ["entity", "y"])
    return pred.select("cohort", "entity", "fold", F.posexplode(F.arrays_zip(F.col("y").alias("obs"), "pred")).alias("position", "t")).select("cohort", "entity", "fold", "position", "t.obs", "t.pred")


@query("j12_elastic_net_oof")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    rows = _net_rows(spark, sf)
    return _r(_net_predictions(rows, materialize(rg.net_models(rows, ["cohort"]), "nets")), "obs", "pred")


@query("j12_elastic_net_metrics")
def j12_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold metrics of each target, and whether all its fits met the duality gap."""
    rows = _net_rows(spark, sf)
    models = materialize(rg.net_models(rows, ["cohort"]), "nets")
    m = st.feature_metrics(materialize(_net_predictions(rows, models), "pairs"), ["cohort", "position"], "obs", "pred")
    status = rg.net_status(models, ["cohort"]).groupBy("cohort", "position").agg(F.max("status").alias("status"))  # WARN comes after PASS
    return _r(m.join(status, ["cohort", "position"]), "mse", "rmse", "mae", "r2", "pearson", "spearman")


@query("j12_elastic_net_coefficients")
def j12_coef(spark: SparkSession, sf: str) -> DataFrame:
    models = materialize(rg.net_models(_net_rows(spark, sf), ["cohort"]), "nets")
    cells = models.select("cohort", "fold", F.size("intercept").alias("q"), F.posexplode("coef").alias("at", "coef")).where(F.abs("coef") > 1e-10)
    long = cells.select("cohort", "fold", F.floor(F.col("at") / F.col("q")).cast("int").alias("input"), F.pmod("at", "q").alias("position"), "coef")
    return _r(long.join(rg.net_status(models, ["cohort"]).withColumn("gap", F.round("gap", 6)), ["cohort", "fold", "position"]), "coef")


# With one input each fit is a soft threshold, or a quotient, of plain covariances.
_ONE_INPUT = """d AS (SELECT cohort, item AS entity, embedding[1]::DOUBLE AS x, position, embedding[49 + position]::DOUBLE AS y FROM v5, (SELECT unnest(range(0, 16))::INT AS position)),
f AS (SELECT cohort, item AS entity, repeat, CAST((row_number() OVER (PARTITION BY cohort, repeat ORDER BY md5('{seed}|' || repeat || '|' || item), item) - 1) % 5 AS INT) AS fold FROM v5, (SELECT unnest(range(0, {repeats}))::INT AS repeat)),
t AS (SELECT d.*, repeat, fold FROM d JOIN f ON f.cohort = d.cohort AND f.entity = d.entity),
m AS (SELECT cohort, repeat, held, position, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) / stddev_pop(x) AS rho FROM t, (SELECT unnest(range(0, 5)) AS held) WHERE fold <> held GROUP BY 1, 2, 3, 4)"""


def _one_input(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(xy_vectors(spark, sf).withColumn("x", F.slice("x", 1, 1)), "xy")


@query("j12_single_input_net", f"""WITH {_ONE_INPUT.format(seed=SEED, repeats=1)}, b AS (SELECT *, sign(rho) * greatest(abs(rho) - 0.005 * 0.5, 0) / (1 + 0.005 * 0.5) / sx AS b FROM m)
SELECT t.cohort, entity, fold, t.position, {r('y')} AS obs, {r('my + (x - mx) * b')} AS pred FROM t JOIN b ON b.cohort = t.cohort AND b.held = t.fold AND b.position = t.position""", "v5")
def j12_one(spark: SparkSession, sf: str) -> DataFrame:
    data = _one_input(spark, sf)
    rows = materialize(data.join(fo.kfold(data, ["cohort"], "entity", 5, 1, SEED), ["cohort", "entity"]), "rows")
    return _r(_net_predictions(rows, materialize(rg.net_models(rows, ["cohort"], [0.005], [0.5]), "nets")), "obs", "pred")


@query("j4_single_input_ridge", f"""WITH {_ONE_INPUT.format(seed=SEED, repeats=5)}
SELECT t.cohort, entity, t.position, {r('avg(my + (x - mx) / sx * rho * n / (n + 10))')} AS pred FROM t JOIN m ON m.cohort = t.cohort AND m.repeat = t.repeat AND m.held = t.fold AND m.position = t.position GROUP BY 1, 2, 3""", "v5")
def j4_one(spark: SparkSession, sf: str) -> DataFrame:
    data = _one_input(spark, sf)
    rows = materialize(data.join(rg.inner_assignments(data, 5, 5, SEED), ["cohort", "entity"]), "rows")
    models = materialize(rg.crossfit_models(rows, [10.0]), "models")
    return _r(rg.mean_prediction(rg.apply_models(rows, models, ["cohort", "repeat", "fold"], ["entity"]), 5), "pred")


@query("j13_bag_ridge_item_scores")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    v = materialize(view(spark, sf, "v5").withColumn("x", F.col("embedding").cast("array<double>")), "items")
    bags = vector_mean(v, ["entity", "bag"], "x").join(v.groupBy("bag").agg(F.array(F.avg("label").cast("double")).alias("y")), "bag")
    model, _ = rg.bag_ridge(materialize(bags, "bags"), rg.ALPHAS, 5, SEED)
    # Items are scored by the centred dot product; a bag is the mean of its items.
    centred = model.withColumn("intercept", F.array(-F.aggregate(F.zip_with("centre", "coef", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))
    s = rg.apply_models(v.withColumn("k", F.lit(0)), centred, ["k"], ["bag", "item"], out="s").select("bag", "item", F.get("s", F.lit(0)).alias("score"))
    s = materialize(s, "scores")
    return _r(s.join(s.groupBy("bag").agg(F.avg("score").alias("bag_score")), "bag"), "score", "bag_score")


@query("j13_bag_ridge_alphas")
def j13_alpha(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v5").withColumn("x", F.col("embedding").cast("array<double>"))
    bags = vector_mean(v, ["entity", "bag"], "x").join(v.groupBy("bag").agg(F.array(F.avg("label").cast("double")).alias("y")), "bag")
    return _r(rg.bag_ridge(materialize(bags, "bags"), rg.ALPHAS, 5, SEED)[1], "mse")


@query("j14_transfer_predictor")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v5").select("cohort", F.col("item").alias("entity"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("l"))
    targets = F.inline(F.array(F.struct(F.lit("A1").alias("target"), F.array(F.col("l") + 1).alias("y")), F.struct(F.lit("A2").alias("target"), F.array(F.lit(10.0) - F.col("l")).alias("y"))))
    rows = materialize(v.select("cohort", "entity", "x", targets), "targets")
    # Each cohort is predicted by the model trained on the other cohorts.
    cohorts = [c[0] for c in rows.select("cohort").distinct().orderBy("cohort").collect()]  # a name per cohort, however many
    held = F.explode(F.array(*[F.lit(c) for c in cohorts]))
    train = rows.withColumn("held", held).where("held <> cohort")
    p = rg.width(rows, "x")
    models = materialize(rg.loo_ridge_models(train, p, 1, rg.TRANSFER_ALPHAS, ["held", "target"], rg.TRANSFER_COMPONENTS), "models")
    pred = rg.apply_models(rows.withColumn("held", F.col("cohort")), models, ["held", "target"], ["cohort", "entity"])
    wide = pred.groupBy("cohort", "entity").agg(*[F.max(F.when(F.col("target") == t, F.get("pred", F.lit(0)))).alias(t) for t in ("A1", "A2")])
    total = F.col("A1") + F.col("A2") + 1e-12
    out = wide.withColumn("A1_fraction", F.col("A1") / total).withColumn("A2_fraction", F.col("A2") / total).withColumn("difference", F.col("A2") - F.col("A1"))
    out = out.withColumn("dominant", F.when(F.col("A2_fraction") >= F.col("A1_fraction"), "A2").otherwise("A1"))
    return _r(wn.zscore_sample(out, ["cohort"], "difference", "difference_z"), "A1", "A2", "A1_fraction", "A2_fraction", "difference", "difference_z")


_J15 = f"""t AS (SELECT v13.*, repeat, fold, value - pred AS res FROM v13 JOIN (SELECT entity AS e, repeat, (row_number() OVER (PARTITION BY cohort, repeat ORDER BY md5('{SEED}|' || repeat || '|' || entity), entity) - 1) % 5 AS fold FROM v1, (SELECT unnest(range(0, 2)) AS repeat)) ON e = entity),
s AS (SELECT a.cohort, a.repeat, a.feature, a.fold, stddev_samp(b.res) AS sd FROM (SELECT DISTINCT cohort, repeat, feature, fold FROM t) a JOIN t b ON b.cohort = a.cohort AND b.repeat = a.repeat AND b.feature = a.feature AND b.fold <> a.fold GROUP BY 1, 2, 3, 4)"""


@query("j15_standardized_residuals", f"""WITH {_J15} SELECT t.cohort, t.entity, t.feature, {r('avg(res / sd)')} AS residual FROM t JOIN s ON s.cohort = t.cohort AND s.repeat = t.repeat AND s.feature = t.feature AND s.fold = t.fold WHERE sd > 1e-8 GROUP BY 1, 2, 3""", "v1 v13")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    assign = fo.kfold(view(spark, sf, "v1"), ["cohort"], "entity", 5, 2, SEED)
    rows = materialize(view(spark, sf, "v13").join(assign, ["cohort", "entity"]), "rows")
    return _r(rg.standardized_residuals(rows), "residual")


@query("j15_oof_model_residuals")
def j15_oof(spark: SparkSession, sf: str) -> DataFrame:
    data, pred, models = _oof(spark, sf)
    return _r(rg.oof_residuals(data, pred, models), "residual", "pred", "obs")


@query("j16_principal_axes")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    v = xy_vectors(spark, sf)
    return _r(rg.pca(v, ["cohort"], 16).select("cohort", "component", "explained_ratio"), "explained_ratio")


# Two standardised columns have the variances 1 + |r| and 1 - |r|.
@query("j16_two_column_axes", f"""WITH t AS (SELECT cohort, abs(corr(embedding[1]::DOUBLE, embedding[2]::DOUBLE)) AS r FROM v5 GROUP BY 1)
SELECT cohort, component::INT AS component, {r('(1 + CASE WHEN component = 0 THEN r ELSE -r END) / 2')} AS explained_ratio FROM t, (SELECT unnest(range(0, 2)) AS component)""", "v5")
def j16_two(spark: SparkSession, sf: str) -> DataFrame:
    v = xy_vectors(spark, sf).withColumn("x", F.slice("x", 1, 2))
    return _r(rg.pca(v, ["cohort"], 2).select("cohort", "component", "explained_ratio"), "explained_ratio")


@query("j16_principal_scores")
def j16_scores(spark: SparkSession, sf: str) -> DataFrame:
    v = materialize(xy_vectors(spark, sf), "xy")
    axes = materialize(rg.pca(v, ["cohort"], 4), "axes")
    s = rg.apply_models(v, rg.pca_models(axes, ["cohort"]), ["cohort"], ["entity"], out="s")
    return _r(s.select("cohort", "entity", F.posexplode("s").alias("component", "score")), "score")


def _clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = materialize(view(spark, sf, "v5").withColumn("k", F.lit(0)).withColumn("x", F.col("embedding").cast("array<double>")), "items")
    axes = materialize(rg.pca(v, ["k"], 10), "axes")
    s = materialize(rg.apply_models(v, rg.pca_models(axes, ["k"]), ["k"], ["cohort", "entity", "bag", "item", "label"], out="s"), "scores")
    out, stability, _ = cl.kmeans_repeated(s, "s", cl.cluster_count(s.count()), [SEED + i for i in range(3)])
    return out, stability


@query("j17_kmeans_stability")
def j17(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf)[1]


@query("j17_cluster_summary")
def j17_summary(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = _clusters(spark, sf)
    out = out.withColumn("score", F.get("s", F.lit(0)))
    ranked = materialize(wn.percentile_rank(out.select("cluster", "cohort", "entity", "bag", "item", "score"), ["cohort"], "score", "item"), "ranked")
    return _r(cl.cluster_summary(ranked, "cluster", ["entity"], ["cohort", "entity", "bag"], "score", "percentile"), "mean_score", "median_percentile")


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Sign-split, z-scored entity vectors; absent cells are 0."""
    z = materialize(sc.standardised(view(spark, sf, "v2")), "z")
    names = feature_names(z, "feature")
    v = to_vectors(z, ["cohort", "entity"], "feature", "z", names)
    v = v.withColumn("x", F.transform("x", lambda a: F.coalesce(a, F.lit(0.0))))
    return materialize(fa.split_vector(v), "split"), [f"{s}__a__{n}" for s in ("pos", "neg") for n in names]


@query("j18_nmf_scores")
def j18(spark: SparkSession, sf: str) -> DataFrame:
    v, _ = _split(spark, sf)
    fits = [{"rank": 3, "start": s} for s in range(3)]
    res = fa.nmf(v, fits, SEED, iterations=15)
    w = fa.scores(v, {0: res["factors"][fa.best_fit(res, fits)]}, ["cohort", "entity"])
    return _r(fa.score_table(w, ["cohort", "entity"]), "score", "fraction", "dominant_fraction")


@query("j18_nmf_loadings")
def j18_load(spark: SparkSession, sf: str) -> DataFrame:
    v, names = _split(spark, sf)
    fits = [{"rank": 3, "start": s} for s in range(3)]
    res = fa.nmf(v, fits, SEED, iterations=15)
    return _r(fa.loading_table(v, res["factors"][fa.best_fit(res, fits)], names), "loading", "loading_fraction")


_PAIR = "p AS (SELECT a.entity AS i, b.entity AS j, count(*) FILTER (WHERE a.label = b.label) / 8e0 AS c FROM v14 a JOIN v14 b ON a.start = b.start AND a.entity <> b.entity GROUP BY 1, 2)"
_FINAL = "f AS (SELECT c_custkey AS entity, c_nationkey % 4 AS cluster FROM customer)"


@query("j19_consensus_statistics", f"""WITH {_PAIR}, {_FINAL}, q AS (SELECT i, j, c, fi.cluster AS own, fj.cluster AS other FROM p JOIN f fi ON fi.entity = i JOIN f fj ON fj.entity = j),
g AS (SELECT i, own, other, avg(1 - c) AS d FROM q GROUP BY 1, 2, 3), s AS (SELECT i, max(d) FILTER (WHERE own = other) AS a, min(d) FILTER (WHERE own <> other) AS b FROM g GROUP BY 1)
SELECT {r('(SELECT avg(4 * (c - 0.5) * (c - 0.5)) FROM p)')} AS dispersion, {r('(SELECT avg((b - a) / greatest(a, b)) FROM s)')} AS silhouette, {r('avg(c) FILTER (WHERE own = other)')} AS within_mean,
{r('avg(c) FILTER (WHERE own <> other)')} AS between_mean, {r('avg(c) FILTER (WHERE own = other) - avg(c) FILTER (WHERE own <> other)')} AS margin FROM q""", "v14")
def j19(spark: SparkSession, sf: str) -> DataFrame:
    final = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), (F.col("c_nationkey") % 4).alias("cluster"))
    s = fa.rank_stability(materialize(view(spark, sf, "v14"), "labels"), final)
    cols = ["dispersion", "silhouette", "within_mean", "between_mean", "margin"]
    return _r(s.select(*cols), *cols)


@query("j19_consensus_over_bootstraps")
def j19_boot(spark: SparkSession, sf: str) -> DataFrame:
    v, _ = _split(spark, sf)
    ranks, starts = [2, 3], 3
    data = materialize(v.join(fa.balanced_multiplicities(v, starts, SEED), ["cohort", "entity"]), "weighted")
    boots = [{"rank": k, "start": s} for k in ranks for s in range(starts)]
    res = fa.nmf(data, boots, SEED, iterations=8, weights="multiplicity")
    full = [{"rank": k, "start": s} for k in ranks for s in range(2)]
    whole = fa.nmf(v, full, SEED + 1, iterations=8)
    labels = materialize(fa.scores(v, res["factors"], ["cohort", "entity"]).select("cohort", "entity", "fit", "label"), "labels")
    out = None
    for k in ranks:
        mine = [i for i, f in enumerate(boots) if f["rank"] == k]
        final = fa.scores(v, {0: whole["factors"][fa.best_fit(whole, full, lambda f, k=k: f["rank"] == k)]}, ["cohort", "entity"]).select("entity", F.col("label").alias("cluster"))
        err = sum((res["history"][i][-1] / (res["rows"][i] * res["width"])) ** 0.5 for i in mine) / len(mine)
        s = fa.rank_stability(labels.where(F.col("fit").isin(mine)).withColumnRenamed("fit", "start"), materialize(final, "final"))
        s = s.select(F.lit(k).alias("rank"), F.lit(err).alias("mean_error"), F.col("dispersion").alias("stability"), "silhouette", "within_mean", "between_mean", "margin")
        out = s if out is None else out.unionByName(s)
    return _r(fa.choose_rank(materialize(out, "stability")), "mean_error", "stability", "silhouette", "within_mean", "between_mean", "margin", "selection_score")


@query("j20_balanced_bootstrap", f"""WITH pos AS (SELECT cohort, entity, row_number() OVER (PARTITION BY cohort ORDER BY md5('{SEED}|' || entity), entity) AS pos, count(*) OVER (PARTITION BY cohort) AS n FROM v1),
d AS (SELECT cohort, start, ('0x' || left(md5('{SEED}|' || start || '|' || cohort || '|' || pos), 12))::BIGINT % n + 1 AS pos FROM pos, (SELECT unnest(range(0, 4)) AS start) WHERE pos <= (SELECT min(n) FROM pos))
SELECT d.cohort, p.entity, start::INT AS start, count(*) AS n_draws FROM d JOIN pos p ON p.cohort = d.cohort AND p.pos = d.pos GROUP BY 1, 2, 3""", "v1")
def j20(spark: SparkSession, sf: str) -> DataFrame:
    m = fa.balanced_multiplicities(view(spark, sf, "v1"), 4, SEED)
    return m.select("cohort", "entity", F.explode("multiplicity").alias("start", "n_draws"))


@query("j21_rank_selection", f"""WITH t AS (SELECT nation % 7 + 2 AS rank, avg(value) / 10000 AS mean_error, stddev_samp(value) / 5000 AS stability, CASE WHEN nation % 7 <> 3 THEN corr(value, entity) END AS silhouette, avg(CASE WHEN value > 4000 THEN 1e0 ELSE 0e0 END) AS margin FROM v1 GROUP BY nation % 7),
l AS (SELECT max(mean_error) AS eh, min(mean_error) AS el, max(rank) AS rh, min(rank) AS rl FROM t),
s AS (SELECT rank, 0.35e0 * stability + 0.25e0 * coalesce(silhouette, 0) + 0.25e0 * margin + 0.15e0 * (eh - mean_error) / (eh - el + 1e-12) - 0.05e0 * (rank - rl) / (rh - rl + 1e-12) AS score FROM t, l)
SELECT rank, {r('score')} AS selection_score, score = (SELECT max(score) FROM s) AS chosen FROM s""", "v1")
def j21(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "v1").withColumn("rank", F.col("nation") % 7 + 2).groupBy("rank").agg(
        (F.avg("value") / 10000).alias("mean_error"), (F.stddev_samp("value") / 5000).alias("stability"),
        F.when(F.col("rank") != 5, F.corr("value", F.col("entity").cast("double"))).alias("silhouette"), F.avg((F.col("value") > 4000).cast("double")).alias("margin"))
    return _r(fa.choose_rank(materialize(t)).select("rank", "selection_score", "chosen"), "selection_score")


@query("j22_leave_cohort_out_factors")
def j22(spark: SparkSession, sf: str) -> DataFrame:
    v, _ = _split(spark, sf)
    cohorts = [c[0] for c in v.select("cohort").distinct().orderBy("cohort").collect()]  # a name per cohort, however many
    fits = [{"rank": 3, "start": s} for s in range(2)] + [{"rank": 3, "start": s, "held": c} for c in cohorts for s in range(2)]
    res = fa.nmf(v, fits, SEED, iterations=10)
    full = res["factors"][fa.best_fit(res, fits, lambda f: "held" not in f)]
    local = {i: res["factors"][fa.best_fit(res, fits, lambda f, c=c: f.get("held") == c)] for i, c in enumerate(cohorts)}
    ref = spark.createDataFrame([(f"A{k + 1}", [float(x) for x in h]) for k, h in enumerate(full)], "label string, x array<double>")
    mine = spark.createDataFrame([(cohorts[i], f"local_A{k + 1}", [float(x) for x in row]) for i, h in local.items() for k, row in enumerate(h)], "held string, local_factor string, x array<double>")
    match = best_match(mine, ["held", "local_factor"], "x", ref, "label", "x")
    w = fa.scores(v, local, ["cohort", "entity"])
    names = F.array(*[F.lit(c) for c in cohorts])
    w = w.where(F.get(names, F.col("fit")) == F.col("cohort")).select("cohort", F.posexplode("w").alias("k", "score"))
    s = w.groupBy(F.col("cohort").alias("held"), F.concat(F.lit("local_A"), (F.col("k") + 1).cast("string")).alias("local_factor")).agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n_held"))
    return _r(match.join(s, ["held", "local_factor"]), "cosine", "mean_score")
