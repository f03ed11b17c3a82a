"""Many logistic models at once by grouped Newton steps.

Each step is one Spark aggregate over all models: gradients and information
matrices are sums of built-in column expressions for a few predictors, and
partial numpy sums for wide inputs. Only the small per-model systems are solved
outside SQL, one row per model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions import tails
from cohortwise.functions.numeric import logit, ratio
from cohortwise.operators import moments as mo
from cohortwise.operators import newton as nt
from cohortwise.operators import stats as st
from cohortwise.operators.folds import stratified_kfold
from cohortwise.operators.ordering import quantiles
from cohortwise.operators.regression import apply_models, bootstrap_weights, width
from cohortwise.operators.vectors import bounded_rows, matrix
from cohortwise.operators.windows import bh_adjust, zscore_sample
from cohortwise.session import materialize

# Penalty, exponent clip, confidence multiplier, events per variable.
RIDGE, ETA_CLIP, CI_Z, MIN_EPV = 1e-6, 35.0, 1.96, 10.0
MAX_MODELS = 20_000


def _eta(beta: Column, x: Column, p: int) -> Column:
    e = F.get(beta, F.lit(0))
    for j in range(p):
        e = e + F.get(beta, F.lit(j + 1)) * F.get(x, F.lit(j))
    return F.least(F.greatest(e, F.lit(-ETA_CLIP)), F.lit(ETA_CLIP))


def _prob(beta: Column, x: Column, p: int) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_eta(beta, x, p)))


def eligibility(df: DataFrame, keys: Sequence[str], p: Column, weight: Column | None = None) -> DataFrame:
    """Counts per model and why it cannot be fitted.

    ``p`` is the number of used predictors of the model.
    """
    w = weight if weight is not None else F.lit(1)
    g = df.groupBy(*keys).agg(F.sum(w).cast("bigint").alias("n"), F.sum(F.col("y") * w).cast("bigint").alias("events"), F.max(p).alias("variables"))
    low = F.least(F.col("events"), F.col("n") - F.col("events"))
    reason = F.when(low == 0, "less_than_two_classes").when(low < F.col("variables") + 2, "insufficient_events_per_parameter").otherwise("")
    return (g.withColumn("skip_reason", reason).withColumn("status", F.when(reason == "", "PASS").otherwise("SKIP"))
            .withColumn("epv", ratio(low, F.greatest("variables", F.lit(1)))))


def newton_fit(df: DataFrame, keys: Sequence[str], p: int, ridge: float = RIDGE, weight: str | None = None, start: Sequence[float] | None = None,
               max_iter: int = 30, tol: float = 1e-9) -> DataFrame:
    """Penalised maximum likelihood per key; the intercept is not penalised.

    Rows are ``(keys, x array, y)``, best given as a written table because every
    step reads those of the models still open. Returns ``(keys, beta, se,
    converged)``, see :func:`newton.iterate`. Unused (all-zero) inputs keep a
    zero coefficient.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rate = F.least(F.greatest(F.sum(w * F.col("y")) / F.sum(w), F.lit(1e-4)), F.lit(1 - 1e-4))
    first = F.log(rate / (F.lit(1.0) - rate)) if start is None else F.lit(float(start[0]))
    init = [first] + [F.lit(0.0 if start is None else float(start[j + 1])) for j in range(p)]
    keys, m = list(keys), p + 1
    xs = [F.lit(1.0)] + [F.get("x", F.lit(i)) for i in range(p)]

    def sums(points: DataFrame) -> DataFrame:
        j = df.join(points, keys).withColumn("__e", _eta(F.col("beta"), F.col("x"), p))
        j = j.withColumn("__p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__e"))))
        r = w * (F.col("y") - F.col("__p"))
        v = w * F.col("__p") * (F.lit(1.0) - F.col("__p"))
        ll = F.sum(w * (F.col("y") * F.col("__e") - F.log1p(F.exp("__e")))).alias("ll")
        g = F.array(*[F.sum(r * x) for x in xs]).alias("g")
        h = F.array(*[F.sum(v * xs[a] * xs[b]) for a in range(m) for b in range(a, m)]).alias("h")
        return j.groupBy(*keys).agg(ll, g, h)

    begin = df.groupBy(*keys).agg(F.array(*init).alias("beta"))
    fit = nt.iterate(begin, keys, sums, lambda row, size: np.array([0.0] + [ridge] * (size - 1)), max_iter, tol, 1e-6)
    return fit.select(*keys, "beta", "se", "converged")


def fitted(df: DataFrame, fit: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    return df.join(fit.select(*keys, "beta"), list(keys)).withColumn("prob", _prob(F.col("beta"), F.col("x"), p)).drop("beta")


def calibration(df: DataFrame, keys: Sequence[str], y: str = "y", prob: str = "prob") -> DataFrame:
    """Intercept and slope of the outcome refitted on the log odds."""
    rows = df.where(F.col(y).isNotNull() & F.col(prob).isNotNull()).select(*keys, F.col(y).alias("y"), F.array(logit(F.col(prob))).alias("x"))
    ok = rows.groupBy(*keys).agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.stddev_pop(F.col("x")[0]).alias("s"))
    usable = materialize(ok.where("lo < hi AND s > 1e-10").select(*keys), "usable")
    fit = newton_fit(rows.join(usable, list(keys), "left_semi"), keys, 1, ridge=0.0, start=[0.0, 1.0])
    res = ok.select(*keys).join(fit, list(keys), "left")
    status = F.when(F.col("beta").isNull(), "SKIP").when(F.col("converged"), "PASS").otherwise("WARN")
    return res.select(*keys, F.get("beta", F.lit(0)).alias("calibration_intercept"), F.get("beta", F.lit(1)).alias("calibration_slope"), status.alias("calibration_status"))


def spec_rows(df: DataFrame, specs: dict[str, Sequence[str]], endpoints: Sequence[str], p: int) -> DataFrame:
    """One row per entity, endpoint and model with its complete, padded inputs.

    Predictors constant within (endpoint, cohort) are dropped; ``used`` lists
    the rest. The model list is a literal array, so rows are exploded once.
    """
    ends = F.inline(F.array(*[F.struct(F.lit(e).alias("endpoint"), F.col(e).cast("double").alias("y")) for e in endpoints]))
    base = df.select("cohort", "entity", *sorted({c for v in specs.values() for c in v}), ends)
    models = F.inline(F.array(*[F.struct(F.lit(name).alias("model"),
                                         F.array(*[F.lit(c) for c in cols]).alias("names"),
                                         F.array(*[F.col(c).cast("double") for c in cols]).alias("raw")) for name, cols in specs.items()]))
    rows = base.select("cohort", "entity", "endpoint", "y", models).where(F.col("y").isNotNull())
    keys = ["endpoint", "cohort", "model"]
    vary = (rows.select(*keys, "names", F.posexplode("raw").alias("pos", "v")).groupBy(*keys, "pos").agg(F.max("v").alias("hi"), F.min("v").alias("lo"), F.first("names").alias("names"))
            .where("hi > lo").groupBy(*keys).agg(F.array_sort(F.collect_list("pos")).alias("use"), F.first("names").alias("n")))
    vary = materialize(vary.select(*keys, "use", F.transform("use", lambda i: F.get("n", i)).alias("used")), "usable")
    j = rows.join(vary, keys)
    x = F.transform("use", lambda i: F.get("raw", i))
    j = j.withColumn("x", x).where(~F.exists("x", lambda v: v.isNull()))
    padded = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.coalesce(F.get("x", i), F.lit(0.0)))
    return j.select(*keys, "entity", "y", padded.alias("x"), "used")


def model_terms(rows: DataFrame, p: int, metrics: bool = True, with_p: bool = True) -> DataFrame:
    """Fit every (endpoint, cohort, model) and report one row per term."""
    keys = ["endpoint", "cohort", "model"]
    rows = materialize(rows, "design")
    info = materialize(eligibility(rows, keys, F.size("used")).join(rows.groupBy(*keys).agg(F.first("used").alias("used")), keys), "eligible")
    go = rows.join(info.where("status = 'PASS'").select(*keys), keys, "left_semi").drop("used")
    fit = newton_fit(go, keys, p)
    out = info.join(fit, keys, "left")
    if metrics:
        probs = materialize(fitted(go, fit, keys, p).select(*keys, "y", "prob"), "probs")
        out = out.join(st.classification_metrics(probs, keys, "y", "prob").drop("n", "events"), keys, "left").join(calibration(probs, keys), keys, "left")
    term = F.posexplode(F.when(F.col("status") == "PASS", F.concat(F.array(F.lit("intercept")), "used")).otherwise(F.array(F.lit(""))))
    extra = [c for c in out.columns if c not in (*keys, "used", "beta", "se")]
    t = out.select(*keys, *extra, "beta", "se", term.alias("k", "term"))
    t = t.withColumn("coef", F.get("beta", F.col("k"))).withColumn("std_err", F.get("se", F.col("k"))).drop("beta", "se", "k")
    t = (t.withColumn("z", F.try_divide("coef", "std_err")).withColumn("odds_ratio", F.exp("coef"))
         .withColumn("ci95_low", F.exp(F.col("coef") - CI_Z * F.col("std_err"))).withColumn("ci95_high", F.exp(F.col("coef") + CI_Z * F.col("std_err"))))
    if not with_p:
        return t
    t = materialize(t.withColumn("p", tails.normal_two_sided_p(F.col("z"))), "terms")
    tested = F.col("term") != "intercept"
    return bh_adjust(t.where(tested), ["endpoint"], "p", "q").unionByName(t.where(~tested).withColumn("q", F.lit(None).cast("double")))


def model_diagnostics(terms: DataFrame) -> DataFrame:
    """One row per model: WARN for few events per variable or poor calibration."""
    m = terms.select("endpoint", "cohort", "model", "n", "events", "status", "skip_reason", "epv", "calibration_status").distinct()
    warn = (F.col("epv") < MIN_EPV) | (F.coalesce("calibration_status", F.lit("SKIP")) != "PASS")
    return m.withColumn("diagnostic", F.when(F.col("status") == "SKIP", "SKIP").when(warn, "WARN").otherwise("PASS"))


def bootstrap_effects(df: DataFrame, p: int, term: int, draws: int, seed: int) -> DataFrame:
    """Median and 95% interval of one coefficient over resamples within the cohort."""
    w = materialize(bootstrap_weights(df, ["cohort"], "entity", draws, seed), "weights")
    rows = df.select("cohort", "entity", "x", "y").join(w, ["cohort", "entity"])
    keys = ["cohort", "draw"]
    ok = materialize(eligibility(rows, keys, F.lit(p), F.col("w")).where("status = 'PASS'").select(*keys), "draws")
    fit = newton_fit(materialize(rows.join(ok, keys, "left_semi"), "resamples"), keys, p, weight="w", tol=1e-7)
    coef = fit.where("converged").select("cohort", F.get("beta", F.lit(term)).alias("coef"))
    q = quantiles(coef, ["cohort"], "coef", {"coef_median": 0.5, "coef_low": 0.025, "coef_high": 0.975})
    n = coef.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_success"))
    out = df.select("cohort").distinct().join(n, "cohort", "left").join(q, "cohort", "left").withColumn("n_success", F.coalesce("n_success", F.lit(0)))
    enough = F.col("n_success") >= max(30, int(0.2 * draws))
    vals = [F.when(enough, F.col(c)).alias(c) for c in ("coef_median", "coef_low", "coef_high")]
    ors = [F.exp(F.when(enough, F.col(c))).alias(c.replace("coef", "or")) for c in ("coef_median", "coef_low", "coef_high")]
    return out.select("cohort", "n_success", *vals, *ors, F.when(enough, "PASS").otherwise("WARN").alias("status"))


def _newton_move(betas: dict[tuple, np.ndarray], c: float):
    def move(key, part: pd.DataFrame) -> pd.DataFrame:
        m = matrix(part.sort_values("i")["v"])
        b = betas[tuple(key)]
        pen = np.diag([0.0] + [1.0 / c] * (len(b) - 1))
        d = np.linalg.solve(m[1:] + pen, m[0] - pen @ b)
        return pd.DataFrame([{"cohort": key[0], "repeat": key[1], "fold": key[2], "beta": b + d, "move": float(np.abs(d).max())}])

    return move


def balanced_oof(df: DataFrame, folds: int, repeats: int, seed: int, max_components: int, c: float = 1.0, max_iter: int = 25, tol: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    """Class-balanced penalised logistic risk, out of fold and averaged over repeats.

    Scaling and rotation come from training moments. Every step evaluates all
    training models of a row inside one pass; the models (size-checked) travel
    with the tasks and only small sums leave them.
    """
    p = width(df, "x")
    base = materialize(df.where(F.col("y").isNotNull()).select("cohort", "entity", "x", F.col("y").cast("double").alias("y")), "base")
    assign = materialize(stratified_kfold(base, ["cohort"], "entity", "y", folds, repeats, seed), "folds")
    rows = materialize(base.join(assign.select("cohort", "entity", "repeat", "fold"), ["cohort", "entity"]), "rows")
    g = mo.grouped_moments(rows.withColumn("y", F.array("y")), ["cohort", "repeat", "fold"])

    def start(key, part: pd.DataFrame) -> pd.DataFrame:
        cells = {k: mo.unpack(v) for k, v in part.groupby("fold")}
        out = []
        for fold, m in sorted(mo.others(cells).items()):
            axes, _ = mo.principal_axes(m, max(1, min(max_components, p, int(m.n) - 1)))
            pos = float(m.n * m.my[0])
            out.append({"cohort": key[0], "repeat": key[1], "fold": fold, "centre": m.mx, "t": (axes / m.sdx[:, None]).ravel(), "k": int(axes.shape[1]),
                        "w1": float(m.n / (2 * max(pos, 1e-300))), "w0": float(m.n / (2 * max(m.n - pos, 1e-300))), "beta": np.zeros(axes.shape[1] + 1)})
        return pd.DataFrame(out, columns=["cohort", "repeat", "fold", "centre", "t", "k", "w1", "w0", "beta"])

    fields = "cohort string, repeat int, fold int, centre array<double>, t array<double>, k int, w1 double, w0 double, beta array<double>"
    models = bounded_rows(g.groupBy("cohort", "repeat").applyInPandas(start, fields), MAX_MODELS, "fold models")
    specs: dict[tuple, dict] = {}
    for r in models:
        specs[(r["cohort"], r["repeat"], r["fold"])] = {"mean": np.array(r["centre"]), "t": np.array(r["t"]).reshape(p, -1), "w": (r["w0"], r["w1"]), "beta": np.array(r["beta"])}

    for _ in range(max_iter):
        now = {k: dict(v) for k, v in specs.items()}

        def partial(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            held: dict[tuple, np.ndarray] = {}
            for pdf in batches:
                for (cohort, repeat), part in pdf.groupby(["cohort", "repeat"], sort=False):
                    x, y, own = matrix(part["x"]), part["y"].to_numpy(dtype=float), part["fold"].to_numpy()
                    for key, s in now.items():
                        if key[0] != cohort or key[1] != repeat:
                            continue
                        use = own != key[2]
                        if not use.any():
                            continue
                        z = np.hstack([np.ones((use.sum(), 1)), (x[use] - s["mean"]) @ s["t"]])
                        pr = 1.0 / (1.0 + np.exp(-np.clip(z @ s["beta"], -ETA_CLIP, ETA_CLIP)))
                        w = np.where(y[use] == 1, s["w"][1], s["w"][0])
                        h = (z * (w * pr * (1 - pr))[:, None]).T @ z
                        part_sum = np.vstack([z.T @ (w * (y[use] - pr)), h])
                        held[key] = held[key] + part_sum if key in held else part_sum
            for key, v in held.items():
                yield pd.DataFrame({"cohort": key[0], "repeat": key[1], "fold": key[2], "i": range(len(v)), "v": list(v)})

        sums = mo.sum_arrays(rows.mapInPandas(partial, "cohort string, repeat int, fold int, i int, v array<double>"), ["cohort", "repeat", "fold", "i"], "v")

        new = sums.groupBy("cohort", "repeat", "fold").applyInPandas(_newton_move({k: v["beta"] for k, v in now.items()}, c),
                                                                     "cohort string, repeat int, fold int, beta array<double>, move double").collect()
        for r in new:
            specs[(r["cohort"], r["repeat"], r["fold"])]["beta"] = np.array(r["beta"])
        if max((r["move"] for r in new), default=0.0) < tol:
            break
    packed = []
    for (cohort, repeat, fold), s in specs.items():
        coef = s["t"] @ s["beta"][1:]
        packed.append((cohort, int(repeat), int(fold), [float(s["beta"][0] - s["mean"] @ coef)], [float(v) for v in coef]))
    final = df.sparkSession.createDataFrame(packed, "cohort string, repeat int, fold int, intercept array<double>, coef array<double>")
    pred = apply_models(rows, final, ["cohort", "repeat", "fold"], ["entity", "y"])
    risk = F.avg(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.get("pred", F.lit(0)))))
    oof = pred.groupBy("cohort", "entity", "y").agg(risk.alias("risk"), F.count(F.lit(1)).alias("n"))
    ok = F.assert_true(F.col("n") == repeats, F.lit("an entity was not predicted once per repeat"))
    oof = materialize(oof.where(ok.isNull()).drop("n"), "risk")
    return zscore_sample(oof, ["cohort"], "risk", "risk_z"), st.classification_metrics(oof, ["cohort"], "y", "risk")
