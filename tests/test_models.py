"""Moment-based models against direct NumPy computations on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwise.operators import factors as fa
from cohortwise.operators import folds as fo
from cohortwise.operators import logistic as lo
from cohortwise.operators import moments as mo
from cohortwise.operators import regression as rg
from cohortwise.operators import resample as rs
from cohortwise.operators import survival as sv
from cohortwise.operators.impute import knn_impute, median_fill
from cohortwise.plans import catalog

N, P, Q = 90, 5, 3


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, P)) * [1, 2, 3, 1, 5] + [0, 5, -3, 1, 2]
    y = x @ rng.normal(size=(P, Q)) + rng.normal(size=(N, Q)) * 3 + 4
    cohort = np.where(np.arange(N) < 60, "a", "b")
    rows = [(str(c), int(i), [float(v) for v in x[i]], [float(v) for v in y[i]]) for i, c in enumerate(cohort)]
    df = spark.createDataFrame(rows, "cohort string, entity int, x array<double>, y array<double>").repartition(5).cache()
    return x, y, cohort, df


def standard(x):
    sd = x.std(axis=0)
    return x.mean(axis=0), np.where(sd > 0, sd, 1.0)


def ridge(z, y, a):
    zm, ym = z.mean(axis=0), y.mean(axis=0)
    b = np.linalg.solve((z - zm).T @ (z - zm) + a * np.eye(z.shape[1]), (z - zm).T @ (y - ym))
    return b, ym - zm @ b


def test_moments_of_the_other_folds_are_train(data):
    x, y, cohort, df = data
    rows = df.withColumn("fold", F.col("entity") % 3)
    g = mo.grouped_moments(rows, ["cohort", "fold"]).toPandas()
    cells = {k: mo.unpack(v) for k, v in g[g["cohort"] == "a"].groupby("fold")}
    m = mo.others(cells)[1]
    use = (cohort == "a") & (np.arange(N) % 3 != 1)
    assert m.n == use.sum()
    np.testing.assert_allclose(np.concatenate([m.mx, m.my]), np.hstack([x, y])[use].mean(axis=0), rtol=1e-10)
    xc, yc = x[use] - x[use].mean(axis=0), y[use] - y[use].mean(axis=0)
    np.testing.assert_allclose(m.cxx, xc.T @ xc, rtol=1e-10, atol=1e-9)
    np.testing.assert_allclose(m.cxy, xc.T @ yc, rtol=1e-10, atol=1e-9)
    np.testing.assert_allclose(m.cyy, (yc * yc).sum(axis=0), rtol=1e-10)
    np.testing.assert_allclose(m.sd, x[use].std(axis=0), rtol=1e-10)


@pytest.mark.parametrize("components", [256, 3])
def test_crossfit_equals_direct_fit(data, components):
    x, y, cohort, df = data
    assign = rg.inner_assignments(df, 3, 2, 5).cache()
    rows = df.join(assign, ["cohort", "entity"])
    models = rg.crossfit_models(rows, max_components=components).toPandas()
    a = assign.toPandas()
    for m in models.itertuples():
        s = a[(a.cohort == m.cohort) & (a.repeat == m.repeat) & (a.fold != m.fold)].sort_values("entity")
        xt, yt, inner = x[s.entity], y[s.entity], s["inner"].to_numpy()
        mx, sx = standard(xt)
        my, sy = standard(yt)
        z0, ys = (xt - mx) / sx, (yt - my) / sy
        val, vec = np.linalg.eigh(np.cov(z0.T, bias=True))
        axes = vec[:, ::-1][:, :min(components, P, len(s) - 1)]
        z = z0 @ axes
        err = np.zeros(len(rg.ALPHAS))
        for i in np.unique(inner):
            for j, al in enumerate(rg.ALPHAS):
                b, b0 = ridge(z[inner != i], ys[inner != i], al)
                err[j] += ((ys[inner == i] - z[inner == i] @ b - b0) ** 2).mean()
        al = rg.ALPHAS[int(err.argmin())]
        assert m.alpha[0] == al
        b, b0 = ridge(z, ys, al)
        direct = (((x - mx) / sx) @ axes @ b + b0) * sy + my
        got = x @ np.array(m.coef).reshape(P, Q) + np.array(m.intercept)
        np.testing.assert_allclose(got, direct, rtol=1e-8, atol=1e-8)
        np.testing.assert_allclose(m.train_sd, (yt - direct[s.entity]).std(axis=0, ddof=1), rtol=1e-8)


def test_target_axes_with_all_variance_change_nothing(data):
    x, y, cohort, df = data
    assign = rg.inner_assignments(df, 3, 1, 5)
    g = mo.grouped_moments(df.join(assign, ["cohort", "entity"]), ["cohort"], full=True).toPandas()
    plain = mo.grouped_moments(df, ["cohort"]).toPandas()
    for c in ("a", "b"):
        full, base = mo.unpack(g[g.cohort == c]), mo.unpack(plain[plain.cohort == c])
        one = rg.fit_ridge(full, [], [1.0], 1, target_pca=True, variance=1.1, limit=Q)
        two = rg.fit_ridge(base, [], [1.0], 1)
        np.testing.assert_allclose(one["coef"], two["coef"], rtol=1e-7, atol=1e-9)
        np.testing.assert_allclose(one["intercept"], two["intercept"], rtol=1e-7)


def test_out_of_fold_predictions_and_residuals(data):
    x, y, cohort, df = data
    pred, models, assign = rg.crossfit(df, 3, 2, 5)
    mean = rg.mean_prediction(pred, 2).toPandas()
    assert len(mean) == N * Q
    p, m, a = pred.toPandas(), models.toPandas(), assign.toPandas()
    assert (a.groupby(["entity", "repeat"]).size() == 1).all()
    res = rg.oof_residuals(df, pred, models).toPandas().set_index(["entity", "position"])["residual"]
    want = np.zeros((N, Q))
    for r in p.itertuples():
        mod = m[(m.cohort == r.cohort) & (m.repeat == r.repeat) & (m.fold == r.fold)].iloc[0]
        np.testing.assert_allclose(r.pred, x[r.entity] @ np.array(mod["coef"]).reshape(P, Q) + np.array(mod["intercept"]), rtol=1e-9)
        want[r.entity] += (y[r.entity] - np.array(r.pred)) / np.array(mod["train_sd"]) / 2
    np.testing.assert_allclose([res[(i, j)] for i in range(N) for j in range(Q)], want.ravel(), rtol=1e-8)


def test_retraining_null_blocks_equal_separate_fits(spark, data):
    x, y, cohort, df = data
    null = rs.retraining_null(df, 2, 3, 1, 11).toPandas()
    assert sorted(null.perm.unique()) == [-1, 0, 1]
    pm = rs.permutation_map(df, 2, 11).toPandas()
    assert (pm.groupby(["cohort", "perm"])["donor"].nunique() == pm.groupby(["cohort", "perm"])["entity"].nunique()).all()
    donor = pm[pm.perm == 1].set_index("entity")["donor"].to_dict()
    shuffled = spark.createDataFrame([(str(cohort[i]), i, [float(v) for v in x[i]], [float(v) for v in y[donor[i]]]) for i in range(N)], df.schema)
    pred, _, _ = rg.crossfit(shuffled, 3, 1, 11)
    pp = {r["entity"]: r["pred"] for r in pred.collect()}
    for c in ("a", "b"):
        idx = np.flatnonzero(cohort == c)
        r = [np.corrcoef(y[idx, j], [pp[i][j] for i in idx])[0, 1] for j in range(Q)]
        got = null[(null.cohort == c) & (null.perm == 1)].iloc[0]
        assert got["mean"] == pytest.approx(np.mean(r), abs=1e-9)
        assert got["median"] == pytest.approx(np.median(r), abs=1e-9)


def test_retraining_null_in_parts(spark, data, monkeypatch):
    whole = rs.retraining_null(data[3], 5, 3, 2, 11, first=2).toPandas().sort_values(["cohort", "perm"])
    assert sorted(whole.perm.unique()) == [-1, 2, 3, 4, 5, 6]
    monkeypatch.setattr(rs, "AT_ONCE", 2)
    parts = rs.retraining_null(data[3], 5, 3, 2, 11, first=2).toPandas().sort_values(["cohort", "perm"])
    pd.testing.assert_frame_equal(whole.reset_index(drop=True), parts.reset_index(drop=True), rtol=1e-9)


@pytest.mark.parametrize("name", ["k2_retraining_null", "k2_retraining_verdict"])
def test_retraining_null_draws_all_permutations(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name == "k2_retraining_null":
        assert (got.groupby("cohort")["perm"].agg(lambda p: sorted(p) == list(range(-1, 100)))).all()
    else:
        assert (got["n_null"] == 100).all()


def test_leave_one_out_ridge(data):
    x, y, cohort, df = data
    models = rg.loo_ridge_models(df, P, Q, rg.LOO_ALPHAS, ["cohort"]).toPandas()
    for m in models.itertuples():
        xs, ys = x[cohort == m.cohort], y[cohort == m.cohort]
        mx, sx = standard(xs)
        z = (xs - mx) / sx
        err = []
        for al in rg.LOO_ALPHAS:
            e = 0.0
            for i in range(len(z)):
                keep = np.arange(len(z)) != i
                b, b0 = ridge(z[keep], ys[keep], al)
                e += ((ys[i] - z[i] @ b - b0) ** 2).mean()
            err.append(e)
        al = rg.LOO_ALPHAS[int(np.argmin(err))]
        assert m.alpha == pytest.approx(al)
        b, b0 = ridge(z, ys, al)
        np.testing.assert_allclose(xs @ np.array(m.coef).reshape(P, Q) + np.array(m.intercept), z @ b + b0, rtol=1e-7)


def test_bag_ridge(data):
    x, y, cohort, df = data
    rows = df.select(F.col("entity").alias("bag"), (F.col("entity") % 12).alias("entity"), "x", F.slice("y", 1, 1).alias("y"))
    model, alphas = rg.bag_ridge(rows, rg.ALPHAS, 4, 3)
    folds = {r["bag"]: r["fold"] for r in fo.group_kfold(rows, ["entity"], 4, 3).collect()}
    f = np.array([folds[i] for i in range(N)])
    mse = []
    for al in rg.ALPHAS:
        pred = np.zeros(N)
        for k in np.unique(f):
            mx, sx = standard(x[f != k])
            b, b0 = ridge((x[f != k] - mx) / sx, y[f != k, :1], al)
            pred[f == k] = (((x[f == k] - mx) / sx) @ b + b0)[:, 0]
        mse.append(((y[:, 0] - pred) ** 2).mean())
    got = alphas.toPandas().sort_values("alpha")
    np.testing.assert_allclose(got["mse"], mse, rtol=1e-8)
    assert got[got.chosen]["alpha"].iloc[0] == rg.ALPHAS[int(np.argmin(mse))]


def test_elastic_net_meets_optimality_conditions(data):
    x, y, cohort, df = data
    g = mo.unpack(mo.grouped_moments(df.withColumn("k", F.lit(0)), ["k"]).toPandas())
    mx, sx = standard(x)
    z = (x - mx) / sx
    for alpha, l1 in ((0.5, 0.5), (0.1, 0.9), (2.0, 0.9)):
        coef, gap = rg.elastic_net(g, alpha, l1, np.ones((P, Q), dtype=bool))
        assert (gap <= rg.GAP).all()
        for k in range(Q):
            b, yc = coef[:, k], y[:, k] - y[:, k].mean()
            grad = z.T @ (yc - z @ b) / N - alpha * (1 - l1) * b
            on = np.abs(b) > 1e-10
            np.testing.assert_allclose(grad[on], alpha * l1 * np.sign(b[on]), atol=1e-4)
            assert (np.abs(grad[~on]) <= alpha * l1 + 1e-6).all()


def test_elastic_net_stopped_early_is_a_warning(spark, data, monkeypatch):
    *_, df = data
    rows = df.withColumn("fold", F.col("entity") % 3)
    assert {r["status"] for r in rg.net_status(rg.net_models(rows, ["cohort"]), ["cohort"]).collect()} == {"PASS"}
    g = mo.unpack(mo.grouped_moments(df.withColumn("k", F.lit(0)), ["k"]).toPandas())
    monkeypatch.setattr(rg, "MAX_SWEEPS", 1)
    _, gap = rg.elastic_net(g, 0.01, 0.5, np.ones((P, Q), dtype=bool))
    assert (gap > rg.GAP).any()
    models = spark.createDataFrame([("a", 0, [0.1, 0.1], [0.5, 0.5], [1, 1], [0.0, 1e-3])], "cohort string, fold int, alpha array<double>, l1_ratio array<double>, selected array<int>, gap array<double>")
    assert [r["status"] for r in rg.net_status(models, ["cohort"]).orderBy("position").collect()] == ["PASS", "WARN"]


def test_elastic_nets_of_all_targets_equal_separate_fits(data):
    *_, df = data
    rows = df.withColumn("fold", F.col("entity") % 3)
    both = {(r.cohort, r.fold): r for r in rg.net_models(rows, ["cohort"], prefilter=3).collect()}
    for k in range(Q):
        for r in rg.net_models(rows.withColumn("y", F.slice("y", k + 1, 1)), ["cohort"], prefilter=3).collect():
            b = both[(r.cohort, r.fold)]
            assert (r.alpha[0], r.l1_ratio[0], r.selected[0]) == (b.alpha[k], b.l1_ratio[k], b.selected[k])
            np.testing.assert_allclose(r.coef, np.reshape(b.coef, (P, Q))[:, k], atol=1e-7)


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_moments_keep_digits_far_from_zero(spark, shift):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 3)) + [shift, -shift, 0]
    x[:, 2] = 0.1 + shift
    y = x[:, :1] - shift + rng.normal(size=(4000, 1))
    df = spark.createDataFrame([(int(i % 4), [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, y))], "fold int, x array<double>, y array<double>").repartition(7)
    cells = {k: mo.unpack(v) for k, v in mo.grouped_moments(df, ["fold"]).toPandas().groupby("fold")}
    m = mo.others(cells)[2]
    use = np.arange(4000) % 4 != 2
    xc, yc = x[use] - x[use].mean(axis=0), y[use] - y[use].mean(axis=0)
    np.testing.assert_allclose(m.cxx[:2, :2], xc[:, :2].T @ xc[:, :2], rtol=1e-8, atol=1e-5)
    np.testing.assert_allclose(m.cxy[:2], xc[:, :2].T @ yc, rtol=1e-8, atol=1e-5)
    assert m.sd[2] == 0.0 and m.sdx[2] == 1.0
    axes = rg.pca(df.withColumn("k", F.lit(0)), ["k"], 3).toPandas()
    assert axes["explained_ratio"].sum() == pytest.approx(1.0)


def test_bag_ridge_of_one_entity_has_no_errors(data):
    *_, df = data
    rows = df.select(F.col("entity").alias("bag"), F.lit(1).alias("entity"), "x", F.slice("y", 1, 1).alias("y"))
    model, alphas = rg.bag_ridge(rows, rg.ALPHAS, 4, 3)
    assert model.count() == 1 and all(r["mse"] is None for r in alphas.collect())


def test_label_shuffle_equals_correlations_of_joined_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(c, e, f"f{f}", None if rng.random() < 0.1 else float(rng.normal()), float(rng.normal())) for c, n in (("a", 12), ("b", 7)) for e in range(n) for f in range(5) if rng.random() > 0.2]
    rows += [("a", e, "flat", 1.0, float(e)) for e in range(12)] + [("b", 0, "one", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "cohort string, entity int, feature string, value double, pred double")
    monkeypatch.setattr(rs, "CELLS", 20)
    monkeypatch.setattr(rs, "DRAWS", 2)
    got = {(r.cohort, r.perm, r.feature): r.pearson for r in rs.shuffled_correlations(df, 5, 3).collect()}
    lends = {(r.cohort, r.perm, r.entity): r.donor for r in rs.permutation_map(df, 5, 3).collect()}
    value = {(c, e, f): v for c, e, f, v, _ in rows}
    assert len(got) == 5 * len({(c, f) for c, _, f, _, _ in rows})
    for (c, perm, f), r in got.items():
        pairs = [(value.get((c, lends[(c, perm, e)], f)), p) for cc, e, ff, _, p in rows if (cc, ff) == (c, f)]
        pairs = np.array([p for p in pairs if p[0] is not None]).reshape(-1, 2)
        if len(pairs) < 2 or pairs.std(axis=0).min() < 1e-12:
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(pairs.T)[0, 1], abs=1e-9)


def test_label_shuffle_tasks_take_bounded_orders_and_features(spark, monkeypatch):
    df = spark.createDataFrame([("a", e, f"f{f}", float(e * f % 7), float(e % 5)) for e in range(30) for f in range(9)], "cohort string, entity int, feature string, value double, pred double")
    whole = {(r.perm, r.feature): r.pearson for r in rs.shuffled_correlations(df, 6, 3).collect()}
    monkeypatch.setattr(rs, "CELLS", 70)
    real, seen = rs._row_correlations, spark.sparkContext.accumulator(0)

    def counted(o, p):
        seen.add(1)
        return real(o, p)

    monkeypatch.setattr(rs, "_row_correlations", counted)
    cut = rs.shuffled_correlations(df, 6, 3)
    got = {(r.perm, r.feature): r.pearson for r in cut.collect()}
    # Two features and two orders a task: 5 groups of features, one product for each order.
    assert seen.value == 5 * 6
    assert set(got) == set(whole) and all(got[k] == pytest.approx(whole[k], nan_ok=True) if whole[k] is not None else got[k] is None for k in whole)


def test_dispersion_counts_pairs(spark, monkeypatch):
    from cohortwise.operators import consensus as cs

    rng = np.random.default_rng(2)
    lab = rng.integers(0, 3, size=(6, 9)).repeat(3, axis=0)
    df = spark.createDataFrame([(e, s, int(lab[e, s])) for e in range(18) for s in range(9)], "entity int, start int, label int")
    monkeypatch.setattr(cs, "STRIP", 5)
    c = np.array([(a == b).mean() for i, a in enumerate(lab) for j, b in enumerate(lab) if i != j])
    got = cs.dispersion(df).first()
    assert (got["n"], got["starts"]) == (18, 9)
    assert got["mean_consensus"] == pytest.approx(c.mean()) and got["dispersion"] == pytest.approx((4 * (c - 0.5) ** 2).mean())
    assert cs.label_vectors(df).count() == len(np.unique(lab, axis=0))


def test_repeated_target_of_a_set_takes_the_first_row(spark):
    from cohortwise.operators import scoring as sc

    z = spark.createDataFrame([("a", 1, f, v) for f, v in (("X", 1.0), ("Y", 2.0))], "cohort string, entity int, feature string, z double")
    net = spark.createDataFrame([("s", "x", 3.0, 1), ("s", "X", -1.0, 2), ("s", "y", 1.0, 3)], "set_name string, feature string, weight double, line int")
    assert sc.weighted_scores(z, net, 2, order="line").first()["value"] == pytest.approx((3.0 + 2.0) / 4)
    assert sc.weighted_scores(z, net, 2).first()["value"] == pytest.approx((-1.0 + 2.0) / 2)


def test_bootstrap_weights_are_resamples(data):
    *_, df = data
    w = rg.bootstrap_weights(df, ["cohort"], "entity", 4, 9).toPandas()
    n = w.groupby(["cohort", "draw"])["w"].sum()
    assert (n.loc["a"] == 60).all() and (n.loc["b"] == 30).all()


def test_pca(data):
    x, y, cohort, df = data
    axes = rg.pca(df, ["cohort"], P).toPandas()
    s = rg.apply_models(df, rg.pca_models(rg.pca(df, ["cohort"], 2), ["cohort"]), ["cohort"], ["entity"], out="s").toPandas()
    for c in ("a", "b"):
        xs = x[cohort == c]
        mx, sx = standard(xs)
        val = np.linalg.eigvalsh(np.corrcoef(xs.T))[::-1]
        np.testing.assert_allclose(axes[axes.cohort == c].sort_values("component")["explained_ratio"], val / P, rtol=1e-9)
        sc = np.array(s[s.cohort == c]["s"].tolist())
        np.testing.assert_allclose(sc.var(axis=0), val[:2], rtol=1e-8)


def logistic_reference(x, y, ridge_, w=None):
    d = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(x)) if w is None else w
    b = np.zeros(d.shape[1])
    pen = np.diag([0.0] + [ridge_] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-d @ b))
        h = (d * (w * p * (1 - p))[:, None]).T @ d + pen
        step = np.linalg.solve(h, d.T @ (w * (y - p)) - pen @ b)
        b = b + step
        if np.abs(step).max() < 1e-12:
            break
    return b, np.sqrt(np.diag(np.linalg.inv(h)))


def test_newton_logistic(spark, data):
    x, y, cohort, df = data
    t = (y[:, 0] + 3 * np.sin(np.arange(N)) > np.median(y[:, 0])).astype(float)
    rows = spark.createDataFrame([(str(c), [float(v) for v in x[i, :2]], float(t[i]), int(1 + i % 3)) for i, c in enumerate(cohort)], "cohort string, x array<double>, y double, w int").cache()
    for weight in (None, "w"):
        fit = {r["cohort"]: r for r in lo.newton_fit(rows, ["cohort"], 2, weight=weight).collect()}
        for c in ("a", "b"):
            use = cohort == c
            b, se = logistic_reference(x[use][:, :2], t[use], lo.RIDGE, None if weight is None else 1.0 + np.arange(N)[use] % 3)
            np.testing.assert_allclose(fit[c]["beta"], b, rtol=1e-6)
            np.testing.assert_allclose(fit[c]["se"], se, rtol=1e-6)
            assert fit[c]["converged"]


def test_far_start_still_converges(spark):
    rows = spark.createDataFrame([("a", [float(i % 7) - 9.0], float(i % 3 == 0)) for i in range(60)], "k string, x array<double>, y double")
    fit = lo.newton_fit(rows, ["k"], 1, ridge=0.0, start=[0.0, 1.0]).first()
    b, _ = logistic_reference(np.array([[i % 7 - 9.0] for i in range(60)]), np.array([float(i % 3 == 0) for i in range(60)]), 0.0)
    np.testing.assert_allclose(fit["beta"], b, atol=1e-7)


def test_skip_rules(spark):
    rows = [("one", 1.0)] * 20 + [("few", 1.0)] * 2 + [("few", 0.0)] * 20 + [("ok", 1.0)] * 10 + [("ok", 0.0)] * 10
    df = spark.createDataFrame(rows, "k string, y double")
    got = {r["k"]: (r["status"], r["skip_reason"]) for r in lo.eligibility(df, ["k"], F.lit(2)).collect()}
    assert got == {"one": ("SKIP", "less_than_two_classes"), "few": ("SKIP", "insufficient_events_per_parameter"), "ok": ("PASS", "")}


def test_balanced_out_of_fold_risk(spark, data):
    x, y, cohort, df = data
    t = (y[:, 0] > np.quantile(y[:, 0], 0.7)).astype(int)
    rows = spark.createDataFrame([(str(c), int(i), [float(v) for v in x[i]], int(t[i])) for i, c in enumerate(cohort)], "cohort string, entity int, x array<double>, y int")
    risk, metrics = lo.balanced_oof(rows, 3, 1, 5, 128)
    got = {r["entity"]: r["risk"] for r in risk.collect()}
    fold = {r["entity"]: r["fold"] for r in fo.stratified_kfold(rows, ["cohort"], "entity", "y", 3, 1, 5).collect()}
    f = np.array([fold[i] for i in range(N)])
    for c in ("a", "b"):
        for k in np.unique(f[cohort == c]):
            tr, te = (cohort == c) & (f != k), (cohort == c) & (f == k)
            mx, sx = standard(x[tr])
            w = np.where(t[tr] == 1, tr.sum() / (2 * t[tr].sum()), tr.sum() / (2 * (1 - t[tr]).sum()))
            b, _ = logistic_reference((x[tr] - mx) / sx, t[tr], 1.0, w)
            p = 1 / (1 + np.exp(-(((x[te] - mx) / sx) @ b[1:] + b[0])))
            np.testing.assert_allclose([got[i] for i in np.flatnonzero(te)], p, rtol=1e-5)
    assert metrics.count() == 2


def cox_score(x, time, event, b, penalty):
    sd = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / sd
    bz = b * sd
    e = np.exp(z @ bz)
    g = -len(x) * penalty * bz
    for t in np.unique(time[event == 1]):
        d, risk = (time == t) & (event == 1), time >= t
        for k in range(d.sum()):
            frac = k / d.sum()
            s0 = e[risk].sum() - frac * e[d].sum()
            s1 = (e[risk, None] * z[risk]).sum(axis=0) - frac * (e[d, None] * z[d]).sum(axis=0)
            g = g + z[d].mean(axis=0) - s1 / s0
    return g


def test_cox_gradient_vanishes_with_ties(spark, data):
    x, *_ = data
    rng = np.random.default_rng(5)
    time = np.ceil(rng.exponential(1.0 / np.exp(0.4 * (x[:, 0])), N) * 6)
    event = (rng.random(N) < 0.7).astype(int)
    df = spark.createDataFrame([("a", float(time[i]), int(event[i]), [float(v) for v in x[i, :2]]) for i in range(N)], "cohort string, time double, event int, x array<double>").repartition(4)
    fit = sv.cox_fit(df, ["cohort"], 2).toPandas().sort_values("term")
    assert fit["converged"].all()
    np.testing.assert_allclose(cox_score(x[:, :2], time, event, fit["coef"].to_numpy(), sv.PENALTY), 0.0, atol=1e-5)
    assert fit["coef"].iloc[0] > 0


def knn_reference(x, k):
    out = x.copy()
    n, p = x.shape
    m = ~np.isnan(x)
    for i in range(n):
        for j in np.flatnonzero(~m[i]):
            cand = []
            for d in range(n):
                both = m[i] & m[d]
                if d != i and m[d, j] and both.any():
                    cand.append((np.sqrt(((x[i, both] - x[d, both]) ** 2).sum() * p / both.sum()), d))
            cand = sorted(cand)[:min(k, n - 1)]
            if not cand:
                out[i, j] = np.nanmean(x[:, j])
            elif cand[0][0] == 0:
                out[i, j] = np.mean([x[d, j] for s, d in cand if s == 0])
            else:
                out[i, j] = sum(x[d, j] / s for s, d in cand) / sum(1 / s for s, d in cand)
    return out


@pytest.mark.parametrize("block_rows", [1000, 9])
def test_knn_impute_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 4)) * 10
    x[rng.random(x.shape) < 0.25] = np.nan
    x[5] = [1.0, 2.0, np.nan, 4.0]
    x[6] = [1.0, 2.0, 9.0, 4.0]
    x[7] = [np.nan, np.nan, 3.0, np.nan]
    x[8] = [np.nan, 1.0, np.nan, np.nan]
    rows = [("c", i, f"f{j}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(40) for j in range(4)]
    df = spark.createDataFrame(rows, "cohort string, entity int, feature string, value double")
    got = knn_impute(df, block_rows=block_rows, k=5).toPandas()
    want = knn_reference(x, 5)
    assert len(got) == 160
    for r in got.itertuples():
        assert r.value == pytest.approx(want[r.entity, int(r.feature[1:])], rel=1e-9), (r.entity, r.feature)


def test_median_fill_uses_fitting_rows_only(spark):
    df = spark.createDataFrame([("f", 1.0, True), ("f", 3.0, True), ("f", 100.0, False), ("f", None, False), ("g", None, True)], "feature string, value double, train boolean")
    got = sorted((r["feature"], r["value"]) for r in median_fill(df, ["feature"], "value", F.col("train")).collect())
    assert got == [("f", 1.0), ("f", 2.0), ("f", 3.0), ("f", 100.0), ("g", 0.0)]


def test_nmf_error_falls_and_finds_planted_factors(spark):
    rng = np.random.default_rng(2)
    h = np.array([[5, 4, 0, 0, 0, 0], [0, 0, 3, 6, 0, 0], [0, 0, 0, 0, 4, 4]], dtype=float)
    w = rng.random((60, 3)) * (rng.random((60, 3)) < 0.6) + 0.01
    x = w @ h
    df = spark.createDataFrame([("a" if i < 30 else "b", i, [float(v) for v in x[i]]) for i in range(60)], "cohort string, entity int, x array<double>").repartition(3)
    fits = [{"rank": 3, "start": s} for s in range(3)] + [{"rank": 3, "start": 0, "held": "a"}]
    res = fa.nmf(df, fits, 1, iterations=40, tol=1e-7)
    for hist in res["history"].values():
        assert all(b <= a * (1 + 1e-9) + 1e-9 for a, b in zip(hist, hist[1:]))
    best = res["factors"][fa.best_fit(res, fits, lambda f: "held" not in f)]
    sim = (best / np.linalg.norm(best, axis=1, keepdims=True)) @ (h / np.linalg.norm(h, axis=1, keepdims=True)).T
    assert (sim.max(axis=0) > 0.98).all()
    assert res["rows"][3] == 30
    sc = fa.score_table(fa.scores(df, {0: best}, ["entity"]), ["entity"]).toPandas()
    np.testing.assert_allclose(sc.groupby("entity")["fraction"].sum(), 1.0, rtol=1e-9)


def test_bootstrap_multiplicities_are_balanced(spark, data):
    *_, df = data
    m = fa.balanced_multiplicities(df, 3, 4)
    long = m.select("cohort", F.explode("multiplicity").alias("s", "c")).groupBy("cohort", "s").agg(F.sum("c").alias("n")).toPandas()
    assert (long["n"] == 30).all() and len(long) == 6


def test_folds_partition_entities(data):
    *_, df = data
    f = fo.kfold(df, ["cohort"], "entity", 4, 2, 1).toPandas()
    assert len(f) == 2 * N and f.groupby(["repeat", "entity"]).size().eq(1).all()
    size = f[f.cohort == "a"].groupby(["repeat", "fold"]).size()
    assert size.max() - size.min() <= 1


def test_random_set_weights_use_matched_sizes(spark):
    sets = spark.createDataFrame([("s", 1.0, 3, 1.0), ("s", -1.0, 2, -1.0)], "set_name string, direction double, n int, sign double")
    w = rs.random_set_weights([f"f{i}" for i in range(10)], sets, 5, 1)
    assert w.shape == (10, 5)
    np.testing.assert_allclose(w.sum(axis=0), 0.0, atol=1e-12)




def test_drawn_orders_are_the_permutation_map(spark):
    ids = spark.createDataFrame([(c, f"e{e}") for c, n in (("a", 40), ("b", 1)) for e in range(n)], "cohort string, entity string")
    fixed = rs._base_order(ids, 3)
    at = {(r.cohort, r.position): r.entity for r in fixed.collect()}
    got = {(r.cohort, r.perm, at[(r.cohort, i + 1)]): at[(r.cohort, p)] for r in rs._drawn_orders(fixed, 19, 3).collect() for i, p in enumerate(r.lends)}
    assert got == {(r.cohort, r.perm, r.entity): r.donor for r in rs.permutation_map(ids, 19, 3).collect()}


def test_label_shuffle_keeps_no_row_per_entity_and_order(spark, monkeypatch):
    df = spark.createDataFrame([("a", e, "f", float(e % 7), float(e % 5)) for e in range(50)], "cohort string, entity int, feature string, value double, pred double")
    wide = []
    monkeypatch.setattr(rs, "hash_positions", lambda rows, *args, real=rs.hash_positions: (wide.extend(rows.columns), real(rows, *args))[1])
    assert rs.shuffled_correlations(df, 6, 3).count() == 6 and "perm" not in wide
