"""Out-of-fold linear models solved from grouped moments."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.numeric import hash_key
from cohortwise.operators import moments as mo
from cohortwise.operators.folds import group_kfold, kfold
from cohortwise.operators.ordering import hash_positions, quantiles
from cohortwise.operators.vectors import matrix
from cohortwise.session import materialize

# Penalty grids, component limits and target variance share.
ALPHAS = [1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1000.0]
LOO_ALPHAS = list(np.logspace(-2, 3, 16))
TRANSFER_ALPHAS = list(np.logspace(-3, 3, 25))
NET_ALPHAS, NET_L1 = [0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0], [0.1, 0.5, 0.9]
BOOT_ALPHAS = [0.05, 0.1, 0.5, 1.0, 5.0]
MAX_COMPONENTS, TRANSFER_COMPONENTS = 256, 64
TARGET_VARIANCE, TARGET_COMPONENTS = 0.80, 30
PREFILTER, BOOT_PREFILTER = 120, 80
# Elastic net: largest duality gap of a converged fit, as a share of the target's variance; sweeps between two looks at it, and at most.
GAP, GAP_EVERY, MAX_SWEEPS = 1e-10, 5, 20_000
# Rows a prediction task works on at a time.
ROWS_PER_TASK = 50_000

MODEL_FIELDS = "intercept array<double>, coef array<double>, train_sd array<double>, alpha array<double>, components int, n_train double"


def width(df: DataFrame, column: str) -> int:
    row = df.select(F.size(column).alias("n")).first()
    return int(row["n"]) if row else 0


def _typed_empty(like: pd.DataFrame, keys: Sequence[str], **columns) -> pd.DataFrame:
    """No rows, with the types that the result needs."""
    return like[list(keys)].iloc[:0].reset_index(drop=True).assign(**{c: pd.Series([], dtype=t) for c, t in columns.items()})


def apply_models(df: DataFrame, models: DataFrame, keys: Sequence[str], keep: Sequence[str], x: str = "x", out: str = "pred") -> DataFrame:
    """``intercept + x coef`` with the model of each row's key.

    Rows meet their model in salted groups, so neither is a model copied to each
    row nor does a hot key end in one task.
    """
    # A key gets as many groups as its own rows need, so a model is copied once per ROWS_PER_TASK rows of its key.
    salts = materialize(df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_TASK).cast("int").alias("__n")), "salts")
    rows = df.select(*dict.fromkeys([*keys, *keep]), x).join(salts, list(keys)).withColumn("__s", F.pmod(F.xxhash64(*keep), F.col("__n")).cast("int")).drop("__n")
    spread = models.select(*keys, "intercept", "coef").join(salts, list(keys)).withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    cols = list(dict.fromkeys([*keys, *keep]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*cols).schema.fields)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left[cols].iloc[:0].assign(**{out: pd.Series([], dtype=object)})
        b0 = np.asarray(right["intercept"].iloc[0], dtype=float)
        b = np.asarray(right["coef"].iloc[0], dtype=float).reshape(-1, len(b0))
        res = left[cols].copy()
        res[out] = list(matrix(left[x]) @ b + b0)
        return res

    return rows.groupBy(*keys, "__s").cogroup(spread.groupBy(*keys, "__s")).applyInPandas(run, f"{fields}, {out} array<double>")


def _target_axes(train: mo.Moments, variance: float, limit: int) -> np.ndarray:
    """Leading axes of the standardised targets, from their co-moments."""
    c = train.yy / np.outer(train.sdy, train.sdy) / train.n
    val, vec = np.linalg.eigh((c + c.T) / 2)
    val, vec = np.maximum(val[::-1], 0.0), vec[:, ::-1]
    limit = max(1, min(limit, len(train.my), int(train.n) - 1))
    k = int(min(limit, np.searchsorted(np.cumsum(val / max(val.sum(), 1e-300)), variance) + 1))
    return vec[:, :k]


def fit_ridge(m: mo.Moments, inner: list[tuple[mo.Moments, mo.Moments]], alphas: Sequence[float], blocks: int,
              max_components: int = MAX_COMPONENTS, target_pca: bool = False, variance: float = TARGET_VARIANCE,
              limit: int = TARGET_COMPONENTS) -> dict:
    """Standardise, rotate, choose alpha by inner held-out error, refit.

    Everything is read off the moments. ``blocks`` splits the targets into equal
    groups with an alpha each (true and permuted targets share the inputs).
    """
    axes, _ = mo.principal_axes(m, max(1, min(max_components, m.p, int(m.n) - 1)))
    t = axes / m.sdx[:, None]
    y_axes = _target_axes(m, variance, limit) if target_pca else None

    def view(g: mo.Moments) -> mo.Moments:
        if y_axes is not None:
            return mo.projected(mo.with_target_axes(g, m.my, m.sdy, y_axes), m.mx, t, np.zeros(y_axes.shape[1]), np.ones(y_axes.shape[1]))
        return mo.projected(g, m.mx, t, m.my, 1.0 / m.sdy)

    whole = view(m)
    q = len(whole.my)
    size = q // blocks
    err = np.zeros((len(alphas), blocks))
    for tr, te in inner:
        a, b = view(tr), view(te)
        for i, alpha in enumerate(alphas):
            coef, icpt = mo.ridge(a, alpha)
            mse = mo.squared_error(b, coef, icpt) / b.n
            err[i] += mse.reshape(blocks, size).mean(axis=1)
    chosen = err.argmin(axis=0)
    coef = np.zeros((whole.p, q))
    icpt = np.zeros(q)
    for k in range(blocks):
        c, c0 = mo.ridge(whole, alphas[chosen[k]])
        s = slice(k * size, (k + 1) * size)
        coef[:, s], icpt[s] = c[:, s], c0[s]
    beta = t @ coef
    if y_axes is not None:
        beta, icpt = beta @ y_axes.T, y_axes @ icpt
    beta = beta * m.sdy
    b0 = m.my + icpt * m.sdy - m.mx @ beta
    sd = np.sqrt(mo.centred_error(m, beta) / max(m.n - 1, 1))
    return {"intercept": b0, "coef": beta.ravel(), "train_sd": sd, "alpha": [float(alphas[i]) for i in chosen],
            "components": int(t.shape[1]), "n_train": float(m.n)}


def inner_assignments(df: DataFrame, folds: int, repeats: int, seed: int) -> DataFrame:
    """Outer folds plus an independent inner split of 2-3 parts."""
    outer = kfold(df, ["cohort"], "entity", folds, repeats, seed)
    h = outer.withColumn("__g", hash_key(F.lit(seed + 1000), F.col("repeat"), F.col("entity")))
    pos = hash_positions(h, ["cohort", "repeat"], "__g", [F.col("entity")])
    n_train = F.floor(F.col("n_group") * F.lit((folds - 1) / folds))
    k = F.greatest(F.lit(2), F.least(F.lit(3), F.floor(n_train / 10)))
    return pos.select("cohort", "entity", "repeat", "fold", ((F.col("position") - 1) % k).cast("int").alias("inner"))


def crossfit_models(rows: DataFrame, alphas: Sequence[float] = ALPHAS, blocks: int = 1, max_components: int = MAX_COMPONENTS,
                    target_pca: bool = False, keys: Sequence[str] = ("cohort",), block_width: int | None = None) -> DataFrame:
    """One model per (keys, repeat, fold), trained on the other folds only.

    With ``block_width`` a block has so many targets, however many blocks a row has.
    """
    by = [*keys, "repeat"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    g = mo.grouped_moments(rows, [*by, "fold", "inner"], full=target_pca)

    def solve(key, part: pd.DataFrame) -> pd.DataFrame:
        cells = {k: mo.unpack(v) for k, v in part.groupby(["fold", "inner"])}
        out = []
        for fold in sorted({k[0] for k in cells}):
            mine = {k: v for k, v in cells.items() if k[0] != fold}
            if not mine:
                continue
            held = {i: mo.merged([v for k, v in mine.items() if k[1] == i]) for i in sorted({k[1] for k in mine})}
            inner = [(rest, held[i]) for i, rest in mo.others(held).items()]
            m = mo.merged(list(mine.values()))
            n = len(m.my) // block_width if block_width else blocks
            out.append({**dict(zip(by, key)), "fold": fold, **fit_ridge(m, inner, alphas, n, max_components, target_pca)})
        return pd.DataFrame(out)

    return g.groupBy(*by).applyInPandas(solve, ", ".join(f"`{c}` {kinds[c]}" for c in by) + f", fold int, {MODEL_FIELDS}")


def crossfit(df: DataFrame, folds: int = 5, repeats: int = 5, seed: int = 20260609, target_pca: bool = False,
             blocks: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Out-of-fold predictions per repeat, the fold models and the assignments.

    ``df`` holds ``(cohort, entity, x, y)`` with array columns.
    """
    base = materialize(df.select("cohort", "entity", "x", "y"), "base")
    assign = materialize(inner_assignments(base, folds, repeats, seed), "folds")
    rows = base.join(assign, ["cohort", "entity"])
    models = materialize(crossfit_models(rows, blocks=blocks, target_pca=target_pca), "models")
    pred = apply_models(rows, models, ["cohort", "repeat", "fold"], ["entity"])
    return pred, models, assign


def mean_prediction(pred: DataFrame, repeats: int) -> DataFrame:
    """Average over repeats as long rows; fails unless every entity has one per repeat."""
    long = pred.select("cohort", "entity", "repeat", F.posexplode("pred").alias("position", "p"))
    avg = long.groupBy("cohort", "entity", "position").agg(F.avg("p").alias("pred"), F.count(F.lit(1)).alias("n"))
    ok = F.assert_true(F.col("n") == repeats, F.lit("an entity was not predicted once per repeat"))
    return avg.where(ok.isNull()).drop("n")


def observed_long(df: DataFrame, y: str = "y") -> DataFrame:
    return df.select("cohort", "entity", F.posexplode(y).alias("position", "obs"))


def oof_residuals(df: DataFrame, pred: DataFrame, models: DataFrame) -> DataFrame:
    """(y - prediction) / training residual sd of the held-out model, averaged over repeats."""
    sd = models.select("cohort", "repeat", "fold", F.posexplode("train_sd").alias("position", "sd"))
    p = pred.select("cohort", "entity", "repeat", "fold", F.posexplode("pred").alias("position", "p"))
    j = p.join(sd, ["cohort", "repeat", "fold", "position"]).join(observed_long(df), ["cohort", "entity", "position"])
    safe = F.when(F.col("sd") > 1e-8, F.col("sd"))
    ok = F.assert_true(safe.isNotNull(), F.lit("a training residual deviation is not positive"))
    return (j.where(ok.isNull()).groupBy("cohort", "entity", "position")
            .agg(F.avg((F.col("obs") - F.col("p")) / safe).alias("residual"), F.avg("p").alias("pred"), F.avg("obs").alias("obs")))


def standardized_residuals(df: DataFrame, value: str = "value", pred: str = "pred") -> DataFrame:
    """Residuals of given predictions over the sd of the other folds' residuals.

    ``df`` holds long rows with ``repeat`` and ``fold``; the training sums are
    total minus fold.
    """
    r = df.withColumn("__r", F.col(value) - F.col(pred))
    keys = ["cohort", "repeat", "feature"]
    sums = r.groupBy(*keys, "fold").agg(F.count("__r").alias("n"), F.avg("__r").alias("m"), F.var_pop("__r").alias("v"))
    # Combine the other folds by their counts, means and variances (no large sums of squares).
    cells = sums.groupBy(*keys).agg(F.collect_list(F.struct("fold", "n", "m", "v")).alias("c"))
    one = cells.select(*keys, F.explode("c.fold").alias("fold"), "c")
    others = F.filter("c", lambda a: a["fold"] != F.col("fold"))
    n = F.aggregate(others, F.lit(0.0), lambda acc, a: acc + a["n"])
    mean = F.aggregate(others, F.lit(0.0), lambda acc, a: acc + a["n"] * a["m"]) / F.col("n")
    ss = F.aggregate(others, F.lit(0.0), lambda acc, a: acc + a["n"] * (a["v"] + (a["m"] - F.col("mean")) * (a["m"] - F.col("mean"))))
    one = one.withColumn("n", n).where("n > 1").withColumn("mean", mean)
    one = one.withColumn("sd", F.sqrt(ss / (F.col("n") - 1))).select(*keys, "fold", "sd")
    return (r.join(one, [*keys, "fold"]).where("sd > 1e-8").groupBy("cohort", "entity", "feature")
            .agg(F.avg(F.col("__r") / F.col("sd")).alias("residual")))


def loo_ridge_models(rows: DataFrame, p: int, q: int, alphas: Sequence[float], keys: Sequence[str], max_components: int | None = None) -> DataFrame:
    """Ridge per key with alpha by leave-one-out error.

    First pass: moments. Second pass: leverage-corrected errors of every alpha,
    summed by Spark. The rows given are the training rows of each key.
    """
    g = materialize(mo.grouped_moments(rows, keys), "moments")
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    limit = max_components or p

    def basis(m: mo.Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        axes, var = mo.principal_axes(m, max(1, min(limit, p, int(m.n) - 2)))
        t = axes / m.sdx[:, None]
        return t, var * m.n, t.T @ m.cxy

    salts = max(1, math.ceil(rows.count() / ROWS_PER_TASK))
    salted = rows.select(*keys, "x", "y", F.pmod(F.xxhash64("x"), F.lit(salts)).cast("int").alias("__s"))
    spread = g.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def errors(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = [*keys, "a", "sse"]
        if left.empty or right.empty:
            return _typed_empty(left if len(left) else right, keys, a="int32", sse="float64")
        m = mo.unpack(right)
        t, lam, zy = basis(m)
        z = (matrix(left["x"]) - m.mx) @ t
        y = matrix(left["y"]) - m.my
        out = []
        for i, alpha in enumerate(alphas):
            shrink = 1.0 / (lam + alpha)
            resid = y - z @ (shrink[:, None] * zy)
            h = 1.0 / m.n + (z * z) @ shrink
            loo = resid / np.maximum(1.0 - h, 1e-12)[:, None]
            out.append((*key[:-1], i, float((loo * loo).mean(axis=1).sum())))
        return pd.DataFrame(out, columns=cols)

    sse = (salted.groupBy(*keys, "__s").cogroup(spread.groupBy(*keys, "__s")).applyInPandas(errors, f"{key_fields}, a int, sse double")
           .groupBy(*keys, "a").agg(F.sum("sse").alias("sse")))
    best = sse.groupBy(*keys).agg(F.min(F.struct("sse", "a"))["a"].alias("a"))

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _typed_empty(left if len(left) else right, keys, intercept=object, coef=object, alpha="float64")
        m = mo.unpack(left)
        t, lam, zy = basis(m)
        alpha = float(alphas[int(right["a"].iloc[0])])
        beta = t @ (zy / (lam + alpha)[:, None])
        return pd.DataFrame([{**dict(zip(keys, key)), "intercept": m.my - m.mx @ beta, "coef": beta.ravel(), "alpha": alpha}])

    return (g.groupBy(*keys).cogroup(best.groupBy(*keys))
            .applyInPandas(solve, f"{key_fields}, intercept array<double>, coef array<double>, alpha double"))


def fold_medians(long: DataFrame, assign: DataFrame, folds: int) -> DataFrame:
    """Median per cohort, training fold set and feature (each row trains k - 1 models)."""
    f = long.join(assign.select("cohort", "entity", "fold"), ["cohort", "entity"])
    train = f.withColumn("held", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda v: v != F.col("fold"))))
    return quantiles(train, ["cohort", "held", "feature"], "value", {"median": 0.5})


def bag_ridge(df: DataFrame, alphas: Sequence[float], folds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Ridge on bag vectors, alpha by group-fold error over all held-out rows, then refit.

    With a single fold there is no held-out row: errors are missing, the first alpha is taken.
    ``df`` holds ``(entity, x, y)``; returns the final model row and alpha scores.
    """
    rows = group_kfold(df, ["entity"], folds, seed).withColumn("k", F.lit(0))
    g = mo.grouped_moments(rows, ["k", "fold"])

    def solve(key, part: pd.DataFrame) -> pd.DataFrame:
        cells = {k: mo.unpack(v) for k, v in part.groupby("fold")}
        err = np.zeros(len(alphas))

        def fit(m: mo.Moments, a: float) -> np.ndarray:
            return np.linalg.solve(m.cxx / np.outer(m.sdx, m.sdx) + a * np.eye(m.p), m.cxy / m.sdx[:, None]) / m.sdx[:, None]

        for fold, m in mo.others(cells).items():
            for i, a in enumerate(alphas):
                b = fit(m, a)
                err[i] += mo.squared_error(cells[fold], b, m.my - m.mx @ b).sum()
        m = mo.merged(list(cells.values()))
        best = float(alphas[int(err.argmin())])
        b = fit(m, best)
        rows_out = [{"k": 0, "alpha": float(a), "mse": float(e / m.n) if len(cells) > 1 else np.nan, "chosen": bool(a == best), "intercept": m.my - m.mx @ b, "coef": b.ravel(), "centre": m.mx}
                    for a, e in zip(alphas, err)]
        return pd.DataFrame(rows_out)

    out = materialize(g.groupBy("k").applyInPandas(solve, "k int, alpha double, mse double, chosen boolean, intercept array<double>, coef array<double>, centre array<double>"), "ridge")
    return out.where("chosen").select("k", "intercept", "coef", "centre"), out.select("alpha", "mse", "chosen")


def elastic_net(m: mo.Moments, alpha: float, l1: float, use: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (p x q) on standardised inputs and the duality gap of each target, as a share of its variance.

    Coordinate descent for all targets at once; ``use`` (p x q) marks the inputs
    a target may have. It ends when the gap, which bounds the distance to the
    least loss whatever path was taken, is at most ``GAP``, or after ``MAX_SWEEPS``;
    the gap tells which. A target without variance has coefficients and gap 0.
    """
    c = m.cxx / np.outer(m.sdx, m.sdx) / m.n
    r = np.where(use, m.cxy / m.sdx[:, None] / m.n, 0.0)
    var = m.cyy / m.n
    flat = np.sqrt(var) <= 1e-12 * (1.0 + np.abs(m.my))
    lam, l2 = alpha * l1, alpha * (1.0 - l1)
    b = np.zeros_like(r) if start is None else start.copy()
    b[:, flat] = 0.0
    free = [(j, use[j] & ~flat) for j in range(len(b)) if m.sdx[j] == m.sd[j] and (use[j] & ~flat).any()]
    safe = np.where(var > 0, var, 1.0)
    gap = np.zeros(len(var))
    for sweep in range(MAX_SWEEPS + 1):
        grad = m.cxy / m.sdx[:, None] / m.n - c @ b
        if sweep % GAP_EVERY == 0 or sweep == MAX_SWEEPS:
            # The residual, shrunk until it is feasible, is a point of the dual problem.
            slope = np.abs(np.where(use, grad - l2 * b, 0.0)).max(axis=0, initial=0.0)
            shrink = np.where(slope > lam, lam / np.where(slope > 0, slope, 1.0), 1.0)
            fit = (m.cxy / m.sdx[:, None] / m.n * b).sum(axis=0)
            rest = np.maximum(var - 2 * fit + (b * (c @ b)).sum(axis=0), 0.0)
            gap = 0.5 * (1 + shrink**2) * rest + lam * np.abs(b).sum(axis=0) - shrink * (var - fit) + 0.5 * l2 * (1 + shrink**2) * (b * b).sum(axis=0)
            gap = np.where(flat, 0.0, np.maximum(gap, 0.0) / safe)
            if gap.max(initial=0.0) <= GAP:
                break
        if sweep == MAX_SWEEPS:
            break
        for j, mine in free:
            rho = grad[j] + c[j, j] * b[j]
            new = np.where(mine, np.sign(rho) * np.maximum(np.abs(rho) - lam, 0.0) / (c[j, j] + l2), 0.0)
            move = new - b[j]
            if move.any():
                grad -= np.outer(c[:, j], move)
                b[j] = new
    return b, gap


def _net_path(m: mo.Moments, alphas: Sequence[float], l1: float, use: np.ndarray) -> dict[float, np.ndarray]:
    """Coefficients of every penalty, each started from the next larger one."""
    out, b = {}, None
    for a in sorted(alphas, reverse=True):
        b, _ = elastic_net(m, a, l1, use, b)
        out[a] = b
    return out


def select_net(m: mo.Moments, inner: list[tuple[mo.Moments, mo.Moments]], alphas: Sequence[float], l1s: Sequence[float], prefilter: int) -> dict:
    """Correlation prefilter, inner-fold choice of penalty and mix, refit; for each target by itself."""
    q = len(m.my)
    corr = np.where((m.sd > 0)[:, None], np.abs(m.cxy) / (m.sdx[:, None] * m.n * m.sdy), 0.0)
    use = np.zeros(corr.shape, dtype=bool)
    np.put_along_axis(use, np.argsort(-corr, axis=0, kind="stable")[:prefilter], True, axis=0)
    grid = [(l1, a) for l1 in l1s for a in alphas]
    err = np.zeros((len(grid), q))
    for t, h in inner:
        for k, l1 in enumerate(l1s):
            path = _net_path(t, alphas, l1, use)
            for i, a in enumerate(alphas):
                b = path[a] / t.sdx[:, None]
                err[k * len(alphas) + i] += mo.squared_error(h, b, t.my - t.mx @ b) / h.n
    best = np.zeros(q, dtype=int)
    for i in range(1, len(grid)):
        best = np.where(err[i] < err[best, np.arange(q)] - 1e-15, i, best)
    b, gap = np.zeros(corr.shape), np.zeros(q)
    for i in np.unique(best):
        coef, g = elastic_net(m, grid[i][1], grid[i][0], use & (best == i))
        b[:, best == i], gap[best == i] = coef[:, best == i], g[best == i]
    b = b / m.sdx[:, None]
    return {"intercept": m.my - m.mx @ b, "coef": b.ravel(), "alpha": [float(grid[i][1]) for i in best], "l1_ratio": [float(grid[i][0]) for i in best], "gap": gap,
            "prefiltered": int(use[:, 0].sum()), "selected": (np.abs(b) > 1e-10).sum(axis=0).astype(int), "n_train": float(m.n)}


NET_FIELDS = "intercept array<double>, coef array<double>, alpha array<double>, l1_ratio array<double>, gap array<double>, prefiltered int, selected array<int>, n_train double"


def net_models(rows: DataFrame, group: Sequence[str], alphas: Sequence[float] = NET_ALPHAS, l1s: Sequence[float] = NET_L1, prefilter: int = PREFILTER) -> DataFrame:
    """Elastic nets of all targets per (group, fold) on the other folds; inner folds are those folds."""
    g = mo.grouped_moments(rows, [*group, "fold"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group).schema.fields)

    def solve(key, part: pd.DataFrame) -> pd.DataFrame:
        cells = {k: mo.unpack(v) for k, v in part.groupby("fold")}
        out = []
        for fold, train in mo.others(cells).items():
            mine = {k: v for k, v in cells.items() if k != fold}
            inner = [(rest, mine[k]) for k, rest in mo.others(mine).items()]
            out.append({**dict(zip(group, key)), "fold": fold, **select_net(train, inner, alphas, l1s, prefilter)})
        return pd.DataFrame(out, columns=[*group, "fold", *[f.split()[0] for f in NET_FIELDS.split(", ")]])

    return g.groupBy(*group).applyInPandas(solve, f"{fields}, fold int, {NET_FIELDS}")


def net_status(models: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, fold, position, alpha, l1_ratio, selected, gap, status): WARN where the gap is above ``GAP``."""
    each = models.select(*group, "fold", F.posexplode(F.arrays_zip("alpha", "l1_ratio", "selected", "gap")).alias("position", "t"))
    return each.select(*group, "fold", "position", "t.*", F.when(F.col("t.gap") <= GAP, "PASS").otherwise("WARN").alias("status"))


def bootstrap_weights(df: DataFrame, group: Sequence[str], entity: str, draws: int, seed: int) -> DataFrame:
    """Multiplicity of every entity in each with-replacement resample of its group.

    Draw ``i`` of a group picks the entity at a hashed position, so a resample is
    a weight per row and rows are not copied.
    """
    from cohortwise.functions.numeric import hash_number

    h = df.select(*group, entity).distinct().withColumn("__h", hash_key(F.lit(seed), F.col(entity)))
    pos = materialize(hash_positions(h, group, "__h", [F.col(entity)]).select(*group, entity, "position", "n_group"), "positions")
    d = pos.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = F.pmod(hash_number(hash_key(F.lit(seed), F.col("draw"), F.col("position"), *[F.col(g) for g in group])), F.col("n_group")) + 1
    w = d.select(*group, "draw", pick.alias("position")).groupBy(*group, "draw", "position").agg(F.count(F.lit(1)).alias("w"))
    return w.join(pos.select(*group, entity, "position"), [*group, "position"]).select(*group, "draw", entity, "w")


def net_bootstrap(df: DataFrame, weights: DataFrame, inner: int = 3, alphas: Sequence[float] = BOOT_ALPHAS, l1s: Sequence[float] = NET_L1,
                  prefilter: int = BOOT_PREFILTER, seed: int = 7) -> DataFrame:
    """Elastic-net coefficients of every resample as long ``(cohort, draw, target, position, coef)``."""
    fold = F.pmod(F.xxhash64(F.lit(seed), "entity"), F.lit(inner)).cast("int")
    rows = df.join(weights, ["cohort", "entity"]).withColumn("fold", fold)
    g = mo.grouped_moments(rows, ["cohort", "draw", "fold"], weight="w")

    def solve(key, part: pd.DataFrame) -> pd.DataFrame:
        cells = {k: mo.unpack(v) for k, v in part.groupby("fold")}
        inner_sets = [(rest, cells[k]) for k, rest in mo.others(cells).items()]
        fit = select_net(mo.merged(list(cells.values())), inner_sets, alphas, l1s, prefilter)
        coef = fit["coef"].reshape(-1, len(fit["intercept"]))
        idx, target = np.nonzero(np.abs(coef) > 1e-10)
        return pd.DataFrame({"cohort": key[0], "draw": key[1], "target": target, "position": idx, "coef": coef[idx, target]})

    return g.groupBy("cohort", "draw").applyInPandas(solve, "cohort string, draw int, target int, position int, coef double")


def selection_frequency(coefs: DataFrame, draws: int) -> DataFrame:
    return (coefs.groupBy("cohort", "target", "position").agg(F.count_distinct("draw").alias("selected_draws"), F.avg("coef").alias("mean_coef"), F.avg(F.abs("coef")).alias("mean_abs_coef"))
            .withColumn("selection_frequency", F.col("selected_draws") / F.lit(float(draws))))


def pca(df: DataFrame, group: Sequence[str], components: int) -> DataFrame:
    """Standardised principal axes per group: ``(component, ratio, mean, loadings)``."""
    g = mo.grouped_moments(df.withColumn("y", F.array(F.lit(0.0))), group)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*group).schema.fields)

    def solve(key, part: pd.DataFrame) -> pd.DataFrame:
        m = mo.unpack(part)
        axes, var = mo.principal_axes(m, max(1, min(components, m.p, int(m.n) - 1)))
        total = max(float((m.sd > 0).sum()), 1.0)
        return pd.DataFrame([{**dict(zip(group, key)), "component": i, "explained_ratio": float(var[i] / total), "centre": m.mx, "axis": axes[:, i] / m.sdx}
                             for i in range(axes.shape[1])])

    return g.groupBy(*group).applyInPandas(solve, f"{fields}, component int, explained_ratio double, centre array<double>, axis array<double>")


def pca_models(axes: DataFrame, group: Sequence[str]) -> DataFrame:
    """Principal axes in the ``intercept, coef`` form of :func:`apply_models`."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in axes.select(*group).schema.fields)

    def pack(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("component")
        t = matrix(part["axis"]).T
        return pd.DataFrame([{**dict(zip(group, key)), "intercept": -np.asarray(part["centre"].iloc[0]) @ t, "coef": t.ravel()}])

    return axes.groupBy(*group).applyInPandas(pack, f"{fields}, intercept array<double>, coef array<double>")
