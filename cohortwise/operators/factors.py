"""Non-negative factorisation, its consensus and rank choice.

Rows stay distributed. A pass solves every row's loadings given the factors
(non-negative least squares) and returns only W'W, W'X and the error, so the
state of a fit is the small factor matrix. All starts and ranks share a pass.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.operators import consensus as cs
from cohortwise.operators.moments import sum_arrays
from cohortwise.operators.vectors import matrix

# Weights of the rank selection score.
W_STABILITY, W_SILHOUETTE, W_MARGIN, W_ERROR, W_RANK = 0.35, 0.25, 0.25, 0.15, 0.05
MAX_STATE_CELLS = 50_000_000


def split_signs(df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Each long row becomes its positive and its negative part."""
    parts = F.explode(F.array(
        F.struct(F.concat(F.lit("pos__"), F.col(feature)).alias("f"), F.greatest(F.col(value), F.lit(0.0)).alias("v")),
        F.struct(F.concat(F.lit("neg__"), F.col(feature)).alias("f"), F.greatest(-F.col(value), F.lit(0.0)).alias("v"))))
    keys = [c for c in df.columns if c not in (feature, value)]
    return df.select(*keys, parts.alias("p")).select(*keys, F.col("p.f").alias(feature), F.col("p.v").alias(value))


def split_vector(df: DataFrame, vec: str = "x") -> DataFrame:
    """Vector form of :func:`split_signs`: positive parts, then negative parts."""
    pos = F.transform(vec, lambda v: F.greatest(v, F.lit(0.0)))
    neg = F.transform(vec, lambda v: F.greatest(-v, F.lit(0.0)))
    return df.withColumn(vec, F.concat(pos, neg))


def loadings_given(x: np.ndarray, h: np.ndarray, sweeps: int = 200, tol: float = 1e-8) -> np.ndarray:
    """Row-wise non-negative least squares by coordinate sweeps."""
    k = len(h)
    hh, xh = h @ h.T, x @ h.T
    w = np.maximum(xh / np.maximum(np.diag(hh), 1e-12) / k, 0.0)
    for _ in range(sweeps):
        move = 0.0
        for j in range(k):
            if hh[j, j] <= 1e-12:
                continue
            new = np.maximum(w[:, j] + (xh[:, j] - w @ hh[:, j]) / hh[j, j], 0.0)
            move = max(move, float(np.abs(new - w[:, j]).max(initial=0.0)))
            w[:, j] = new
        if move < tol:
            break
    return w


def initial_factors(rank: int, width: int, scale: float, seed: int, start: int) -> np.ndarray:
    """Hash-seeded uniform start."""
    digest = hashlib.md5(f"{seed}|{rank}|{start}".encode()).digest()
    return np.random.default_rng(int.from_bytes(digest[:8], "big")).random((rank, width)) * scale


def _factor_step(h: np.ndarray, ww: np.ndarray, wx: np.ndarray, sweeps: int = 10) -> np.ndarray:
    h = h.copy()
    for _ in range(sweeps):
        for j in range(len(h)):
            if ww[j, j] > 1e-12:
                h[j] = np.maximum(h[j] + (wx[j] - ww[j] @ h) / ww[j, j], 0.0)
    return h


def nmf(df: DataFrame, fits: Sequence[dict], seed: int, iterations: int = 60, tol: float = 1e-5, x: str = "x", weights: str | None = None) -> dict:
    """Fit several factorisations ``X ~ W H`` together.

    ``fits`` lists ``{"rank", "start"}`` and optionally ``"held"`` (value of the
    ``cohort`` column left out) . With ``weights`` a map column ``start -> count``
    gives resample multiplicities. Returns factors, error history and row counts.
    """
    info = df.select(F.size(x).alias("p"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("s")).agg(F.max("p"), F.avg("s")).first()
    width, mean = int(info[0]), float(info[1]) / int(info[0])
    if sum(f["rank"] for f in fits) * width > MAX_STATE_CELLS:
        raise ValueError("too many factors to hold; fit fewer starts at a time")
    state = {i: initial_factors(f["rank"], width, 2.0 * math.sqrt(max(mean, 1e-12) / f["rank"]), seed, f["start"]) for i, f in enumerate(fits)}
    history: dict[int, list[float]] = {i: [] for i in state}
    sizes: dict[int, float] = {}
    active = set(state)
    cols = [x, "cohort"] + ([weights] if weights else [])
    for it in range(iterations + 1):
        now = {i: state[i] for i in active}

        def partial(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            held: dict[int, np.ndarray] = {}
            for pdf in batches:
                if pdf.empty:
                    continue
                full, cohort = matrix(pdf[x]), pdf["cohort"].to_numpy()
                for i, h in now.items():
                    use = np.ones(len(full), dtype=bool) if fits[i].get("held") is None else cohort != fits[i]["held"]
                    m = np.ones(len(full)) if weights is None else np.array([float(dict(v).get(fits[i]["start"], 0)) for v in pdf[weights]])
                    use &= m > 0
                    if not use.any():
                        continue
                    a, mm = full[use], m[use][:, None]
                    w = loadings_given(a, h)
                    k = len(h)
                    s = np.zeros((k + 1, k + width))
                    s[:k, :k], s[:k, k:] = (w * mm).T @ w, (w * mm).T @ a
                    s[k, 0], s[k, 1] = float((mm * (a - w @ h) ** 2).sum()), float(mm.sum())
                    held[i] = held[i] + s if i in held else s
            for i, s in held.items():
                yield pd.DataFrame({"fit": i, "i": range(len(s)), "v": list(s)})

        parts = df.select(*cols).mapInPandas(partial, "fit int, i int, v array<double>")
        sums: dict[int, dict[int, np.ndarray]] = {}
        for r in sum_arrays(parts, ["fit", "i"], "v").collect():
            sums.setdefault(r["fit"], {})[r["i"]] = np.array(r["v"])
        for i in list(active):
            s = sums[i]
            k = fits[i]["rank"]
            history[i].append(float(s[k][0]))
            sizes[i] = float(s[k][1])
            if it == iterations or (it > 0 and history[i][-2] - history[i][-1] <= tol * history[i][0]):
                active.discard(i)
                continue
            ww = np.array([s[j][:k] for j in range(k)])
            wx = np.array([s[j][k:] for j in range(k)])
            state[i] = _factor_step(state[i], ww, wx)
        if not active:
            break
    return {"factors": state, "history": history, "rows": sizes, "width": width}


def best_fit(result: dict, fits: Sequence[dict], where=lambda f: True) -> int:
    return min((i for i, f in enumerate(fits) if where(f)), key=lambda i: (result["history"][i][-1], i))


def scores(df: DataFrame, factors: dict[int, np.ndarray], keys: Sequence[str], x: str = "x") -> DataFrame:
    """Loadings of every row for each of the given factor matrices (size-checked state)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            a = matrix(pdf[x])
            for i, h in factors.items():
                out = pdf[list(keys)].copy()
                w = loadings_given(a, h)
                out["fit"], out["w"], out["label"] = i, list(w), w.argmax(axis=1)
                yield out

    return df.select(*keys, x).mapInPandas(run, f"{fields}, fit int, w array<double>, label int")


def score_table(w: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score and share of each factor, and the dominant factor of each row."""
    total = F.aggregate("w", F.lit(0.0), lambda a, v: a + v)
    safe = F.when(total > 0, total).otherwise(F.lit(1.0))
    top = F.array_max("w")
    return w.select(*keys, F.posexplode("w").alias("k", "score"), safe.alias("t"), top.alias("top"), F.array_position("w", top).alias("d")).select(
        *keys, F.concat(F.lit("A"), (F.col("k") + 1).cast("string")).alias("factor"), "score", (F.col("score") / F.col("t")).alias("fraction"),
        F.concat(F.lit("A"), F.col("d").cast("string")).alias("dominant"), (F.col("top") / F.col("t")).alias("dominant_fraction"))


def loading_table(df: DataFrame, h: np.ndarray, names: Sequence[str]) -> DataFrame:
    """Factor loadings by rank with the split feature name parts."""
    rows = []
    for k, row in enumerate(h):
        total = float(row.sum()) if row.sum() > 0 else 1.0
        for rank, j in enumerate(sorted(range(len(row)), key=lambda j: (-row[j], j)), start=1):
            rows.append((f"A{k + 1}", rank, names[j], float(row[j]), float(row[j] / total)))
    return df.sparkSession.createDataFrame(rows, "factor string, loading_rank int, split_feature string, loading double, loading_fraction double")


def balanced_multiplicities(df: DataFrame, starts: int, seed: int) -> DataFrame:
    """Equal-size resamples per cohort as a ``start -> count`` map per entity."""
    from cohortwise.functions.numeric import hash_key, hash_number
    from cohortwise.operators.ordering import hash_positions
    from cohortwise.session import materialize

    ids = df.select("cohort", "entity").distinct()
    h = ids.withColumn("__h", hash_key(F.lit(seed), F.col("entity")))
    pos = materialize(hash_positions(h, ["cohort"], "__h", [F.col("entity")]).select("cohort", "entity", "position", "n_group"), "positions")
    n_min = pos.agg(F.min("n_group")).first()[0]
    draws = pos.where(F.col("position") <= n_min).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    pick = F.pmod(hash_number(hash_key(F.lit(seed), F.col("start"), F.col("cohort"), F.col("position"))), F.col("n_group")) + 1
    counts = draws.select("cohort", "start", pick.alias("position")).groupBy("cohort", "position", "start").agg(F.count(F.lit(1)).alias("c"))
    maps = counts.groupBy("cohort", "position").agg(F.map_from_entries(F.collect_list(F.struct("start", "c"))).alias("m"))
    return (pos.join(maps, ["cohort", "position"], "left")
            .select("cohort", "entity", F.coalesce("m", F.create_map().cast("map<int,bigint>")).alias("multiplicity")))


def rank_stability(labels: DataFrame, final: DataFrame) -> DataFrame:
    """Consensus statistics of one rank: dispersion, silhouette, within/between."""
    a = cs.cluster_agreement(labels, final)
    sil = cs.silhouette(a).agg(F.avg("silhouette").alias("s")).scalar()
    wb = cs.within_between(a).select(F.struct("within_mean", "between_mean", "margin").alias("w")).scalar()
    return cs.dispersion(labels).withColumn("silhouette", sil).withColumn("w", wb).select("*", "w.within_mean", "w.between_mean", "w.margin").drop("w")


def choose_rank(stability: DataFrame) -> DataFrame:
    """Selection score per rank and the chosen one (first on ties).

    Needs ``rank, mean_error, stability, silhouette, margin``; missing parts count 0.
    """
    lim = stability.agg(F.struct(F.max("mean_error").alias("eh"), F.min("mean_error").alias("el"), F.max("rank").alias("rh"), F.min("rank").alias("rl")).alias("l")).scalar()
    err = (F.col("l.eh") - F.col("mean_error")) / (F.col("l.eh") - F.col("l.el") + 1e-12)
    pen = (F.col("rank") - F.col("l.rl")) / (F.col("l.rh") - F.col("l.rl") + 1e-12)
    zero = F.lit(0.0)
    score = (W_STABILITY * F.coalesce("stability", zero) + W_SILHOUETTE * F.coalesce("silhouette", zero) + W_MARGIN * F.coalesce("margin", zero) + W_ERROR * err - W_RANK * pen)
    out = stability.withColumn("l", lim).withColumn("selection_score", score).drop("l")
    best = out.agg(F.min(F.struct((-F.col("selection_score")).alias("s"), F.col("rank").alias("r")))["r"].alias("best")).scalar()
    return out.withColumn("chosen", F.col("rank") == best).select(*stability.columns, "selection_score", "chosen")
