"""Damped Newton steps for many likelihood fits at once (one row per model).

The state of the models is a table: every step joins the open models' trial
points to the data, adds up their likelihoods, solves the small systems in tasks
and writes the next state. A model that has converged leaves the table, so
later steps neither read its rows nor solve for it. The driver learns one
number a step: how many models are open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cohortwise.session import materialize

STATE = {"beta": "array<double>", "base": "array<double>", "delta": "array<double>", "se": "array<double>", "base_ll": "double", "scale": "double", "move": "double"}


def iterate(start: DataFrame, keys: Sequence[str], sums: Callable[[DataFrame], DataFrame], penalty, max_iter: int, tol: float, loose: float | None = None) -> DataFrame:
    """(keys, beta, se, move, converged) of the models that ``start`` (keys, beta, and what ``penalty`` reads) begins.

    ``sums(points)`` gives (keys, ll, g, h) at the trial points (keys, beta):
    log likelihood, gradient and the upper triangle of the information.
    ``penalty(row, size)`` is the diagonal of the quadratic penalty. Converged
    is a last move below ``loose`` (``tol`` if not given). Models without rows
    or with a null key do not come out.
    """
    keys = list(keys)
    extra = [c for c in start.columns if c not in (*keys, "beta")]
    fixed = {f.name: f.dataType.simpleString() for f in start.select(*keys, *extra).schema.fields}
    schema = ", ".join(f"`{c}` {t}" for c, t in {**fixed, **STATE}.items())

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield advance(b, [*keys, *extra], penalty)

    blank = [F.lit(None).cast(t).alias(c) for c, t in STATE.items() if c not in ("beta", "scale")]
    state, ended = start.select(*keys, *extra, "beta", *blank, F.lit(1.0).alias("scale")), []
    for _ in range(max_iter):
        seen = Observation()
        joined = state.join(sums(state.select(*keys, "beta")), keys)
        new = joined.mapInPandas(step, schema).observe(seen, F.count_if(F.col("move") >= tol).alias("open"))
        new = materialize(new, "newton")
        ended.append(new.where(F.col("move") < tol))
        state = new.where(F.col("move") >= tol)
        if not seen.get["open"]:
            break
    done = materialize(reduce(DataFrame.unionByName, [*ended, state.select(*new.columns)]), "newton_fit")
    return done.select(*keys, "beta", "se", "move", (F.col("move") < max(tol, loose or tol)).alias("converged"))


def symmetric(upper, m: int) -> np.ndarray:
    full = np.zeros((m, m))
    full[np.triu_indices(m)] = np.asarray(upper, dtype=float)
    return full + np.triu(full, 1).T


def advance(pdf: pd.DataFrame, keys: list[str], penalty) -> pd.DataFrame:
    """Next trial point of every model.

    ``pdf`` holds the trial ``beta`` with its log likelihood ``ll``, gradient ``g``
    and information ``h``, and the last accepted state. A worse trial halves the
    step. ``penalty(row, m)`` is the diagonal of the quadratic penalty.
    """
    out = {c: [] for c in ("beta", "base", "base_ll", "delta", "scale", "se", "move")}
    for row in pdf.itertuples(index=False):
        b = np.asarray(row.beta, dtype=float)
        pen = penalty(row, len(b))
        ll = float(row.ll) - 0.5 * float((pen * b * b).sum())
        if row.base_ll is None or np.isnan(row.base_ll) or ll >= row.base_ll - 1e-10 * (1.0 + abs(row.base_ll)):
            inv = np.linalg.pinv(symmetric(row.h, len(b)) + np.diag(pen), hermitian=True)
            delta, base, base_ll, scale = inv @ (np.asarray(row.g, dtype=float) - pen * b), b, ll, 1.0
            se = np.sqrt(np.maximum(np.diag(inv), 0.0))
        else:
            delta, base, base_ll = np.asarray(row.delta, dtype=float), np.asarray(row.base, dtype=float), float(row.base_ll)
            scale, se = float(row.scale) / 2.0, np.asarray(row.se, dtype=float)
        out["beta"].append(base + scale * delta)
        out["base"].append(base)
        out["base_ll"].append(base_ll)
        out["delta"].append(delta)
        out["scale"].append(scale)
        out["se"].append(se)
        out["move"].append(float(np.abs(scale * delta).max(initial=0.0)))
    return pd.DataFrame({**{k: pdf[k] for k in keys}, **out}, index=pdf.index)
