"""Grouped centred moments: the single data pass behind every linear model.

A task keeps count, means and centred co-moments for the keys it meets; partial
ones are merged pairwise, first salted, then by key. No sum of raw squares is
ever formed, so columns far from zero lose no digits and constant ones have a
deviation of exactly zero. Training sets merge the moments of the other folds,
so the rows are never copied per fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.vectors import matrix

# Partial matrices a task may hold before it passes them on (in cells).
HELD_CELLS = 32_000_000
SALTS = 16


def sum_arrays(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Element-wise sum of equally long arrays per key, combined in two levels."""
    vec = df.select(*keys, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("__s"), array_to_vector(value).alias("__v"))
    first = vec.groupBy(*keys, "__s").agg(Summarizer.sum(F.col("__v")).alias("__v"))
    return first.groupBy(*keys).agg(vector_to_array(Summarizer.sum(F.col("__v"))).alias(value))


@dataclass
class Moments:
    """Count, means and centred co-moments of p inputs and q targets.

    ``cyy`` holds the targets' sums of squares, ``yy`` all their co-moments where
    they were asked for. ``a + b`` are the moments of both sets of rows.
    """

    n: float
    mx: np.ndarray
    my: np.ndarray
    cxx: np.ndarray
    cxy: np.ndarray
    cyy: np.ndarray
    yy: np.ndarray | None = None

    @classmethod
    def of_rows(cls, a: np.ndarray, b: np.ndarray, w: np.ndarray, full: bool) -> Moments:
        """Of rows with weights of a positive sum."""
        p, v = a.shape[1], np.hstack([a, b])
        n = float(w.sum())
        # Taken from the first row, so that a constant column has its very value as mean.
        mean = v[0] + (w[:, None] * (v - v[0])).sum(axis=0) / n
        d = v - mean
        dw = d * w[:, None]
        c = dw[:, :p].T @ d
        yy = dw[:, p:].T @ d[:, p:] if full else None
        return cls(n, mean[:p], mean[p:], c[:, :p], c[:, p:], (dw[:, p:] * d[:, p:]).sum(axis=0), yy)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        dx, dy, f, w = other.mx - self.mx, other.my - self.my, other.n / n, self.n * other.n / n
        yy = None if self.yy is None else self.yy + other.yy + w * np.outer(dy, dy)
        return Moments(n, self.mx + f * dx, self.my + f * dy, self.cxx + other.cxx + w * np.outer(dx, dx),
                       self.cxy + other.cxy + w * np.outer(dx, dy), self.cyy + other.cyy + w * dy * dy, yy)

    @property
    def p(self) -> int:
        return len(self.mx)

    @cached_property
    def sd(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cxx) / self.n)

    @cached_property
    def sdx(self) -> np.ndarray:
        """Deviations to divide inputs by: 1 for constant ones."""
        return np.where(self.sd > 1e-12 * (1.0 + np.abs(self.mx)), self.sd, 1.0)

    @cached_property
    def sdy(self) -> np.ndarray:
        sd = np.sqrt(self.cyy / self.n)
        return np.where(sd > 1e-12 * (1.0 + np.abs(self.my)), sd, 1.0)

    def packed(self) -> dict:
        rest = self.cyy if self.yy is None else self.yy.ravel()
        return {"p": self.p, "n": self.n, "m": np.concatenate([self.mx, self.my]), "c": np.concatenate([self.cxx.ravel(), self.cxy.ravel(), rest])}

    @classmethod
    def unpacked(cls, p: int, n: float, m: Sequence[float], c: Sequence[float]) -> Moments:
        m, c = np.asarray(m, dtype=float), np.asarray(c, dtype=float)
        q = len(m) - p
        cxx, cxy, rest = np.split(c, [p * p, p * (p + q)])
        # One target: its sum of squares is the whole matrix.
        yy = rest.reshape(q, q) if len(rest) == q * q else None
        return cls(float(n), m[:p], m[p:], cxx.reshape(p, p), cxy.reshape(p, q), rest if yy is None else np.diag(yy).copy(), yy)


def merged(parts: Sequence[Moments]) -> Moments:
    return reduce(lambda a, b: a + b, parts)


def others(cells: dict) -> dict:
    """For every key the moments of all other keys; a lone key has none and is left out."""
    keys = list(cells)
    if len(keys) < 2:
        return {}
    before, after = [cells[keys[0]]], [cells[keys[-1]]]
    for k in keys[1:-1]:
        before.append(before[-1] + cells[k])
    for k in keys[-2:0:-1]:
        after.append(after[-1] + cells[k])
    after.reverse()
    out = {keys[0]: after[0], keys[-1]: before[-1]}
    for i in range(1, len(keys) - 1):
        out[keys[i]] = before[i - 1] + after[i]
    return out


def _merge_stream(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """One row per key of partial moments that come sorted by key; one key is held at a time."""
    key, held = None, None
    for pdf in batches:
        for now, *rest in zip(pdf[by].itertuples(index=False, name=None), pdf["p"], pdf["n"], pdf["m"], pdf["c"]):
            m = Moments.unpacked(*rest)
            if held is not None and now == key:
                held = held + m
                continue
            if held is not None:
                yield pd.DataFrame([{**dict(zip(by, key)), **held.packed()}])
            key, held = now, m
    if held is not None:
        yield pd.DataFrame([{**dict(zip(by, key)), **held.packed()}])


def grouped_moments(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", weight: str | None = None, full: bool = False) -> DataFrame:
    """One row ``(keys, p, n, m, c)`` per key: see :class:`Moments`, read by :func:`unpack`.

    With ``full`` the co-moments among the targets are kept as well.
    """
    keys = list(keys)
    cols = [*keys, x, y] + ([weight] if weight else [])
    schema = df.select(*keys).schema

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Moments] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for key, m in held.items():
                yield pd.DataFrame([{**dict(zip(keys, key)), **m.packed()}])
            held.clear()

        for pdf in batches:
            if pdf.empty:
                continue
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                w = part[weight].to_numpy(dtype=float) if weight else np.ones(len(part))
                if not w.sum() > 0:
                    continue
                m = Moments.of_rows(matrix(part[x]), matrix(part[y]), w, full)
                held[key] = held[key] + m if key in held else m
            if sum(m.cxx.size + m.cxy.size + (0 if m.yy is None else m.yy.size) for m in held.values()) > HELD_CELLS:
                yield from flush()
        yield from flush()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    values = "p int, n double, m array<double>, c array<double>"
    parts = df.select(*cols).mapInPandas(partial, f"{fields}, {values}")
    salted = parts.withColumn("__s", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    by = [*keys, "__s"]
    first = salted.repartition(*by).sortWithinPartitions(*by).mapInPandas(lambda b: _merge_stream(b, by), f"{fields}, __s int, {values}").drop("__s")
    return first.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lambda b: _merge_stream(b, keys), f"{fields}, {values}")


def unpack(part: pd.DataFrame) -> Moments:
    """Moments of all rows of one table of :func:`grouped_moments`."""
    return merged([Moments.unpacked(*r) for r in zip(part["p"], part["n"], part["m"], part["c"])])


def principal_axes(m: Moments, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading axes of the standardised inputs and their variances."""
    c = m.cxx / np.outer(m.sdx, m.sdx) / m.n
    val, vec = np.linalg.eigh((c + c.T) / 2)
    order = np.argsort(val)[::-1][:components]
    axes = vec[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return axes, np.maximum(val[order], 0.0)


def projected(m: Moments, mean: np.ndarray, t: np.ndarray, y_mean: np.ndarray, y_scale: np.ndarray) -> Moments:
    """Moments of ``(x - mean) t`` and ``(y - y_mean) y_scale``."""
    return Moments(m.n, (m.mx - mean) @ t, (m.my - y_mean) * y_scale, t.T @ m.cxx @ t, (t.T @ m.cxy) * y_scale, m.cyy * y_scale**2)


def with_target_axes(m: Moments, mean: np.ndarray, sd: np.ndarray, axes: np.ndarray) -> Moments:
    """Moments with y replaced by its scores on the axes (needs ``yy``)."""
    t = axes / sd[:, None]
    return Moments(m.n, m.mx, (m.my - mean) @ t, m.cxx, m.cxy @ t, np.einsum("ij,ij->j", t, m.yy @ t))


def ridge(m: Moments, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Centred ridge coefficients (p x q) and intercepts."""
    b = np.linalg.solve(m.cxx + alpha * np.eye(m.p), m.cxy)
    return b, m.my - m.mx @ b


def centred_error(m: Moments, b: np.ndarray) -> np.ndarray:
    """Sum over rows of the squared residual about its mean, per target."""
    return np.maximum(m.cyy - 2 * np.einsum("ij,ij->j", b, m.cxy) + np.einsum("ij,ij->j", b, m.cxx @ b), 0.0)


def squared_error(m: Moments, b: np.ndarray, b0: np.ndarray) -> np.ndarray:
    """Sum over rows of (y - b0 - x b)^2 per target, from moments only."""
    return centred_error(m, b) + m.n * (m.my - b0 - m.mx @ b) ** 2
