"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The matrix X holds every distinct vector once, in whole numbers, centred and
divided by the root of the number of vectors, so that its squared singular
values are the eigenvalues of the covariance. It is written once as blocks of
rows. A step alternates p = X v and q = X' u in one pass over the blocks:

* every left vector is u_j = X g_j for a short g_j that the driver keeps, so
  no vector as long as the table is stored or moved;
* the pass gives p'p, the products of p with all earlier left vectors and X'p.
  Reorthogonalising p takes combinations of earlier left vectors off it, and X'
  of these is known from their own steps;
* the right vectors are reorthogonalised in full on the driver.

The bidiagonal matrix is small. Its singular vectors give components, its
singular values deviations. The steps end when the wanted ones have a residual
of rounding size and the variance outside of the space found is too small to
hide another one, else when the space is complete. A step that finds nothing
new goes on with a fresh direction, so equal eigenvalues are found as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.session import materialize

SCALE = 256
COMPONENTS = 4
BLOCK_ROWS = 4096
# Residual of a component, as a share of the largest deviation, and the share below which a direction is rounding.
RESIDUAL, NOTHING = 1e-13, 1e-12
LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """What the fit list says: ``n`` vectors, exact ``sums``, unit ``components`` in columns by falling ``values`` (eigenvalues), the covariance's ``trace``."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows whose vector is neither null nor holds a null or non-finite entry, and the width; shorter vectors are filled with zeros."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    ok = F.col(vector).isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.where(ok).select(F.col(vec_id).alias("vec_id"), F.transform(c, lambda v: F.floor(v * float(scale))).alias("x"))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return rows.select("vec_id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("x")), width


def fit_blocks(rows: DataFrame, width: int) -> DataFrame:
    """(x): blocks of distinct vectors as bytes of 64-bit integers."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BLOCK_ROWS):
                yield pd.DataFrame({"x": [np.stack(b["x"].iloc[at:at + BLOCK_ROWS].to_list()).astype("<i8").tobytes()]})

    return materialize(rows.select("x").distinct().mapInPandas(run, "x binary"), "whitening_blocks")


def _summed(blocks: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``of`` (a vector) over all blocks; a task sends one row per entry."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for x in b["x"]:
                part = of(np.frombuffer(x, dtype="<i8").reshape(-1, width))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"pos": np.arange(len(total), dtype=np.int32), "v": total})

    got = blocks.mapInPandas(run, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    return np.array([r.v for r in sorted(got)])


def _exact_sums(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(width, dtype=object)
        for b in batches:
            for x in b["x"]:
                a = np.frombuffer(x, dtype="<i8").reshape(-1, width)
                # Halves of 32 bits, so that no sum of a block passes 64 bits.
                total = total + ((a >> 32).sum(axis=0).astype(object) << 32) + (a & 0xFFFFFFFF).sum(axis=0).astype(object)
                n += len(a)
        yield pd.DataFrame({"pos": np.arange(width, dtype=np.int32), "n": np.full(width, n), "s": [Decimal(int(v)) for v in total]})

    got = blocks.mapInPandas(run, "pos int, n long, s decimal(38,0)").groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    return (got[0].n if got else 0), [int(r.s) for r in sorted(got, key=lambda r: r.pos)]


def _outside(basis: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``v`` without its part in the orthonormal columns of ``basis``; twice, for rounding."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def _fresh(basis: np.ndarray, width: int) -> np.ndarray:
    """A unit vector outside of ``basis``, the same in every run."""
    v = _outside(basis, np.random.default_rng(basis.shape[1]).standard_normal(width))
    return v / np.linalg.norm(v)


def fit(blocks: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Leading components of the covariance of the blocks; None without vectors. Directions without variance are no components."""
    n, sums = _exact_sums(blocks, width)
    if not n:
        return None
    mean, root = np.array([s / n for s in sums]), np.sqrt(n)

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - mean) / root

    trace = float(_summed(blocks, width, lambda x: np.array([(centred(x) ** 2).sum()]))[0])
    if not trace > 0:
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0)
    wanted = min(components, width)
    right, left = np.zeros((width, 0)), np.zeros((width, 0))  # v_j; g_j with u_j = X g_j
    back = np.zeros((width, 0))  # X' u_j
    alpha, beta = np.zeros(width), np.zeros(width)
    v, prior, link = _fresh(right, width), np.zeros(width), 0.0
    largest = np.sqrt(trace)
    for k in range(width):
        right = np.column_stack([right, v])
        h = v - link * prior
        ask = np.column_stack([left, h])

        def products(x: np.ndarray, ask=ask) -> np.ndarray:
            c = centred(x)
            u = c @ ask
            return np.concatenate([u.T @ u[:, -1], c.T @ u[:, -1]])

        got = _summed(blocks, width, products)
        c, norm2, q = got[:k], got[k], got[k + 1:]
        h, q, norm2 = h - left @ c, q - back @ c, norm2 - c @ c
        a = np.sqrt(max(norm2, 0.0))
        if a > NOTHING * largest:
            alpha[k], prior = a, h / a
            u_back = q / a
        else:  # X v is in the space of the earlier left vectors
            alpha[k], prior, u_back = 0.0, np.zeros(width), np.zeros(width)
        left, back = np.column_stack([left, prior]), np.column_stack([back, u_back])
        rest = _outside(right, u_back - alpha[k] * v)
        link = float(np.linalg.norm(rest))
        if link <= NOTHING * largest:
            link, rest = 0.0, None
        small = np.diag(alpha[:k + 1]) + np.diag(beta[:k], 1)
        p, sigma, qt = np.linalg.svd(small)
        hidden = trace - float((sigma ** 2).sum())
        done = k + 1 >= wanted and link * np.abs(p[k, :wanted]).max() <= RESIDUAL * largest and hidden < sigma[wanted - 1] ** 2
        if done or k + 1 == width:
            break
        beta[k] = link
        v = rest / link if rest is not None else _fresh(right, width)
    real = sigma[:wanted] > NOTHING * largest
    axes = right @ qt[:wanted].T[:, real]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return Whitening(n, sums, axes, sigma[:wanted][real] ** 2, trace, k + 1)


def identity_error(blocks: DataFrame, width: int, w: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    mean, turn, m = w.mean, w.components / np.sqrt(w.values), len(w.values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ turn
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    got = _summed(blocks, width, moments) / w.n
    return float(np.abs(got[m:].reshape(m, m) - np.outer(got[:m], got[:m]) - np.eye(m)).max())


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over dimensions of (n * x - sums)^2; None where it passes 64 bits."""
    most = n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(map(abs, sums))
    if most * most * max(1, x.shape[1]) <= LONG:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    return [int(v) if v <= LONG else None for v in exact]


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row and component.

    Rows whose vector is null or holds a null or non-finite entry are dropped;
    rows of a null id stay. An empty vector counts as zeros. Entries become
    floor(scale * c), at the ends of 64 bits where they pass them. Repeated
    vectors count once in the fit and come out once per row. Components without
    variance do not come out, so a table of equal vectors, like an empty one,
    gives no rows. ``deviation`` is exact, null where it passes 64 bits. Other
    columns are not read.
    """
    rows, width = whole_vectors(vectors, vec_id, vector, scale)
    kind = vectors.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    blocks = fit_blocks(rows, width) if width else None
    w = fit(blocks, width, components) if width else None
    if w is None or not len(w.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(blocks, width, w)
    mean, turn, share, m = w.mean, w.components / np.sqrt(w.values), w.values / w.trace, len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy().reshape(-1, width)
            z = (x - mean) @ turn
            far = pa.array(_deviation(x, w.n, w.sums), pa.int64())
            each = np.repeat(np.arange(len(x)), m)  # Arrow's own ids: pandas would round long ones beside nulls
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), w.n, dtype=np.int64)),
                far.take(pa.array(each)), pa.array(z.ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(each), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
