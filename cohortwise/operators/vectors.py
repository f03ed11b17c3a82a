"""Long rows to vectors and bounded models applied to them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

MAX_FEATURES = 20_000


def feature_names(df: DataFrame, feature: str, limit: int = MAX_FEATURES) -> list[str]:
    """Sorted feature names; the length of the list is checked."""
    names = [r[0] for r in df.select(feature).distinct().limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} features; select features first")
    return sorted(names)


def to_vectors(df: DataFrame, keys: Sequence[str], feature: str, value: str, names: Sequence[str], out: str = "x") -> DataFrame:
    """One ``array<double>`` per key in the order of ``names``; absent cells are NULL."""
    width = len(names)
    index = df.sparkSession.createDataFrame(list(enumerate(names)), f"__i int, {feature} string")

    @pandas_udf("array<double>")
    def spread(idx: pd.Series, val: pd.Series) -> pd.Series:
        rows = []
        for i, v in zip(idx, val):
            x = np.full(width, np.nan)
            x[np.asarray(i, dtype=int)] = np.asarray(v, dtype=float)
            rows.append([None if np.isnan(a) else float(a) for a in x] if np.isnan(x).any() else x)
        return pd.Series(rows)

    cells = df.where(F.col(value).isNotNull()).join(index, feature)
    cells = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", F.col(value).cast("double").alias("v")))).alias("c"))
    return cells.select(*keys, spread(F.col("c.__i"), F.col("c.v")).alias(out))


def to_long(df: DataFrame, keys: Sequence[str], vec: str, names: Sequence[str], feature: str = "feature", value: str = "value") -> DataFrame:
    labels = F.array(*[F.lit(n) for n in names])
    return df.select(*keys, F.posexplode(vec).alias("__p", value)).select(*keys, F.get(labels, F.col("__p")).alias(feature), value)


def matrix(series: pd.Series) -> np.ndarray:
    """Column of equally long lists to a 2-d array with NaN for missing cells."""
    if not len(series):
        return np.zeros((0, 0))
    return np.array([np.asarray(v, dtype=float) for v in series])


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a model-sized table (factors, weights); larger tables are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def best_match(df: DataFrame, keys: Sequence[str], vec: str, reference: DataFrame, label: str, ref_vec: str, limit: int = 1000) -> DataFrame:
    """Most cosine-similar reference vector per row; only the best one is emitted."""
    ref = sorted(bounded_rows(reference.select(label, ref_vec), limit, "reference factors"), key=lambda r: str(r[0]))
    names = [str(r[0]) for r in ref]
    mat = np.array([np.asarray(r[1], dtype=float) for r in ref])
    unit = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-300)

    @pandas_udf("struct<label: string, cosine: double>")
    def match(v: pd.Series) -> pd.DataFrame:
        x = matrix(v)
        if not len(x):
            return pd.DataFrame({"label": [], "cosine": []})
        sim = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ unit.T
        best = sim.argmax(axis=1)
        return pd.DataFrame({"label": [names[i] for i in best], "cosine": sim[np.arange(len(x)), best]})

    return df.select(*keys, match(F.col(vec).cast("array<double>")).alias("m")).select(*keys, F.col("m.label").alias("matched"), F.col("m.cosine").alias("cosine"))
