"""Best-row, top-k and sampling operators.

One row per key is an aggregate (``min_by`` with map-side combine), so a hot key
is reduced before it is shuffled. Top-k per key is a ``row_number`` filter, for
which Spark keeps only k rows per key and task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.numeric import hash_key
from cohortwise.operators.ordering import positions, quantiles


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], extra: Sequence[Column] = ()) -> DataFrame:
    """First row per key in the given ascending order (negate for descending).

    ``extra`` are aggregates over all rows of the key, e.g. candidate counts.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__best")
    out = df.groupBy(*keys).agg(picked, *extra)
    names = [c for c in out.columns if c not in keys and c != "__best"]
    return out.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest], *names)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str | None = "rank") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    return (out.withColumn(rank, F.col("__rn").cast("bigint")) if rank else out).drop("__rn")


def sample_per_group(df: DataFrame, group: Sequence[str], item: str, n: int, seed: int) -> DataFrame:
    """``n`` rows per group by a seeded hash of the item id."""
    h = df.withColumn("__h", hash_key(F.lit(seed), F.col(item)))
    return top_per_group(h, group, [F.col("__h"), F.col(item)], n, None).drop("__h")


def control_sample(df: DataFrame, group: Sequence[str], score: str, item: str, n: int, seed: int) -> DataFrame:
    """``n`` random rows at or below the group median; wider pools when it is small."""
    cut = quantiles(df, group, score, {"__cut": 0.5})
    flagged = df.join(cut, list(group)).withColumn("__low", F.col(score) <= F.col("__cut"))
    pool = flagged.groupBy(*group).agg(F.count_if("__low").alias("__pool"), F.count(F.lit(1)).alias("__all"))
    use = flagged.join(pool, list(group)).where(
        F.col("__low") | (F.col("__pool") < n) | (F.col("__all") <= n))
    return sample_per_group(use, group, item, n, seed).drop("__cut", "__low", "__pool", "__all")


def evenly_spaced(df: DataFrame, group: Sequence[str], key: str, order_by: Sequence[Column], k: int, tie_key: str | None = None) -> DataFrame:
    """At most ``k`` rows per group at evenly spaced positions of the order.

    Row ``i`` is kept when some ``j`` in ``0..k-1`` rounds (half to even) to it;
    only the neighbours of ``i * (k - 1) / (n - 1)`` can.
    """
    ranked = positions(df, group, key, order_by, tie_key=tie_key, out="__p")
    i, n = F.col("__p") - 1, F.col("n_group")
    step = (n - 1) / F.lit(float(max(k - 1, 1)))
    near = F.round(F.try_divide(i.cast("double"), step))
    hit = F.lit(False)
    for d in (-1, 0, 1):
        j = near + d
        hit = hit | ((j >= 0) & (j <= k - 1) & (F.bround(j * step) == i))
    return ranked.where((n <= k) | hit).drop("__p", "n_group")


def bounded_pilot(df: DataFrame, group: Sequence[str], size: str, low: float, high: float, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows within the size bounds; a group with none uses all its rows."""
    inside = F.col(size).between(low, high)
    has = df.groupBy(*group).agg(F.count_if(inside).alias("__in"))
    use = df.join(has, list(group)).where(inside | (F.col("__in") == 0)).drop("__in")
    return top_per_group(use, group, order, k)


def representatives_near_centre(df: DataFrame, group: Sequence[str], distance: str, score: str, item: str, status: str,
                                candidates: int, k: int) -> DataFrame:
    """Closest candidates first, then the ones that pass the quality gate, then the rest."""
    near = top_per_group(df, group, [F.col(distance), F.col(score).desc(), F.col(item)], candidates, "candidate_rank")
    order = [F.when(F.col(status) == "PASS", 0).otherwise(1), F.col("candidate_rank")]
    return top_per_group(near, group, order, k, "selection_rank")


def level_order(resolution: Column, frames: Column, target: float) -> list[Column]:
    """Sort key of acquisition levels: derived, then native distance to the target, then frames."""
    scale = F.greatest(F.bround(F.lit(target) / resolution), F.lit(1.0))
    return [F.abs(F.log2(resolution * scale / target)), F.abs(F.log2(resolution / target)), frames]
