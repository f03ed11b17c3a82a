"""Reproducible cross-validation folds from seeded hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.numeric import hash_key
from cohortwise.operators.ordering import hash_positions


def _repeated(df: DataFrame, entity: Sequence[str], repeats: int, seed: int) -> DataFrame:
    r = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return r.withColumn("__h", hash_key(F.lit(seed), F.col("repeat"), *[F.col(c) for c in entity]))


def kfold(df: DataFrame, group: Sequence[str], entity: str, folds: int, repeats: int, seed: int) -> DataFrame:
    """``(group, entity, repeat, fold)``; each entity is held out once per repeat."""
    rows = _repeated(df.select(*group, entity).distinct(), [entity], repeats, seed)
    pos = hash_positions(rows, [*group, "repeat"], "__h", [F.col(entity)])
    return pos.select(*group, entity, "repeat", ((F.col("position") - 1) % folds).cast("int").alias("fold"))


def stratified_kfold(df: DataFrame, group: Sequence[str], entity: str, y: str, folds: int, repeats: int, seed: int) -> DataFrame:
    """K-fold within each class; the smallest class bounds the number of folds."""
    known = df.where(F.col(y).isNotNull()).select(*group, entity, y).distinct()
    k = (known.groupBy(*group, y).agg(F.count(F.lit(1)).alias("c")).groupBy(*group)
         .agg(F.greatest(F.lit(2), F.least(F.lit(folds), F.min("c"))).cast("int").alias("n_folds")))
    pos = hash_positions(_repeated(known, [entity], repeats, seed), [*group, y, "repeat"], "__h", [F.col(entity)])
    return pos.join(k, list(group)).select(*group, entity, y, "repeat", ((F.col("position") - 1) % F.col("n_folds")).cast("int").alias("fold"), "n_folds")


def group_kfold(df: DataFrame, entity: Sequence[str], folds: int, seed: int, row_id: str | None = None) -> DataFrame:
    """All rows of an entity share one fold (hash order of the distinct entities).

    With a single entity the rows themselves are split, by ``row_id``.
    """
    if row_id is not None and df.select(*entity).distinct().limit(2).count() < 2:
        entity = [row_id]
    ids = df.select(*entity).distinct()
    pos = hash_positions(_repeated(ids, entity, 1, seed), ["repeat"], "__h", [F.col(c) for c in entity])
    return df.join(pos.select(*entity, ((F.col("position") - 1) % folds).cast("int").alias("fold")), list(entity))


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """The held-out fold of a row is its own group."""
    return df.withColumn("fold", F.col(group))
