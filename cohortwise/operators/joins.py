"""Joins with stated guarantees, key algebra and master-table assembly.

No side is force-broadcast: adaptive execution does so from the measured size
and splits skewed keys of the other join strategies.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> None:
    """Fail when a key repeats; only one offending key reaches the driver."""
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"{what} repeats the key {bad[0].asDict()}")


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", required: Sequence[str] = (),
                   one_to_one: bool = True) -> DataFrame:
    """Equi-join that fails on repeated keys or on missing required columns."""
    assert_unique(right, keys, "right side")
    if one_to_one:
        assert_unique(left, keys, "left side")
    out = left.join(right, list(keys), how)
    for c in required:
        if not out.where(F.col(c).isNull()).isEmpty():
            raise ValueError(f"required column {c} has missing values after the join")
    return out


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return validated_join(left, right, keys, "left", one_to_one=False)


def map_values(df: DataFrame, mapping: DataFrame, key: str, source: str, target: str, out: str) -> DataFrame:
    """Translate ``key`` through a mapping; unmapped rows are dropped."""
    m = mapping.select(F.col(source).alias(key), F.col(target).alias(out)).where(F.col(out).isNotNull()).distinct()
    return df.join(m, key)


def members(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(keys_df.select(*keys).distinct(), list(keys), "left_semi")


def common_keys(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys present in every frame, with one shuffle for all of them."""
    tagged = [f.select(*keys, F.lit(i).alias("__src")).distinct() for i, f in enumerate(frames)]
    return (reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") == len(frames)).drop("__n"))


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose multiplicity differs; empty when both hold the same keys."""
    both = a.select(*keys, F.lit(1).alias("__d")).unionByName(b.select(*keys, F.lit(-1).alias("__d")))
    return both.groupBy(*keys).agg(F.sum("__d").alias("difference")).where("difference <> 0")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> bool:
    return key_difference(a, b, keys).isEmpty()


def join_suffixed(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str], how: str = "inner") -> DataFrame:
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    def rename(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c + suffix) if c in shared else F.col(c) for c in df.columns])
    return rename(left, suffixes[0]).join(rename(right, suffixes[1]), list(keys), how)


def dense_counts(counts: DataFrame, entities: DataFrame, entity: Sequence[str], cluster: str, count: str, max_clusters: int = 10_000) -> DataFrame:
    """Every entity with every cluster, zero where there is no count.

    The cluster list is one row (its length is checked), so the product is an
    explode of each entity row and not a join of two tables.
    """
    labels = [r[0] for r in counts.select(cluster).distinct().limit(max_clusters + 1).collect()]
    if len(labels) > max_clusters:
        raise ValueError(f"more than {max_clusters} clusters")
    grid = entities.select(*entity).distinct().withColumn(cluster, F.explode(F.array(*[F.lit(x) for x in sorted(labels)])))
    return grid.join(counts.select(*entity, cluster, count), [*entity, cluster], "left").withColumn(count, F.coalesce(F.col(count), F.lit(0)))


def fill_by_priority(keys: DataFrame, sources: Sequence[tuple[str, DataFrame]], on: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Left join every source and take each field from the first that has it.

    Adds ``<source>_available`` flags. Each source holds one row per key.
    """
    out = keys
    for name, df in sources:
        cols = [F.col(f).alias(f"__{name}_{f}") for f in fields if f in df.columns]
        out = out.join(df.select(*on, *cols, F.lit(True).alias(f"__{name}")), list(on), "left")
    picked = []
    for f in fields:
        options = [F.col(f"__{n}_{f}") for n, d in sources if f in d.columns]
        picked.append(F.coalesce(*options).alias(f))
    flags = [F.coalesce(F.col(f"__{n}"), F.lit(False)).alias(f"{n}_available") for n, _ in sources]
    return out.select(*on, *picked, *flags)


def key_union(*frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select(*keys) for f in frames]).distinct()


def label_rows(df: DataFrame, rules: dict[str, Column], keys: Sequence[str], out: str = "set_name") -> DataFrame:
    """Overlapping boolean rules to one row per rule that holds."""
    options = F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return df.select(*keys, F.explode(F.filter(options, lambda v: v.isNotNull())).alias(out))
