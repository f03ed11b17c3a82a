"""Ranks, running totals and exact quantiles that survive hot groups.

A plain ``Window.partitionBy(group)`` sorts a whole group in one task. Here the
ordering key is cut into value ranges first, so one group is worked on by many
tasks; only one small row per (group, range) is ever ordered per group.

A cut is taken over all rows, so no (group, range) piece holds more than about
``rows / pieces`` rows however skewed the groups are. The cut points only
balance the work: they are approximate, the results are exact.

Rows are read more than once, so their keys must be the same each time: sums of
floating numbers are written before they come here.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.numeric import HASH_SPAN, hash_number
from cohortwise.session import materialize

PIECE = "__piece"


# Boundaries used at most; more ranges come from even steps between them. Up to
# TREE_CUTS are compared by a nested condition, more by binary search.
TREE_CUTS = 32
MAX_CUTS = 4096
MAX_PIECES = 65_536


def default_pieces(df: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions."""
    return max(2, min(MAX_PIECES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cut_points(df: DataFrame, key: Column, pieces: int) -> list[float]:
    """Boundaries of near-equal mass, first and last value included (one small row).

    Quantile sketches are merged in salted groups first, so no task merges the
    sketches of all others. They only steer the split; results do not depend on it.
    """
    n = min(pieces, MAX_CUTS)
    probs = [i / n for i in range(n + 1)]
    salt = F.pmod(F.spark_partition_id(), F.lit(max(2, min(1000, pieces)))).alias("s")
    first = df.select(salt, key.cast("double").alias("k")).groupBy("s").agg(F.percentile_approx("k", probs, max(1000, 2 * n)).alias("c"))
    row = first.select(F.explode("c").alias("k")).agg(F.percentile_approx("k", probs, max(1000, 2 * n)).alias("c")).first()
    return sorted(set(row["c"] or []))


def piece_span(cuts: Sequence[float], pieces: int) -> int:
    """Exclusive upper bound of the numbers :func:`range_piece` gives."""
    return (2 * len(cuts) + 2) * max(1, -(-pieces // MAX_CUTS))


def range_piece(key: Column, cuts: Sequence[float], pieces: int = 1) -> Column:
    """Order-preserving range number; a boundary value gets a range of its own.

    Beyond ``MAX_CUTS`` ranges, each gap between boundaries is cut in even steps.
    """
    k = key.cast("double")
    sub = max(1, -(-pieces // MAX_CUTS))
    if len(cuts) > TREE_CUTS:
        return _searched_piece(k, cuts, sub)

    def gap(i: int) -> Column:
        base = 2 * i * sub
        if sub == 1 or i == 0 or i == len(cuts):
            return F.lit(base)
        return F.lit(base) + _even_step(k, F.lit(cuts[i - 1]), F.lit(cuts[i]), sub)

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            if lo == len(cuts):
                return gap(lo)
            return F.when(k == F.lit(cuts[lo]), F.lit((2 * lo + 1) * sub)).otherwise(gap(lo))
        mid = (lo + hi) // 2
        return F.when(k <= F.lit(cuts[mid]), node(lo, mid)).otherwise(node(mid + 1, hi))

    return node(0, len(cuts)).cast("bigint")


def _even_step(k: Column, lo: Column, hi: Column, sub: int) -> Column:
    step = F.floor(F.try_divide((k - lo) * F.lit(float(sub)), hi - lo))
    return F.coalesce(F.least(F.greatest(step, F.lit(0)), F.lit(sub - 1)), F.lit(0))


def _searched_piece(k: Column, cuts: Sequence[float], sub: int) -> Column:
    """Binary search in a constant array: about log2(cuts) comparisons per row."""
    n = len(cuts)
    arr = F.from_json(F.lit(json.dumps([float(c) for c in cuts])), "array<double>")
    jumps = F.array(*[F.lit(2**b) for b in reversed(range(n.bit_length()))])
    below = F.aggregate(jumps, F.lit(0), lambda at, jump: F.when((at + jump <= n) & (k > F.get(arr, at + jump - 1)), at + jump).otherwise(at))

    def number(i: Column) -> Column:
        inner = F.lit(0) if sub == 1 else F.when((i > 0) & (i < n), _even_step(k, F.get(arr, i - 1), F.get(arr, i), sub)).otherwise(F.lit(0))
        at = F.coalesce(k == F.get(arr, i), F.lit(False))
        return F.when(at, (2 * i + 1) * sub).otherwise(2 * i * sub + inner).cast("bigint")

    return F.get(F.transform(F.array(below), number), F.lit(0))


def _offsets(pieces: DataFrame, group: Sequence[str], aggs: dict[str, str]) -> DataFrame:
    """Exclusive running aggregate over the pieces of each group, plus totals."""
    w = Window.partitionBy(*group).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    full = Window.partitionBy(*group)
    cols = [F.col(g) for g in group] + [F.col(PIECE)] + [F.col(f"__t_{name}") for name in aggs]
    for name, fn in aggs.items():
        f = getattr(F, fn)
        cols += [f(f"__t_{name}").over(w).alias(f"__o_{name}"), f(f"__t_{name}").over(full).alias(f"{name}_total")]
    return pieces.select(*cols)


def running(df: DataFrame, group: Sequence[str], key: str, aggs: dict[str, str], order_by: Sequence[Column] | None = None,
            pieces: int | None = None) -> DataFrame:
    """Add ``<c>_before`` (exclusive running value) and ``<c>_total`` per group.

    ``aggs`` maps a column to ``sum``, ``min`` or ``max``. Callers aggregate to
    one row per (group, key) first, which also removes hot tied values.
    """
    pieces = pieces or default_pieces(df)
    df = df.withColumn(PIECE, range_piece(F.col(key), cut_points(df, F.col(key), pieces), pieces))
    w = (Window.partitionBy(*group, PIECE).orderBy(*(order_by or [F.col(key)]))
         .rowsBetween(Window.unboundedPreceding, -1))
    inner = df.select("*", *[getattr(F, fn)(c).over(w).alias(f"__i_{c}") for c, fn in aggs.items()])
    totals = df.groupBy(*group, PIECE).agg(*[getattr(F, fn)(c).alias(f"__t_{c}") for c, fn in aggs.items()])
    out = inner.join(_offsets(totals, group, aggs), [*group, PIECE])
    merged = []
    for c, fn in aggs.items():
        a, b = F.col(f"__i_{c}"), F.col(f"__o_{c}")
        if fn == "sum":
            expr = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        else:
            expr = (F.least if fn == "min" else F.greatest)(a, b)
        merged.append(expr.alias(f"{c}_before"))
    return out.select(*df.drop(PIECE).columns, *merged, *[f"{c}_total" for c in aggs])


def value_table(df: DataFrame, group: Sequence[str], value: str, sums: Sequence[Column] = (),
                pieces: int | None = None, sum_names: Sequence[str] = ()) -> DataFrame:
    """One row per (group, value) with tie count, average rank and running sums."""
    t = (df.where(F.col(value).isNotNull()).groupBy(*group, value)
         .agg(F.count(F.lit(1)).alias("ties"), *sums))
    out = running(t, group, value, {"ties": "sum", **{s: "sum" for s in sum_names}}, pieces=pieces)
    return out.withColumn("avg_rank", F.col("ties_before") + (F.col("ties") + F.lit(1)) / F.lit(2.0))


def average_rank(df: DataFrame, group: Sequence[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Add the tie-averaged rank of ``value`` within ``group`` (NULL stays NULL)."""
    ranks = value_table(df, group, value).select(*group, value, F.col("avg_rank").alias(out))
    return df.join(ranks, [*group, value], "left")


def positions(df: DataFrame, group: Sequence[str], key: str, order_by: Sequence[Column], tie_key: str | None = None,
              out: str = "position", descending: bool = False, pieces: int | None = None) -> DataFrame:
    """Exact ``row_number`` within ``group`` plus the group size ``n_group``.

    ``key`` is the leading numeric sort key; rows tied on a frequent key value
    are cut again by ``tie_key``. ``order_by`` is the full order.
    """
    pieces = pieces or default_pieces(df)
    sign = -1.0 if descending else 1.0
    k = F.col(key).cast("double") * F.lit(sign)
    cuts = cut_points(df, k, pieces)
    piece = range_piece(k, cuts, pieces)
    if tie_key is not None:
        ties = cut_points(df, F.col(tie_key), pieces)
        at_boundary = F.array_contains(F.from_json(F.lit(json.dumps([float(c) for c in cuts])), "array<double>"), k) if cuts else F.lit(False)
        sub = range_piece(F.col(tie_key), ties, pieces)
        piece = piece * F.lit(piece_span(ties, pieces)) + F.when(at_boundary, sub).otherwise(F.lit(0))
    return _numbered(df.withColumn(PIECE, piece), group, order_by, out)


def hash_positions(df: DataFrame, group: Sequence[str], digest: str, order_by: Sequence[Column],
                   out: str = "position", pieces: int | None = None) -> DataFrame:
    """``row_number`` ordered by a hex digest; its bits give even ranges at no cost."""
    pieces = pieces or default_pieces(df)
    piece = F.floor(hash_number(F.col(digest)) * F.lit(float(pieces) / HASH_SPAN)).cast("bigint")
    return _numbered(df.withColumn(PIECE, piece), group, [F.col(digest), *order_by], out)


def _numbered(df: DataFrame, group: Sequence[str], order_by: Sequence[Column], out: str) -> DataFrame:
    w = Window.partitionBy(*group, PIECE).orderBy(*order_by)
    inner = df.withColumn("__rn", F.row_number().over(w))
    sizes = df.groupBy(*group, PIECE).agg(F.count(F.lit(1)).alias("__t_n"))
    off = _offsets(sizes, group, {"n": "sum"})
    return (inner.join(off, [*group, PIECE])
            .withColumn(out, F.col("__rn") + F.coalesce(F.col("__o_n"), F.lit(0)))
            .withColumnRenamed("n_total", "n_group")
            .drop(PIECE, "__rn", "__o_n", "__t_n"))


def quantiles(df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float],
              pieces: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per prob.

    Range counts locate the order statistics first; only the ranges that hold
    one are counted value by value, so most rows are never shuffled.
    """
    pieces = pieces or default_pieces(df)
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"))
    rows = rows.withColumn(PIECE, range_piece(F.col("__v"), cut_points(rows, F.col("__v"), pieces), pieces))
    sizes = rows.groupBy(*group, PIECE).agg(F.count(F.lit(1)).alias("__t_n"))
    spans = _offsets(sizes, group, {"n": "sum"}).withColumn("__lo", F.coalesce(F.col("__o_n"), F.lit(0)))
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), (which - F.col("__lo")).alias("idx"), F.lit(side).alias("side"))
        for name, q in probs.items()
        for side, which in ((0, F.floor(F.lit(float(q)) * (F.col("n_total") - 1))),
                            (1, F.ceil(F.lit(float(q)) * (F.col("n_total") - 1))))
    ])
    inside = F.filter(wanted, lambda a: (a["idx"] >= 0) & (a["idx"] < F.col("__t_n")))
    targets = spans.select(*group, PIECE, "n_total", inside.alias("__w")).where(F.size("__w") > 0)
    counted = (rows.join(targets, [*group, PIECE]).groupBy(*group, PIECE, "__v")
               .agg(F.count(F.lit(1)).alias("__c"), F.first("__w").alias("__w"), F.first("n_total").alias("n_total")))
    w = Window.partitionBy(*group, PIECE).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("__b", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    picked = (counted.select(*group, "n_total", "__v", "__b", "__c", F.inline("__w"))
              .where((F.col("idx") >= F.col("__b")) & (F.col("idx") < F.col("__b") + F.col("__c"))))
    aggs = []
    for name, q in probs.items():
        is_q = F.col("name") == name
        lo = F.max(F.when(is_q & (F.col("side") == 0), F.col("__v")))
        hi = F.max(F.when(is_q & (F.col("side") == 1), F.col("__v")))
        pos = F.lit(float(q)) * (F.max("n_total") - 1)
        aggs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return materialize(picked.groupBy(*group).agg(*aggs), "quantiles")


def medians(df: DataFrame, group: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return quantiles(df, group, value, {out: 0.5})
