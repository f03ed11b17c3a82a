"""Consensus of many clusterings without a pair table.

Two entities agree in a start when their one-hot labels share a 1, so every
statistic of the n x n agreement matrix is a function of label-count sums:
the mean of c is sum(n_k^2), the mean of c^2 is the squared norm of the
one-hot Gram matrix, and mean agreement with a cluster is a lookup of that
cluster's label counts. The work is linear in the number of entities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.numeric import ratio
from cohortwise.session import materialize


# Labels (of all starts) whose joint counts a task holds at a time.
STRIP = 1024


def label_vectors(labels: DataFrame, entity: str = "entity", start: str = "start", label: str = "label") -> DataFrame:
    """(labels, times): the distinct label vectors, in start order, and how many entities have each."""
    each = labels.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(start, label))).alias("labels"))
    return each.groupBy("labels").agg(F.count(F.lit(1)).alias("times"))


def joint_counts(vec: DataFrame) -> DataFrame:
    """(a, b, c): how many entities have the labels coded a and b.

    A task multiplies one-hot blocks of distinct vectors, so a vector is one row
    for every ``STRIP`` labels, however many pairs of starts there are.
    """
    codes = vec.select(F.explode("labels").alias("l")).distinct().select("l", (F.row_number().over(Window.orderBy("l")) - 1).cast("int").alias("code"))
    codes = materialize(codes, "codes")
    width = codes.count()
    coded = vec.withColumn("v", F.monotonically_increasing_id()).select("v", "times", F.explode("labels").alias("l")).join(codes, "l")
    coded = coded.groupBy("v", "times").agg(F.collect_list("code").alias("codes"))
    strips = F.array_distinct(F.transform("codes", lambda c: F.floor(c / STRIP).cast("int")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for strip, part in pdf.groupby("strip"):
                hot = np.zeros((len(part), width))
                hot[np.repeat(np.arange(len(part)), [len(c) for c in part["codes"]]), np.concatenate(list(part["codes"]))] = 1.0
                own = hot[:, strip * STRIP:(strip + 1) * STRIP] * part["times"].to_numpy(dtype=float)[:, None]
                held[strip] = held.get(strip, 0.0) + own.T @ hot
        for strip, g in held.items():
            a, b = np.nonzero(g)
            yield pd.DataFrame({"a": (a + strip * STRIP).astype(np.int32), "b": b.astype(np.int32), "c": g[a, b]})

    parts = coded.select("times", "codes", F.explode(strips).alias("strip")).mapInPandas(run, "a int, b int, c double")
    return parts.groupBy("a", "b").agg(F.sum("c").alias("c"))


def dispersion(labels: DataFrame, entity: str = "entity", start: str = "start", label: str = "label") -> DataFrame:
    """Dispersion coefficient: mean over pairs of 4 (c - 1/2)^2; NULL when all agree."""
    vec = materialize(label_vectors(labels, entity, start, label), "label_vectors")
    size = vec.agg(F.struct(F.sum("times").alias("n"), F.max(F.size("labels")).alias("s")).alias("v")).scalar()
    sq = F.col("c") * F.col("c")
    j = joint_counts(vec).agg(F.sum(sq).alias("sq"), F.sum(F.when(F.col("a") == F.col("b"), sq).otherwise(F.lit(0.0))).alias("lin")).withColumn("v", size)
    j = j.select("sq", "lin", "v.n", "v.s")
    # Ordered distinct pairs: remove the n diagonal entries, each with c = 1.
    pairs = F.col("n").cast("double") * (F.col("n") - 1)
    s = F.col("s").cast("double")
    mean_c = (F.col("lin") / s - F.col("n")) / pairs
    mean_c2 = (F.col("sq") / (s * s) - F.col("n")) / pairs
    return j.select("n", F.col("s").alias("starts"), mean_c.alias("mean_consensus"),
                    F.when(mean_c < 1.0, 4 * mean_c2 - 4 * mean_c + 1).alias("dispersion"))


def cluster_agreement(labels: DataFrame, final: DataFrame, entity: str = "entity", start: str = "start", label: str = "label", cluster: str = "cluster") -> DataFrame:
    """Mean agreement of each entity with the members of every final cluster.

    Columns: entity, own, cluster, n_cluster, total (sum of agreements, self included).
    """
    tagged = labels.select(entity, start, label).join(final.select(entity, F.col(cluster).alias("own")), entity)
    counts = tagged.groupBy(start, label, F.col("own").alias(cluster)).agg(F.count(F.lit(1)).alias("c"))
    sizes = final.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_cluster"))
    starts = labels.agg(F.count_distinct(start)).first()[0]
    hits = tagged.join(counts, [start, label]).groupBy(entity, "own", cluster).agg((F.sum("c") / F.lit(float(starts))).alias("total"))
    k = [r[0] for r in sizes.select(cluster).limit(10_001).collect()]
    if len(k) > 10_000:
        raise ValueError("more than 10000 clusters")
    grid = final.select(entity, F.col(cluster).alias("own"), F.explode(F.array(*[F.lit(x) for x in k])).alias(cluster))
    full = grid.join(hits, [entity, "own", cluster], "left").join(sizes, cluster)
    return full.withColumn("total", F.coalesce("total", F.lit(0.0)))


def silhouette(agreement: DataFrame, entity: str = "entity", cluster: str = "cluster") -> DataFrame:
    """Per-entity silhouette on the distance 1 - agreement; singletons get 0."""
    own = F.col("own") == F.col(cluster)
    g = agreement.groupBy(entity, "own").agg(
        F.max(F.when(own, F.col("n_cluster"))).alias("n_own"),
        F.max(F.when(own, F.col("total"))).alias("t_own"),
        F.min(F.when(~own, F.lit(1.0) - F.col("total") / F.col("n_cluster"))).alias("b"))
    a = ratio(F.col("n_own") - F.col("t_own"), F.col("n_own") - 1)
    s = F.when(F.col("n_own") == 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - a, F.greatest(a, F.col("b"))), F.lit(0.0)))
    return g.select(entity, F.col("own").alias(cluster), F.when(F.col("b").isNotNull(), s).alias("silhouette"))


def within_between(agreement: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean agreement over pairs inside and across clusters and their margin."""
    own = F.col("own") == F.col(cluster)
    g = agreement.agg(
        F.sum(F.when(own, F.col("total") - 1)).alias("w"), F.sum(F.when(own, F.col("n_cluster") - 1)).alias("nw"),
        F.sum(F.when(~own, F.col("total"))).alias("b"), F.sum(F.when(~own, F.col("n_cluster"))).alias("nb"))
    w, b = ratio(F.col("w"), F.col("nw")), ratio(F.col("b"), F.col("nb"))
    return g.select(w.alias("within_mean"), b.alias("between_mean"), (w - b).alias("margin"))
