"""Repeated-seed K-means on principal scores with stability and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.operators import stats as st
from cohortwise.operators.ordering import medians
from cohortwise.session import materialize

# Cluster count rule.
MAX_CLUSTERS, ROWS_PER_CLUSTER = 12, 20


def cluster_count(n: int, requested: int = MAX_CLUSTERS) -> int:
    return max(2, min(requested, max(2, n // ROWS_PER_CLUSTER)))


def kmeans_repeated(df: DataFrame, vec: str, k: int, seeds: Sequence[int], max_iter: int = 20) -> tuple[DataFrame, DataFrame, list]:
    """Rows with ``label_<i>`` per seed and, for the first seed, cluster name and distance.

    Also returns one stability row: agreement with the first seed and cost.
    """
    data = df.withColumn("__f", array_to_vector(F.col(vec)))
    models = [KMeans(k=k, seed=s, featuresCol="__f", predictionCol=f"label_{i}", maxIter=max_iter).fit(data) for i, s in enumerate(seeds)]
    out = data
    for m in models:
        out = m.transform(out)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in models[0].clusterCenters()])
    own = F.get(centres, F.col("label_0"))
    dist = F.sqrt(F.aggregate(F.zip_with(vector_to_array("__f"), own, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v))
    out = out.withColumn("cluster_distance", dist).withColumn("cluster", F.concat(F.lit("M"), F.lpad((F.col("label_0") + 1).cast("string"), 2, "0"))).drop("__f")
    out = materialize(out, "clusters")
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), F.col(f"label_{i}").alias("b")) for i in range(1, len(seeds))])) if len(seeds) > 1 else None
    costs = [float(m.summary.trainingCost) for m in models]
    if pairs is None:
        ari = df.sparkSession.createDataFrame([(1.0, 1.0)], "mean_ari double, min_ari double")
    else:
        ari = st.adjusted_rand(out.select("label_0", pairs.alias("p")).select("label_0", "p.seed", "p.b"), ["seed"], "label_0", "b").agg(
            F.avg("ari").alias("mean_ari"), F.min("ari").alias("min_ari"))
    mean = sum(costs) / len(costs)
    sd = (sum((c - mean) ** 2 for c in costs) / (len(costs) - 1)) ** 0.5 if len(costs) > 1 else 0.0
    return out, ari.select(F.lit(k).alias("n_clusters"), F.lit(len(seeds)).alias("seeds"), "mean_ari", "min_ari", F.lit(mean).alias("cost_mean"), F.lit(sd).alias("cost_sd")), models


def cluster_summary(df: DataFrame, cluster: str, entity: Sequence[str], bag: Sequence[str], score: str, percentile: str) -> DataFrame:
    g = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct(*entity).alias("n_entities"), F.count_distinct(*bag).alias("n_bags"), F.avg(score).alias("mean_score"))
    return g.join(medians(df, [cluster], percentile, "median_percentile"), cluster)
