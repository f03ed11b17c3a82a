"""Distributed ranks, positions, running values and quantiles under skew."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from cohortwise.operators import checks
from cohortwise.operators import ordering as od
from cohortwise.operators.aggregates import vector_median
from cohortwise.operators.selection import evenly_spaced
from cohortwise.operators.windows import bh_adjust, percentile_rank
from cohortwise.session import setting


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 20, n).astype(str)),
                        "v": np.where(rng.random(n) < 0.35, 7.0, np.round(rng.normal(5, 3, n), 2))})
    pdf.loc[pdf.index % 97 == 0, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf, df.cache()


def test_average_rank(skewed):
    pdf, df = skewed
    got = od.average_rank(df, ["g"], "v").toPandas().sort_values("id")
    want = pdf.groupby("g")["v"].rank(method="average")
    np.testing.assert_allclose(got["avg_rank"].to_numpy(dtype=float), want.to_numpy())


def test_positions_with_hot_ties(skewed):
    pdf, df = skewed
    known = pdf.dropna()
    got = od.positions(df.where("v IS NOT NULL"), ["g"], "v", [F.col("v"), F.col("id")], tie_key="id", pieces=16).toPandas().sort_values("id")
    want = known.sort_values(["v", "id"]).groupby("g").cumcount().sort_index() + 1
    assert got["position"].tolist() == want.tolist()
    assert got["n_group"].tolist() == known.groupby("g")["id"].transform("size").tolist()


def test_pieces_bound_the_hot_group(skewed):
    _, df = skewed
    known = df.where("v IS NOT NULL")
    cuts = od.cut_points(known, F.col("v"), 16)
    sub = od.range_piece(F.col("id"), od.cut_points(known, F.col("id"), 16), 16)
    piece = od.range_piece(F.col("v"), cuts, 16)
    sizes = known.withColumn("p", piece).withColumn("s", F.when(F.col("p") % 2 == 1, sub).otherwise(0)).groupBy("g", "p", "s").count()
    assert sizes.agg(F.max("count")).first()[0] <= 3 * 3000 / 16


@pytest.mark.parametrize("limit", [4096, 64, 16])
def test_many_pieces_keep_the_order(skewed, monkeypatch, limit):
    """Binary search, binary search with even steps, nested conditions with even steps."""
    monkeypatch.setattr(od, "MAX_CUTS", limit)
    pdf, df = skewed
    known = df.where("v IS NOT NULL")
    pieces = 256
    cuts = od.cut_points(known, F.col("id"), pieces)
    got = known.select("id", od.range_piece(F.col("id"), cuts, pieces).alias("p")).orderBy("id").toPandas()
    assert got["p"].is_monotonic_increasing and got["p"].nunique() > 128 and got["p"].max() < od.piece_span(cuts, pieces)
    pos = od.positions(known, ["g"], "v", [F.col("v"), F.col("id")], tie_key="id", pieces=pieces).toPandas().sort_values("id")
    want = pdf.dropna().sort_values(["v", "id"]).groupby("g").cumcount().sort_index() + 1
    assert pos["position"].tolist() == want.tolist()
    med = od.quantiles(df, ["g"], "v", {"m": 0.5}, pieces=pieces).toPandas().set_index("g").sort_index()
    np.testing.assert_allclose(med["m"], pdf.dropna().groupby("g")["v"].median().sort_index())


def test_hash_positions_match_sort(skewed):
    pdf, df = skewed
    got = od.hash_positions(df.withColumn("h", F.md5(F.col("id").cast("string"))), ["g"], "h", [F.col("id")]).toPandas()
    want = got.sort_values(["h", "id"]).groupby("g").cumcount() + 1
    assert (got["position"] == want.sort_index()).all()


def test_quantiles(skewed):
    pdf, df = skewed
    got = od.quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.975}, pieces=8).toPandas().set_index("g").sort_index()
    for name, q in (("a", 0.1), ("m", 0.5), ("z", 0.975)):
        want = pdf.dropna().groupby("g")["v"].quantile(q).sort_index()
        np.testing.assert_allclose(got[name].to_numpy(), want.to_numpy(), rtol=1e-12, atol=1e-12)


def test_quantiles_without_group_and_single_row(spark):
    df = spark.createDataFrame([("a", 3.0)], "g string, v double")
    assert od.quantiles(df, ["g"], "v", {"m": 0.9}).first()["m"] == 3.0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st_.lists(st_.floats(0, 1), min_size=1, max_size=40))
def test_bh_is_step_up(spark, ps):
    df = spark.createDataFrame([(i, "f", float(p)) for i, p in enumerate(ps)], "id int, fam string, p double")
    got = bh_adjust(df, ["fam"], "p").toPandas().sort_values("id")
    p = np.array(ps)
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1].clip(0, 1)
    want = np.empty(len(p))
    want[order] = q
    np.testing.assert_allclose(got["q"], want, rtol=1e-12)


def test_bh_keeps_missing(spark):
    df = spark.createDataFrame([(1, "f", 0.01), (2, "f", None), (3, "f", 0.04)], "id int, fam string, p double")
    got = {r["id"]: r["q"] for r in bh_adjust(df, ["fam"], "p").collect()}
    assert got[2] is None and got[1] == pytest.approx(0.02) and got[3] == pytest.approx(0.04)


def test_percentile_rank_of_one_row(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 1.0), ("b", 2, 2.0)], "g string, id int, v double")
    got = {(r["g"], r["id"]): r["percentile"] for r in percentile_rank(df, ["g"], "v", "id").collect()}
    assert got == {("a", 1): 1.0, ("b", 1): 0.0, ("b", 2): 1.0}


@pytest.mark.parametrize("n,k", [(50, 7), (7, 7), (3, 7), (101, 10), (12, 1)])
def test_evenly_spaced_positions(spark, n, k):
    df = spark.createDataFrame([("g", i, float(i)) for i in range(n)], "g string, id int, v double")
    got = sorted(r["id"] for r in evenly_spaced(df, ["g"], "v", [F.col("v"), F.col("id")], k).collect())
    want = sorted(set(np.linspace(0, n - 1, k).round().astype(int))) if n > k else list(range(n))
    assert got == want


def wobbling(spark_type):
    """Changes values by a few last bits, otherwise in every evaluation, as sums in the order of a shuffle's arrival do."""
    def run(s: pd.Series) -> pd.Series:
        rng = np.random.default_rng()
        return s.map(lambda v: np.asarray(v) * (1 + rng.integers(-4, 5, np.shape(v)) * 2.0**-52))

    return F.pandas_udf(run, spark_type).asNondeterministic()


def test_vector_median_of_means_that_differ_in_their_last_bits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5, 8))
    df = spark.createDataFrame([(g, [float(v) for v in row]) for g in range(40) for row in x[g]], "g int, x array<double>")
    with setting(spark, "spark.sql.shuffle.partitions", "64"):
        got = vector_median(df.withColumn("x", wobbling("array<double>")("x")), ["g"], "x").toPandas()
    assert len(got) == 40 * 8 and got["value"].notna().all()
    want = np.median(x, axis=1)[got["g"], got["position"]]
    np.testing.assert_allclose(got["value"], want, rtol=1e-12)


def test_quantiles_of_feature_means_read_the_same_means_again(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 9))
    df = spark.createDataFrame([(f, float(v)) for f in range(120) for v in x[f] - x[f].mean()], "feature int, z double")
    read = []

    def quantiles(means, *args):
        read.extend(sorted(means.collect()) for _ in range(2))
        return od.quantiles(means, *args)

    monkeypatch.setattr(checks, "quantiles", quantiles)
    got = checks.matrix_health(df.withColumn("z", wobbling("double")("z")), ["feature"], "z").first()
    assert read[0] == read[1] and len(read[0]) == 120
    assert got["p95_abs_mean"] == pytest.approx(np.quantile([m for m, in read[0]], 0.95), rel=1e-12) and got["max_abs_mean"] == max(read[0])[0]
