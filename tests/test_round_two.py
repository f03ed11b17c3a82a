"""Cases that earlier versions got wrong: empty groups, far tails, white space."""

import math

import pytest
from pyspark.sql import functions as F

from cohortwise.functions import tails, text
from cohortwise.operators import impute, regression


def frame(spark, rows):
    return spark.createDataFrame(rows, "cohort string, entity long, feature string, value double")


def test_knn_without_holes_and_with_blank_entities(spark):
    rows = [("full", e, f"f{j}", float(e + j)) for e in range(6) for j in range(3)]
    rows += [("holes", e, f"f{j}", None if e == 0 or (e, j) == (1, 2) else float(e * j)) for e in range(6) for j in range(3)]
    df = frame(spark, rows)
    out = impute.knn_impute(df, k=2, block_rows=2)
    assert out.count() == 36
    assert {r[0] for r in out.select("entity").distinct().collect()} == set(range(6))
    blank = {r.feature: r.value for r in out.where("cohort = 'holes' AND entity = 0").collect()}
    mean = {r.feature: r.m for r in df.where("cohort = 'holes'").groupBy("feature").agg(F.avg("value").alias("m")).collect()}
    assert blank == pytest.approx(mean)
    assert out.where("value IS NULL").isEmpty()


def test_knn_where_nothing_is_missing(spark):
    df = frame(spark, [("a", e, "f", float(e)) for e in range(5)])
    assert impute.knn_impute(df).count() == 5


def test_models_of_a_cohort_without_one(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("b", 2, [3.0, 4.0])], "cohort string, entity long, x array<double>")
    models = spark.createDataFrame([("a", [1.0], [2.0, 3.0])], "cohort string, intercept array<double>, coef array<double>")
    assert [tuple(r) for r in regression.apply_models(df, models, ["cohort"], ["entity"]).collect()] == [("a", 1, [9.0])]


@pytest.mark.parametrize("n", [10**6, 10**8, 10**10, 10**12])
def test_binomial_tail_meets_the_normal_limit(n):
    for z in (0.0, 1.0, 3.0):
        k = int(n / 2 + z * math.sqrt(n) / 2) + 1
        want = tails.normal_upper((k - 0.5 - n / 2) / math.sqrt(n / 4))
        assert tails.binomial_upper(k, n) == pytest.approx(want, rel=1e-4)


def test_fisher_small_and_large():
    for a, b, c, d in [(3, 1, 1, 3), (0, 5, 4, 1), (8, 2, 1, 5), (1, 0, 0, 0)]:
        r, col, n = a + b, a + c, a + b + c + d
        p = [math.comb(r, k) * math.comb(n - r, col - k) for k in range(max(0, col - (n - r)), min(r, col) + 1)]
        seen = p[a - max(0, col - (n - r))]
        assert tails.fisher_two_sided(a, b, c, d) == pytest.approx(sum(x for x in p if x <= seen * (1 + 1e-7)) / sum(p))
    z = 225 / math.sqrt(4e6 / 16)  # 225 below the expected count
    assert tails.fisher_two_sided(10**6, 10**6 + 900, 10**6, 10**6) == pytest.approx(2 * tails.normal_upper(z), rel=0.02)
    assert tails.fisher_two_sided(10**9, 0, 0, 10**9) == 0.0


def test_all_white_space_is_stripped(spark):
    got = spark.createDataFrame([("\tUnknown\n",), (" x\r\n",), ("\x0b",)], "v string").select(text.norm_missing(F.col("v"))).collect()
    assert [r[0] for r in got] == [None, "x", None]


def test_a_view_task_takes_a_quarter_of_a_million_lines(spark, monkeypatch):
    from cohortwise.plans import views

    keys = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
    monkeypatch.setattr(views, "table", lambda spark, sf_dir, name: spark.range(6_000_000).withColumnRenamed("id", keys[name]))
    plan = views._spread(spark, "", list(keys))["lineitem"]._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in plan and ", 24" in plan
