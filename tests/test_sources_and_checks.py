"""Readers, writers, resume, gates and skewed joins on small edge fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.functions import text as tx
from cohortwise.operators import checks as ck
from cohortwise.operators import joins as jn
from cohortwise.operators import stats as st
from cohortwise.operators import windows as wn
from cohortwise.session import new_path, scratch_dir
from cohortwise.sources import tables as src
from cohortwise.streaming.resume import resume


class _Session:
    """Just the two settings the scratch rule looks at."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}"})()


def test_scratch_follows_the_cluster_setting():
    assert scratch_dir(_Session("s3a://bucket/x/", "yarn")) == "s3a://bucket/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(_Session(None, "yarn"))
    local = _Session(None, "local[2]")
    assert scratch_dir(local) == scratch_dir(local) != ""


def test_set_file_skips_short_lines(spark):
    path = new_path(spark, "t")
    spark.createDataFrame([("s1\tna\ta\tb\t",), ("s2\tna",), ("",), ("s3\tna\tc",)], "value string").write.text(path)
    got = sorted((r["set_name"], r["feature"]) for r in src.read_sets(spark, path).collect())
    assert got == [("s1", "A"), ("s1", "B"), ("s3", "C")]


def test_wide_matrix_names_absent_columns(spark):
    path = new_path(spark, "t")
    spark.createDataFrame([("f1", 1.0, 2.0)], "feature string, `a:x` double, `b:y` double").write.option("header", True).option("sep", "\t").csv(path)
    sel = spark.createDataFrame([("a:x", "e1"), ("c:z", "e2")], "matrix_column string, entity string")
    with pytest.raises(ValueError, match="c:z"):
        src.read_wide_matrix(spark, path, sel)
    got = src.read_wide_matrix(spark, path, sel, require_all=False).collect()
    assert [(r["entity"], r["feature"], r["value"]) for r in got] == [("e1", "f1", 1.0)]


def test_json_report_has_no_non_finite_numbers(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 0.5)], "id int, v double")
    assert sorted(r[0] for r in src.json_rows(df).collect()) == ['{"id":1,"v":null}', '{"id":2,"v":null}', '{"id":3,"v":0.5}']


def test_resume_runs_only_pending_keys(spark):
    path = new_path(spark, "resume")
    seen = []

    def run(df):
        seen.append(sorted(r["k"] for r in df.collect()))
        return df.withColumn("v", F.col("k") * 2)

    resume(spark.createDataFrame([(1,), (2,)], "k int"), path, ["k"], run)
    out = resume(spark.createDataFrame([(1,), (2,), (3,)], "k int"), path, ["k"], run)
    assert seen == [[1, 2], [3]] and sorted(r["v"] for r in out.collect()) == [2, 4, 6]


def test_validated_join_rejects_repeats_and_gaps(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    with pytest.raises(ValueError, match="repeats"):
        jn.validated_join(a, a.union(a).withColumnRenamed("a", "b"), ["k"])
    with pytest.raises(ValueError, match="missing"):
        jn.validated_join(a, a.where("k = 1").withColumnRenamed("a", "b"), ["k"], required=["b"])


def test_gate_refuses_failed_verdict(spark):
    n = F.count(F.lit(1))
    bad = ck.verdict(ck.check_rows(spark.range(3), {"rows": (n > 5, n, "FAIL")}))
    with pytest.raises(RuntimeError):
        ck.require_pass(bad)
    ck.require_pass(ck.verdict(ck.check_rows(spark.range(3), {"rows": (n > 5, n, "WARN")})))


def test_target_is_the_most_adverse_factor(spark):
    d = spark.createDataFrame([("A1", 0.1, True), ("A2", 0.4, True), ("A3", 0.9, False)], "factor string, mean_r double, adverse boolean")
    assert ck.choose_target(d) == "A2"


def test_constant_and_missing_features(spark):
    df = spark.createDataFrame([("c", 1, 5.0), ("c", 2, 5.0), ("d", 1, None), ("d", 2, 1.0)], "f string, id int, v double")
    pop = {(r["f"], r["id"]): r["z"] for r in wn.zscore_population(df, ["f"], "v").collect()}
    assert pop == {("c", 1): 0.0, ("c", 2): 0.0, ("d", 1): 0.0, ("d", 2): 0.0}
    samp = {(r["f"], r["id"]): r["z"] for r in wn.zscore_sample(df, ["f"], "v").collect()}
    assert samp == {("c", 1): 0.0, ("c", 2): 0.0, ("d", 1): None, ("d", 2): 0.0}


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([("a", 800.0, 1.0), ("a", 801.0, 2.0), ("b", -5.0, 3.0)], "bag string, l double, v double")
    got = wn.softmax_pool(df, ["bag"], "l", "v").groupBy("bag").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(1.0) for r in got)


def test_auc_and_precision_need_two_classes(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.4), ("b", 1, 0.9), ("b", 0, 0.1), ("b", 0, 0.9)], "g string, y int, s double")
    got = {r["g"]: r["auc"] for r in st.roc_auc(df, ["g"], "y", "s").collect()}
    assert got["a"] is None and got["b"] == pytest.approx(0.75)
    assert {r["g"]: r["average_precision"] for r in st.average_precision(df, ["g"], "y", "s").collect()}["b"] == pytest.approx(0.5)


def test_rank_tests_match_direct_formulas(spark):
    rng = np.random.default_rng(0)
    a, b = np.round(rng.normal(0.4, 1, 40), 1), np.round(rng.normal(0, 1, 40), 1)
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(a, b)], "g string, a double, b double")
    d = (a - b)[a != b]
    order = np.abs(d)
    rank = np.array([(order < v).sum() + ((order == v).sum() + 1) / 2 for v in order])
    got = st.wilcoxon_greater(df, ["g"], "a", "b").first()
    assert got["w_plus"] == pytest.approx(rank[d > 0].sum())
    assert 0 < got["p"] < 0.5


def test_polygon_and_box_area(spark):
    df = spark.sql("SELECT array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 3D)) AS p")
    row = df.select(tx.polygon_area(F.col("p")).alias("a"), tx.polygon_area(F.slice("p", 1, 2)).alias("b"), tx.box_area(F.lit(2.0), F.lit(0.0), F.lit(1.0), F.lit(5.0)).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (6.0, None, 0.0)


def test_dense_counts_fill_zero(spark):
    c = spark.createDataFrame([(1, "x", 3)], "e int, k string, n int")
    extra = spark.createDataFrame([(2, "y", 1)], "e int, k string, n int")
    got = sorted((r["e"], r["k"], r["n"]) for r in jn.dense_counts(c.union(extra), c.union(extra), ["e"], "k", "n").collect())
    assert got == [(1, "x", 3), (1, "y", 0), (2, "x", 0), (2, "y", 1)]


@pytest.mark.parametrize("name", ["v2", "v12", "v13"])
def test_views_of_order_lines_take_parts_by_the_lines(spark, sf, monkeypatch, name):
    from cohortwise.plans import views

    whole = sorted(map(tuple, views.view(spark, sf, name).collect()))
    monkeypatch.setattr(views, "LINES_PER_TASK", 500)
    cut = views.view(spark, sf, name)
    lines = views.table(spark, sf, "lineitem").count()
    assert f", {-(-lines // 500)})" in cut._jdf.queryExecution().executedPlan().toString().replace("REPARTITION_BY_NUM", "")
    assert sorted(map(tuple, cut.collect())) == whole


def test_long_rows_are_not_shuffled_to_meet_a_few_sets(spark, sf):
    from cohortwise.operators import scoring as sc
    from cohortwise.plans import views
    from cohortwise.session import materialize

    z = materialize(sc.standardised(views.view(spark, sf, "v2")), "z")
    sets = views.view(spark, sf, "v8")
    for out in (sc.set_scores(z, sets), sc.weighted_scores(z, sets), sc.standardised(z.withColumnRenamed("z", "value"))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning(feature" not in plan


def test_site_keys_do_not_move_the_rows_again(spark, sf):
    from cohortwise.operators import scoring as sc
    from cohortwise.operators import windows as wn
    from cohortwise.session import materialize

    rows = [("a", e, f"NP_{f}:s{f}t{f}", float(e * f % 5)) for e in range(9) for f in range(1, 5)]
    df = materialize(spark.createDataFrame(rows, "cohort string, entity int, feature string, value double"), "sites")
    smap = spark.createDataFrame([(f"NP_{f}:s{f}t{f}", f"P{f // 2};{s}{f % 2}-p") for f in range(1, 5) for s in "ST"] + [("NP_1:s1t1", "")], "feature string, site_key string")
    plans, real = [], wn.materialize
    wn.materialize = lambda d, label="stage": plans.append(d._jdf.queryExecution().executedPlan().toString()) or real(d, label)
    try:
        got = {tuple(r)[:3]: r.z for r in sc.site_matrix(df, smap).collect()}
    finally:
        wn.materialize = real
    assert "REPARTITION_BY_NUM" in plans[0] and "ENSURE_REQUIREMENTS" not in plans[0]
    value = {}
    for c, e, f, v in rows:
        for s in {k.site_key for k in smap.collect() if k.feature == f and k.site_key}:
            value.setdefault((c, e, s), []).append(v)
    mean = {k: np.mean(v) for k, v in value.items()}
    assert set(got) == set(mean)
    for k, v in mean.items():
        all_ = np.array([m for kk, m in mean.items() if kk[2] == k[2]])
        assert got[k] == pytest.approx((v - all_.mean()) / all_.std() if all_.std() > 0 else 0.0)


def test_standardised_rows_of_an_entity_stand_together(spark, sf):
    from cohortwise.operators import scoring as sc
    from cohortwise.plans import views
    from cohortwise.session import materialize

    z = materialize(sc.standardised(views.view(spark, sf, "v2")), "z")
    places = z.select("cohort", "entity", F.input_file_name().alias("file")).distinct()
    assert places.count() == z.select("cohort", "entity").distinct().count()


def test_entity_concordance_shuffles_by_entity_once(spark):
    rng = np.random.default_rng(4)
    rows = [(c, e, None if rng.random() < 0.1 else float(rng.integers(6)), float(rng.integers(9))) for c in "ab" for e in range(7) for _ in range(e + 1)]
    df = spark.createDataFrame(rows, "cohort string, entity int, a double, b double")
    out = st.entity_concordance(df, ["cohort", "entity"], "a", "b", 3)
    want = {(r.cohort, r.entity): (r.n, r.rho) for r in st.spearman(df, ["cohort", "entity"], "a", "b", "rho", 3).collect()}
    got = {(r.cohort, r.entity): (r.n, r.rho) for r in out.collect()}
    assert set(got) == set(want)
    assert all(got[k][0] == n and (got[k][1] is None if r is None else got[k][1] == pytest.approx(r)) for k, (n, r) in want.items())
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
