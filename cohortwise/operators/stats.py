"""Many-group tests and metrics computed from grouped sums.

The data pass is always an aggregate with map-side combine or a value table
(:mod:`ordering`); p-values are computed on the one row per test that remains.
Rank tests are exact for small samples and use the large-sample form with tie
correction beyond.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions import tails
from cohortwise.functions.numeric import ratio
from cohortwise.operators.aggregates import with_pooled
from cohortwise.operators.ordering import default_pieces, quantiles, value_table
from cohortwise.operators.windows import bh_adjust, spearman_ranks
from cohortwise.session import materialize

# Size limits and thresholds of the tests.
MIN_N, MIN_TEST, MIN_CLASS = 3, 10, 3
FLAG_RHO, FLAG_Q = 0.35, 0.10
CI_Z = 1.96
# Rows whose entities a task ranks.
ROWS_PER_TASK = 500_000


def correlation(a: str, b: str, min_n: int = MIN_N, eps: float = 1e-12) -> Column:
    """Pearson aggregate; missing for few pairs or a constant side."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    sx, sy = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    ok = (F.count_if(both) >= min_n) & (sx > eps) & (sy > eps)
    return F.when(ok, ratio(F.covar_pop(x, y), sx * sy))


def pearson(df: DataFrame, group: Sequence[str], a: str, b: str, out: str = "pearson", min_n: int = MIN_N) -> DataFrame:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.groupBy(*group).agg(F.count_if(both).alias("n"), correlation(a, b, min_n).alias(out))


def spearman(df: DataFrame, group: Sequence[str], a: str, b: str, out: str = "spearman", min_n: int = MIN_N) -> DataFrame:
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*group, a, b)
    return (spearman_ranks(known, group, a, b).groupBy(*group)
            .agg(F.count(F.lit(1)).alias("n"), correlation("rank_a", "rank_b", min_n).alias(out)))


def error_metrics(df: DataFrame, group: Sequence[str], obs: str, pred: str) -> DataFrame:
    e = F.col(obs) - F.col(pred)
    sse, sst = F.sum(e * e), F.var_pop(obs) * F.count(obs)
    return df.groupBy(*group).agg(
        F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(sse, sst)).alias("r2"))


def feature_metrics(df: DataFrame, group: Sequence[str], obs: str, pred: str) -> DataFrame:
    """Pearson, Spearman and error metrics per group of long rows."""
    base = error_metrics(df, group, obs, pred).join(pearson(df, group, obs, pred).drop("n"), list(group))
    return base.join(spearman(df, group, obs, pred).drop("n"), list(group), "left")


def _score_table(df: DataFrame, group: Sequence[str], y: str, score: str) -> DataFrame:
    known = df.where(F.col(y).isNotNull())
    return value_table(known, group, score, [F.sum(F.col(y).cast("double")).alias("pos")], sum_names=["pos"])


def roc_auc(df: DataFrame, group: Sequence[str], y: str, score: str) -> DataFrame:
    t = _score_table(df, group, y, score)
    g = t.groupBy(*group).agg(F.sum("pos").alias("np"), F.sum("ties").alias("n"), F.sum(F.col("pos") * F.col("avg_rank")).alias("rs"))
    nn = F.col("n") - F.col("np")
    return g.select(*group, "n", F.col("np").cast("bigint").alias("events"),
                    ratio(F.col("rs") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * nn).alias("auc"))


def average_precision(df: DataFrame, group: Sequence[str], y: str, score: str) -> DataFrame:
    t = _score_table(df, group, y, score)
    tp = F.col("pos_total") - F.col("pos_before")
    flagged = F.col("ties_total") - F.col("ties_before")
    return t.groupBy(*group).agg(F.sum(ratio(F.col("pos"), F.col("pos_total")) * ratio(tp, flagged)).alias("average_precision"))


def calibration_sums(df: DataFrame, group: Sequence[str], y: str, prob: str) -> DataFrame:
    d = F.col(prob) - F.col(y)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d * d).alias("brier"), F.avg(F.col(y).cast("double")).alias("observed_event_rate"),
        F.avg(prob).alias("predicted_event_rate"), ratio(F.sum(prob), F.greatest(F.sum(F.col(y).cast("double")), F.lit(1e-8))).alias("e_over_o"))


def classification_metrics(df: DataFrame, group: Sequence[str], y: str, prob: str) -> DataFrame:
    g = list(group)
    return (roc_auc(df, g, y, prob).join(average_precision(df, g, y, prob), g, "left")
            .join(calibration_sums(df, g, y, prob).drop("n"), g, "left"))


def two_class_tests(df: DataFrame, group: Sequence[str], value: str, y: str, family: Sequence[str] | None = None) -> DataFrame:
    """Mean difference, point-biserial r and Welch t per group; p and q when a family is given."""
    known = df.where(F.col(value).isNotNull() & F.col(y).isNotNull())
    one, zero = F.when(F.col(y) == 1, F.col(value)), F.when(F.col(y) == 0, F.col(value))
    g = known.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count(one).alias("n1"), F.count(zero).alias("n0"), F.avg(one).alias("m1"), F.avg(zero).alias("m0"),
        F.var_samp(one).alias("v1"), F.var_samp(zero).alias("v0"), correlation(value, y).alias("r0"))
    ok = (F.col("n") >= MIN_TEST) & (F.col("n1") >= MIN_CLASS) & (F.col("n0") >= MIN_CLASS)
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b))
    dof = F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))
    out = g.select(*group, "n", F.col("n1").alias("events"), F.col("n0").alias("nonevents"),
                   *[F.when(ok, e).alias(n) for n, e in (("mean_event", F.col("m1")), ("mean_nonevent", F.col("m0")), ("mean_diff", F.col("m1") - F.col("m0")),
                                                        ("r", F.col("r0")), ("t", t), ("dof", dof))])
    if family is None:
        return out
    return bh_adjust(materialize(out.withColumn("p", tails.t_p(F.col("t"), F.col("dof"))), "tests"), family, "p", "q")


def _with_ties(tests: DataFrame, values: DataFrame, group: Sequence[str], wanted: Column) -> DataFrame:
    """``tests`` with the mean ranks and tie counts of the groups that are ``wanted`` (of bounded size); empty lists for others."""
    keys = list(group) or ["__all"]
    if not group:
        tests, values = tests.withColumn("__all", F.lit(0)), values.withColumn("__all", F.lit(0))
    asked = tests.where(wanted).select(*keys)
    lists = values.join(asked, keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("avg_rank", "ties"))).alias("v"))
    none = F.array().cast("array<double>")
    return tests.join(lists, keys, "left").withColumns({"ranks": F.coalesce(F.col("v.avg_rank").cast("array<double>"), none), "counts": F.coalesce(F.col("v.ties").cast("array<double>"), none)})


def mann_whitney(df: DataFrame, group: Sequence[str], value: str, y: str, alternative: str = "two-sided", with_p: bool = True, method: str = "auto") -> DataFrame:
    """U of class 1 against class 0 with the tie-corrected normal deviate, and its p.

    ``auto``: p is exact where the smaller class has at most 8 rows and no two
    values are equal (``tails.EXACT_SMALLER``; beyond ``EXACT_PRODUCT`` pairs of
    rows the normal form is taken), else from the normal deviate with
    continuity correction. ``exact`` also counts ties out, in groups of up to
    ``tails.EXACT_TIED`` rows; ``large`` is always the normal form. ``p_method``
    says which one a row has.
    """
    t = _score_table(df.where(F.col(value).isNotNull()), group, y, value)
    g = t.groupBy(*group).agg(F.sum("pos").alias("n1"), F.sum("ties").alias("n"), F.sum(F.col("pos") * F.col("avg_rank")).alias("rs"),
                              F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("tie"))
    n, n1 = F.col("n"), F.col("n1")
    n0 = n - n1
    u = F.col("rs") - n1 * (n1 + 1) / 2
    mu = n1 * n0 / 2
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("tie"), n * (n - 1)), F.lit(0.0))))
    z = F.try_divide(F.abs(u - mu) - 0.5, sd) if alternative == "two-sided" else F.try_divide(mu - u - 0.5, sd)
    both = (n1 > 0) & (n0 > 0)
    out = g.select(*group, n1.cast("bigint").alias("n1"), n0.cast("bigint").alias("n0"), F.when(both, u).alias("u"), F.when(both, z).alias("z"), "tie")
    if not with_p:
        return out.drop("tie")
    small, work = F.least("n1", "n0") <= tails.EXACT_SMALLER, F.col("n1") * F.col("n0") <= tails.EXACT_PRODUCT
    plain = (F.col("tie") == 0) & small & work & (method != "large")
    tied = (F.col("n1") + F.col("n0") <= tails.EXACT_TIED) & ~plain & (method == "exact")
    out = materialize(out.withColumn("p_method", F.when(plain, "exact").when(tied, "exact_ties").otherwise("large")), "rank_tests")
    out = _with_ties(out, t, group, F.col("p_method") == "exact_ties")
    large = tails.normal_two_sided_p(F.when(F.col("z").isNotNull(), F.greatest("z", F.lit(0.0)))) if alternative == "two-sided" else tails.normal_upper_p(F.col("z"))
    # Each form sees only the rows it is for: a null statistic gives a null p without work.
    exact = tails.rank_sum_exact_p(F.when(F.col("p_method") != "large", F.col("u")), "n1", "n0", F.lit(alternative == "two-sided"), "ranks", "counts")
    return out.withColumn("p", F.coalesce(exact, large)).select(*group, "n1", "n0", "u", "z", "p", F.when(F.col("u").isNotNull(), F.replace("p_method", F.lit("_ties"), F.lit(""))).alias("p_method"))


def wilcoxon_greater(df: DataFrame, group: Sequence[str], a: str, b: str, with_p: bool = True, method: str = "auto") -> DataFrame:
    """Paired signed-rank statistic for a > b; zero differences are dropped. p from three pairs on.

    ``auto``: p is exact for up to 50 pairs without zero or equal absolute
    differences (``tails.EXACT_PAIRS``), else from the normal deviate with tie
    correction. ``exact`` also counts ties out and does not mind zeros, for up
    to that many pairs; ``large`` is always the normal form.
    """
    pairs = df.withColumn("__d", F.col(a) - F.col(b)).where(F.col("__d").isNotNull())
    d = pairs.where(F.col("__d") != 0).withColumn("__a", F.abs("__d"))
    t = value_table(d, group, "__a", [F.count_if(F.col("__d") > 0).cast("double").alias("up")])
    g = t.groupBy(*group).agg(F.sum("ties").alias("n"), F.sum(F.col("up") * F.col("avg_rank")).alias("w_plus"), F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("tie"))
    n = F.col("n").cast("double")
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48))
    if not with_p:
        return g.select(*group, "n", "w_plus", F.when(F.col("n") >= MIN_N, z).alias("z"))
    zeros = pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("pairs"))
    g = (g.join(zeros, list(group)) if group else g.withColumn("pairs", zeros.scalar())).withColumn("z", F.when(F.col("pairs") >= MIN_N, z))
    plain = (F.col("tie") == 0) & (F.col("pairs") == F.col("n")) | F.lit(method == "exact")
    exact = (F.col("n") <= tails.EXACT_PAIRS) & (F.col("pairs") >= MIN_N) & plain & (method != "large")
    g = materialize(g.withColumn("p_method", F.when(F.col("pairs") >= MIN_N, F.when(exact, "exact").otherwise("large"))), "rank_tests")
    g = _with_ties(g, t, group, F.col("p_method") == "exact")
    p = F.coalesce(tails.signed_rank_exact_p(F.when(F.col("p_method") == "exact", F.col("w_plus")), "ranks", "counts"), tails.normal_upper_p(F.col("z")))
    return g.withColumn("p", p).select(*group, "n", "w_plus", "z", "p", "p_method")


def count_enrichment(df: DataFrame, cluster: str, flag: str, with_p: bool = True) -> DataFrame:
    """2x2 counts of each cluster against all other rows, flagged versus not."""
    c = df.groupBy(cluster).agg(F.count_if(F.col(flag)).alias("a"), F.count_if(~F.col(flag)).alias("c"))
    tot = c.agg(F.struct(F.sum("a").alias("a"), F.sum("c").alias("c")).alias("t")).scalar()
    t = c.withColumn("t", tot).select(cluster, "a", (F.col("t.a") - F.col("a")).alias("b"), "c", (F.col("t.c") - F.col("c")).alias("d"))
    t = t.withColumn("odds_ratio", ratio(F.col("a") * F.col("d"), F.col("b") * F.col("c")))
    if not with_p:
        return t
    t = t.withColumn("p", tails.fisher_p(F.col("a").cast("double"), F.col("b").cast("double"), F.col("c").cast("double"), F.col("d").cast("double")))
    return bh_adjust(t, [], "p", "q")


def sign_share(df: DataFrame, group: Sequence[str], value: str, with_p: bool = True) -> DataFrame:
    g = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) > 0).alias("n_positive"))
    g = g.withColumn("share_positive", ratio(F.col("n_positive"), F.col("n")))
    return g.withColumn("p", tails.sign_p(F.col("n_positive").cast("double"), F.col("n").cast("double"))) if with_p else g


def null_summary(observed: DataFrame, null: DataFrame, keys: Sequence[str], obs: str, value: str, max_p: float = 0.05) -> DataFrame:
    """Empirical p = (1 + #null >= observed) / (N + 1) with the null's moments and gate."""
    j = null.where(F.col(value).isNotNull()).join(observed.select(*keys, F.col(obs).alias("observed")), list(keys))
    g = j.groupBy(*keys, "observed").agg(F.count(F.lit(1)).alias("n_null"), F.avg(value).alias("null_mean"), F.stddev_samp(value).alias("null_sd"),
                                         F.count_if(F.col(value) >= F.col("observed")).alias("ge"))
    q = quantiles(null, keys, value, {"null_p95": 0.95})
    p = (F.lit(1.0) + F.col("ge")) / (F.col("n_null") + 1)
    out = g.join(q, list(keys)).withColumn("empirical_p", p).withColumn("difference", F.col("observed") - F.col("null_mean"))
    gate = F.when((F.col("observed") > F.col("null_p95")) & (F.col("empirical_p") <= max_p), "PASS").otherwise("WARN")
    return out.withColumn("status", gate).drop("ge")


def adjusted_rand(df: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """Agreement of two labelings from their contingency counts."""
    def pairs(c: Column) -> Column:
        return c * (c - 1) / F.lit(2.0)

    cells = df.groupBy(*group, a, b).agg(F.count(F.lit(1)).alias("c"))
    j = cells.groupBy(*group).agg(F.sum(pairs(F.col("c"))).alias("s"), F.sum("c").alias("n"))
    for i, x in enumerate((a, b)):
        side = cells.groupBy(*group, x).agg(F.sum("c").alias("c")).groupBy(*group).agg(F.sum(pairs(F.col("c"))).alias(f"s_{i}"))
        j = j.join(side, list(group)) if group else j.withColumn(f"s_{i}", side.scalar())
    expected = F.try_divide(F.col("s_0") * F.col("s_1"), pairs(F.col("n")))
    top = (F.col("s_0") + F.col("s_1")) / 2
    return j.select(*group, "n", F.coalesce(F.try_divide(F.col("s") - expected, top - expected), F.lit(1.0)).alias("ari"))


def entity_concordance(df: DataFrame, entity: Sequence[str], a: str, b: str, min_n: int) -> DataFrame:
    """Spearman across shared features for each entity.

    An entity has one row for each feature, so its ranks are windows over it:
    all rows are shuffled once, by entity. ``df`` is a written table.
    """
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*entity, a, b)
    known = known.repartition(max(default_pieces(df), -(-df.count() // ROWS_PER_TASK)), *entity)

    def rank(c: str) -> Column:
        ties = F.count(F.lit(1)).over(Window.partitionBy(*entity, c))
        return F.rank().over(Window.partitionBy(*entity).orderBy(c)) + (ties - 1) / F.lit(2.0)

    ranked = known.withColumn("rank_a", rank(a)).withColumn("rank_b", rank(b))
    return ranked.groupBy(*entity).agg(F.count(F.lit(1)).alias("n"), correlation("rank_a", "rank_b", min_n).alias("rho"))


def concordance_summary(df: DataFrame, group: Sequence[str], rho: str, min_entities: int = 20, with_p: bool = True) -> DataFrame:
    s = sign_share(df, group, rho, with_p)
    out = s.join(quantiles(df, group, rho, {"median_rho": 0.5}), list(group))
    ok = (F.col("n") >= min_entities) & (F.col("median_rho") > 0)
    if with_p:
        ok = ok & (F.col("p") <= 0.05)
    return out.withColumn("status", F.when(ok, "PASS").otherwise("WARN"))


def head_to_head(df: DataFrame, obs: str, a: str, b: str) -> DataFrame:
    """Per cohort and feature: r, RMSE and MAE of two predictors and their differences."""
    ea, eb = F.col(obs) - F.col(a), F.col(obs) - F.col(b)
    x = df.withColumn("__ea", ea).withColumn("__eb", eb)
    return x.groupBy("cohort", "feature").agg(
        F.count(obs).alias("n"), correlation(obs, a).alias("a_pearson"), correlation(obs, b).alias("b_pearson"), correlation("__ea", "__eb").alias("residual_pearson"),
        F.sqrt(F.avg(ea * ea)).alias("a_rmse"), F.sqrt(F.avg(eb * eb)).alias("b_rmse"), F.avg(F.abs(ea)).alias("a_mae"), F.avg(F.abs(eb)).alias("b_mae"))


def head_to_head_summary(df: DataFrame, metrics: DataFrame, obs: str, a: str, b: str) -> DataFrame:
    """Cohort and pooled medians, win shares, paired deviates and residual correlation."""
    m = with_pooled(metrics, "cohort")
    wins = m.groupBy("cohort").agg(F.count(F.lit(1)).alias("features"), F.avg((F.col("b_pearson") > F.col("a_pearson")).cast("double")).alias("share_b_higher_pearson"),
                                   F.avg((F.col("b_rmse") < F.col("a_rmse")).cast("double")).alias("share_b_lower_rmse"))
    for c in ("a_pearson", "b_pearson", "a_rmse", "b_rmse"):
        wins = wins.join(quantiles(m, ["cohort"], c, {f"median_{c}": 0.5}), "cohort")
    paired = wilcoxon_greater(m, ["cohort"], "a_rmse", "b_rmse", with_p=False).select("cohort", F.col("w_plus").alias("rmse_w_plus"), F.col("z").alias("rmse_z"))
    flat = with_pooled(df.select("cohort", (F.col(obs) - F.col(a)).alias("ra"), (F.col(obs) - F.col(b)).alias("rb")), "cohort")
    corr = flat.groupBy("cohort").agg(correlation("ra", "rb").alias("residual_pearson"))
    return wins.join(paired, "cohort", "left").join(corr, "cohort")


def metric_associations(df: DataFrame, score: str, metrics: Sequence[str], with_p: bool = True) -> DataFrame:
    """Spearman of a score with each quality metric; large significant ones are flagged."""
    cells = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    long = df.select(F.col(score).cast("double").alias("score"), cells)
    out = spearman(long, ["metric"], "value", "score", "rho", MIN_TEST)
    out = out.withColumn("status", F.when(F.col("rho").isNull(), "SKIP").otherwise("PASS"))
    if not with_p:
        return out
    out = bh_adjust(materialize(out.withColumn("p", tails.correlation_p(F.col("rho"), F.col("n"))), "tests"), [], "p", "q")
    flag = F.coalesce((F.abs("rho") >= FLAG_RHO) & (F.col("q") <= FLAG_Q), F.lit(False))
    return out.withColumn("flag_large_correlation", flag).withColumn("status", F.when(flag, "WARN").otherwise(F.col("status")))


def meta_analysis(effects: DataFrame, keys: Sequence[str], with_p: bool = True) -> DataFrame:
    """Inverse-variance fixed and DerSimonian-Laird random effects per key."""
    e = effects.where((F.col("se") > 0) & F.col("coef").isNotNull()).withColumn("v", F.col("se") * F.col("se"))
    w = F.lit(1.0) / F.col("v")
    fixed = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("k_groups"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * F.col("coef")).alias("swy"))
    fixed = fixed.withColumn("fixed", F.col("swy") / F.col("sw"))
    het = (e.join(fixed, list(keys)).groupBy(*keys, "k_groups", "sw", "sw2", "fixed")
           .agg(F.sum(w * (F.col("coef") - F.col("fixed")) * (F.col("coef") - F.col("fixed"))).alias("q_het")))
    dof = F.col("k_groups") - 1
    c = F.col("sw") - F.col("sw2") / F.col("sw")
    het = het.withColumn("tau2", F.when(c > 0, F.greatest((F.col("q_het") - dof) / c, F.lit(0.0))).otherwise(F.lit(0.0)))
    het = het.withColumn("i2", F.when(F.col("q_het") > 0, F.greatest((F.col("q_het") - dof) / F.col("q_het"), F.lit(0.0)) * 100).otherwise(F.lit(0.0)))
    wr = F.lit(1.0) / (F.col("v") + F.col("tau2"))
    rnd = (e.join(het, list(keys)).groupBy(*keys, "k_groups", "sw", "fixed", "q_het", "tau2", "i2")
           .agg((F.sum(wr * F.col("coef")) / F.sum(wr)).alias("random"), F.sqrt(F.lit(1.0) / F.sum(wr)).alias("random_se")))
    methods = F.inline(F.array(F.struct(F.lit("fixed").alias("method"), F.col("fixed").alias("coef"), F.sqrt(F.lit(1.0) / F.col("sw")).alias("se")),
                               F.struct(F.lit("random").alias("method"), F.col("random").alias("coef"), F.col("random_se").alias("se"))))
    out = rnd.select(*keys, "k_groups", "q_het", "tau2", "i2", methods)
    out = (out.withColumn("z", F.try_divide("coef", "se")).withColumn("odds_ratio", F.exp("coef"))
           .withColumn("ci95_low", F.exp(F.col("coef") - CI_Z * F.col("se"))).withColumn("ci95_high", F.exp(F.col("coef") + CI_Z * F.col("se"))))
    if not with_p:
        return out
    return bh_adjust(materialize(out.withColumn("p", tails.normal_two_sided_p(F.col("z"))), "tests"), [keys[0]], "p", "q")


def baseline_delta(df: DataFrame, keys: Sequence[str], config: str, metric: str, baseline: str, max_drop: float = 0.05) -> DataFrame:
    """Metric minus the baseline configuration's, with a PASS/WARN rule."""
    base = df.where(F.col(config) == baseline).select(*keys, F.col(metric).alias("baseline"))
    out = df.join(base, list(keys), "left").withColumn("delta", F.col(metric) - F.col("baseline"))
    return out.withColumn("status", F.when(F.col("delta") >= -max_drop, "PASS").otherwise("WARN"))
