"""Cox proportional hazards by Newton steps over distributed risk sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions import tails
from cohortwise.functions.numeric import finite
from cohortwise.operators import newton as nt
from cohortwise.operators.ordering import PIECE, cut_points, default_pieces, range_piece
from cohortwise.operators.windows import bh_adjust
from cohortwise.session import materialize

# Penalty, event limits and confidence multiplier.
PENALTY, MIN_EVENTS, EVENTS_PER_TERM, CI_Z = 0.01, 10, 5, 1.96


def cox_fit(df: DataFrame, keys: Sequence[str], p: int, penalty: float = PENALTY, max_iter: int = 30, tol: float = 1e-8) -> DataFrame:
    """Efron partial likelihood with a ridge of ``n * penalty`` on standardised inputs.

    ``df`` holds ``(keys, time, event, x)``. Risk-set sums run over time ranges:
    within a range by a window, across ranges by their totals, so one hot group
    is spread over many tasks. Returns one row per group and predictor.
    """
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[a for j in range(p) for a in (
        F.avg(F.get("x", F.lit(j))).alias(f"m{j}"), F.stddev_samp(F.get("x", F.lit(j))).alias(f"s{j}"))])
    pieces = default_pieces(df)
    cuts = cut_points(df, F.col("time"), pieces)
    # An input that does not vary, as one that fills up a shorter model, keeps a zero coefficient.
    z = [F.coalesce(F.try_divide(F.get("x", F.lit(j)) - F.col(f"m{j}"), F.col(f"s{j}")), F.lit(0.0)).alias(f"z{j}") for j in range(p)]
    rows = materialize(df.join(stats, list(keys)).select(*keys, "time", F.col("event").cast("int").alias("event"), "n", *z, range_piece(F.col("time"), cuts, pieces).alias(PIECE)), "risk")
    keys = list(keys)
    pairs = [(a, b) for a in range(p) for b in range(a, p)]
    names = ["s0"] + [f"s1_{j}" for j in range(p)] + [f"s2_{a}_{b}" for a, b in pairs]

    def sums(points: DataFrame) -> DataFrame:
        j = rows.join(points, keys)
        eta = F.lit(0.0)
        for k in range(p):
            eta = eta + F.get("beta", F.lit(k)) * F.col(f"z{k}")
        e = F.exp(eta)
        terms = [e] + [e * F.col(f"z{k}") for k in range(p)] + [e * F.col(f"z{a}") * F.col(f"z{b}") for a, b in pairs]
        died = F.col("event") == 1
        at = j.groupBy(*keys, PIECE, "time").agg(
            F.first("beta").alias("beta"), F.count_if(died).alias("d"), *[F.sum(F.when(died, F.col(f"z{k}")).otherwise(0.0)).alias(f"zd_{k}") for k in range(p)],
            *[F.sum(t).alias(f"all_{n}") for t, n in zip(terms, names)], *[F.sum(F.when(died, t).otherwise(0.0)).alias(f"dead_{n}") for t, n in zip(terms, names)])
        back = Window.partitionBy(*keys, PIECE).orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
        later = Window.partitionBy(*keys).orderBy(F.col(PIECE).desc()).rowsBetween(Window.unboundedPreceding, -1)
        whole = at.groupBy(*keys, PIECE).agg(*[F.sum(f"all_{n}").alias(f"t_{n}") for n in names])
        whole = whole.select(*keys, PIECE, *[F.coalesce(F.sum(f"t_{n}").over(later), F.lit(0.0)).alias(f"o_{n}") for n in names])
        risk = at.select("*", *[F.sum(f"all_{n}").over(back).alias(f"in_{n}") for n in names]).where("d > 0").join(whole, [*keys, PIECE])
        # Tied events leave the risk set one fraction at a time.
        ev = risk.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("d").cast("int") - 1)))
        part = F.col("l") / F.col("d")
        r = {n: F.col(f"in_{n}") + F.col(f"o_{n}") - part * F.col(f"dead_{n}") for n in names}
        grads = [F.sum(F.col(f"zd_{k}") / F.col("d") - r[f"s1_{k}"] / r["s0"]) for k in range(p)]
        hess = [F.sum(r[f"s2_{a}_{b}"] / r["s0"] - r[f"s1_{a}"] * r[f"s1_{b}"] / (r["s0"] * r["s0"])) for a, b in pairs]
        # The events' own linear predictors enter once per time, shared over its tied steps.
        own = sum((F.get("beta", F.lit(k)) * F.col(f"zd_{k}") for k in range(p)), F.lit(0.0)) / F.col("d")
        return ev.groupBy(*keys).agg(F.sum(own - F.log(r["s0"])).alias("ll"), F.array(*grads).alias("g"), F.array(*hess).alias("h"))

    start = rows.groupBy(*keys).agg(F.array(*[F.lit(0.0)] * p).alias("beta"), F.max("n").alias("n"))
    beta = nt.iterate(start, keys, sums, lambda row, size: np.full(size, row.n * penalty), max_iter, tol, 1e-6)
    long = beta.join(stats.drop("n"), list(keys)).select(*keys, "converged", F.posexplode("beta").alias("term", "b"), "se", F.array(*[F.col(f"s{j}") for j in range(p)]).alias("sd"))
    coef, se = F.try_divide("b", F.get("sd", F.col("term"))), F.try_divide(F.get("se", F.col("term")), F.get("sd", F.col("term")))
    return long.select(*keys, "term", coef.alias("coef"), se.alias("se"), F.try_divide(coef, se).alias("z"), F.exp(coef).alias("hazard_ratio"),
                       F.exp(coef - CI_Z * se).alias("ci95_low"), F.exp(coef + CI_Z * se).alias("ci95_high"), "converged")


def model_rows(df: DataFrame, specs: dict[str, Sequence[str]], p: int) -> DataFrame:
    """(cohort, model, entity, time, event, x, used): a row per entity and model with complete values, inputs filled up with zeros to ``p``.

    ``used`` names the predictors of the model that vary among the complete rows of its cohort; the others are left out of ``x``.
    """
    models = F.inline(F.array(*[F.struct(F.lit(name).alias("model"), F.array(*[F.lit(c) for c in cols]).alias("names"), F.array(*[finite(F.col(c)) for c in cols]).alias("raw")) for name, cols in specs.items()]))
    rows = df.select("cohort", "entity", finite(F.col("time")).alias("time"), finite(F.col("event")).alias("event"), models)
    rows = materialize(rows.where(F.col("time").isNotNull() & F.col("event").isNotNull() & ~F.exists("raw", lambda v: v.isNull())), "model_rows")
    keys = ["cohort", "model"]
    vary = (rows.select(*keys, "names", F.posexplode("raw").alias("pos", "v")).groupBy(*keys, "pos").agg(F.max("v").alias("hi"), F.min("v").alias("lo"), F.first("names").alias("names"))
            .groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("hi") > F.col("lo"), F.col("pos")))).alias("use"), F.first("names").alias("names")))
    j = rows.drop("names").join(vary, keys)
    padded = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.coalesce(F.get("raw", F.get("use", i)), F.lit(0.0)))
    return j.select(*keys, "entity", "time", "event", padded.alias("x"), F.transform("use", lambda i: F.get("names", i)).alias("used"))


def cox_models(df: DataFrame, specs: dict[str, Sequence[str]], penalty: float = PENALTY) -> DataFrame:
    """Every model of ``specs`` in every cohort, a row per term with p, and q over all tested terms.

    ``df`` holds (cohort, entity, time, event) and the predictors. Rows that lack
    a value of a model are left out of it, predictors that do not vary too. A
    model of a cohort is skipped (one row, no term) without rows or predictors
    left or with fewer than 10 events or 5 a predictor; WARN says that the fit
    did not converge.
    """
    p, keys = max(len(c) for c in specs.values()), ["cohort", "model"]
    rows = materialize(model_rows(df, specs, p), "model_rows")
    names = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(",".join(c)).alias("predictors")) for m, c in specs.items()]))
    wanted = df.select("cohort").distinct().select("cohort", names)
    info = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("event").cast("bigint").alias("events"), F.first("used").alias("used"))
    info = wanted.join(info, keys, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "events": F.coalesce("events", F.lit(0)), "used": F.coalesce("used", F.array().cast("array<string>"))})
    enough = (F.size("used") > 0) & (F.col("events") >= F.greatest(F.lit(MIN_EVENTS), EVENTS_PER_TERM * F.size("used")))
    info = materialize(info.withColumn("go", enough), "eligible")
    fit = cox_fit(materialize(rows.drop("used").join(info.where("go").select(*keys), keys, "left_semi"), "go"), keys, p, penalty)
    out = info.join(fit, keys, "left").where(~F.col("go") | (F.col("term") < F.size("used")))
    status = F.when(~F.col("go"), "SKIP").when(F.col("converged"), "PASS").otherwise("WARN")
    out = out.select(*keys, "predictors", F.array_join("used", ",").alias("used_predictors"), status.alias("status"),
                     F.when(~F.col("go"), "insufficient_records_events_or_variation").otherwise("").alias("skip_reason"), "n", "events",
                     F.when(F.col("go"), F.get("used", F.col("term"))).otherwise("").alias("term"), "coef", "se", "z", tails.normal_two_sided_p(F.col("z")).alias("p"), "hazard_ratio", "ci95_low", "ci95_high")
    return bh_adjust(materialize(out, "cox_terms"), [], "p", "q")
