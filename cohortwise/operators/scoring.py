"""Feature-set scores on long standardised matrices.

Sets, weights and edges are joined on the feature; adaptive execution
broadcasts them from their measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.text import feature_accession, feature_sites
from cohortwise.operators.ordering import default_pieces, medians, quantiles
from cohortwise.operators.selection import best_row, top_per_group
from cohortwise.operators.windows import written_zscore, zscore_sample
from cohortwise.session import materialize

KEYS = ["cohort", "entity"]
# Overlap limits, signature size, significance and relevance cuts.
MIN_OVERLAP = 5
# Rows of a site matrix that a task gives their site keys.
ROWS_PER_TASK = 500_000
SIGNATURE_SIZE = 300
ALPHA, MAX_Q, MIN_ABS_R = 0.05, 0.10, 0.15
CUTOFFS = {"top25": 0.75, "top33": 2.0 / 3.0, "top40": 0.60}


def standardised(df: DataFrame) -> DataFrame:
    """Upper-cased names, duplicates averaged, z-scored within the cohort.

    The rows of an entity are written side by side, so that sums by entity are
    small before their shuffle.
    """
    merged = df.repartition(*KEYS).groupBy(*KEYS, F.upper("feature").alias("feature")).agg(F.avg("value").alias("value"))
    return written_zscore(merged, ["cohort", "feature"], "value").select(*KEYS, "feature", "z")


def _usable(z: DataFrame, sets: DataFrame, min_overlap: int, order: str = "weight") -> DataFrame:
    present = z.select("feature").distinct()
    rows = sets.withColumn("feature", F.upper("feature")).join(present, "feature", "left_semi")
    rows = best_row(rows, ["set_name", "feature"], [F.col(order), F.col("weight")]).select("set_name", "feature", "weight") if "weight" in rows.columns else rows.select("set_name", "feature").distinct()
    big = rows.groupBy("set_name").agg(F.count(F.lit(1)).alias("features_used")).where(F.col("features_used") >= min_overlap)
    # Written, so that its size is known before the join: the long rows are not shuffled to meet a few sets.
    return materialize(rows.join(big, "set_name"), "usable_sets")


def set_scores(z: DataFrame, sets: DataFrame, min_overlap: int = MIN_OVERLAP, prefix: str = "") -> DataFrame:
    """Mean z over the overlap of each large enough set."""
    use = _usable(z, sets.select("set_name", "feature"), min_overlap)
    return (z.join(use, "feature").groupBy(*KEYS, F.concat(F.lit(prefix), "set_name").alias("score"), "features_used")
            .agg(F.avg("z").alias("value")))


def weighted_scores(z: DataFrame, net: DataFrame, min_overlap: int = MIN_OVERLAP, prefix: str = "", order: str = "weight") -> DataFrame:
    """sum(z w) / sum|w| over the targets present; zero-weight sets are skipped.

    Of a target that a set repeats, the row that is first by ``order`` counts;
    a table of edges that came from a file has its line number there.
    """
    use = _usable(z, net.select(*dict.fromkeys(["set_name", "feature", "weight", order])), min_overlap, order)
    total = use.groupBy("set_name").agg(F.sum(F.abs("weight")).alias("norm")).where("norm > 0")
    return (z.join(materialize(use.join(total, "set_name"), "usable_sets"), "feature")
            .groupBy(*KEYS, F.concat(F.lit(prefix), "set_name").alias("score"), "features_used")
            .agg((F.sum(F.col("z") * F.col("weight")) / F.max("norm")).alias("value")))


def composed_scores(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def site_map(features: DataFrame, mapping: DataFrame) -> DataFrame:
    """Feature to site keys; features without site or accession keep an empty key."""
    ids = features.select("feature").distinct().select("feature", feature_accession(F.col("feature")).alias("accession"), feature_sites(F.col("feature")).alias("sites"))
    acc = mapping.where("status = 'mapped'").select("accession", F.explode(F.array("target", "canonical")).alias("target")).where("target <> ''").distinct()
    rows = ids.withColumn("site", F.explode_outer("sites")).join(acc, "accession", "left")
    key = F.when(F.col("site").isNotNull() & F.col("target").isNotNull(), F.concat("target", F.lit(";"), "site", F.lit("-p"))).otherwise("")
    return rows.select("feature", "accession", "site", "target", key.alias("site_key"))


def site_matrix(df: DataFrame, smap: DataFrame) -> DataFrame:
    """Mean value per site key, z-scored within the cohort.

    Rows meet by entity before they get their site keys, of which there are
    several a row, so the keyed rows are not shuffled. ``df`` is a written table.
    """
    hits = materialize(smap.where("site_key <> ''").select("feature", "site_key"), "site_keys")
    parts = max(default_pieces(df), -(-df.count() // ROWS_PER_TASK))
    rows = df.repartition(parts, *KEYS).join(hits, "feature")
    merged = rows.groupBy(*KEYS, F.col("site_key").alias("feature")).agg(F.avg("value").alias("value"))
    return written_zscore(merged, ["cohort", "feature"], "value").select(*KEYS, "feature", "z")


def substrate_scores(z: DataFrame, edges: DataFrame, min_sites: int) -> DataFrame:
    """Mean z over the distinct sites of each source, z-scored again."""
    species = (F.lower("source_organism") == "human") & (F.lower("target_organism") == "human")
    site = F.upper("site")
    ok = edges.where(species & site.rlike("^[A-Z][0-9]+"))
    acc = F.explode(F.array_distinct(F.array("accession", F.split_part("accession", F.lit("-"), F.lit(1)))))
    keyed = ok.select(F.col("source").alias("set_name"), site.alias("s"), acc.alias("a")).select("set_name", F.concat("a", F.lit(";"), "s", F.lit("-p")).alias("feature")).distinct()
    present = z.select("feature").distinct()
    use = keyed.join(present, "feature", "left_semi")
    big = use.groupBy("set_name").agg(F.count(F.lit(1)).alias("features_used")).where(F.col("features_used") >= min_sites)
    raw = z.join(materialize(use.join(big, "set_name"), "usable_sets"), "feature").groupBy(*KEYS, F.col("set_name").alias("score"), "features_used").agg(F.avg("z").alias("value"))
    return written_zscore(raw, ["cohort", "score"], "value", "z").select(*KEYS, "score", "features_used", F.col("z").alias("value"))


def signed_scores(z: DataFrame, members: DataFrame, min_sites: int) -> DataFrame:
    """mean(up) - mean(down), halved when both sides exist, z-scored again.

    ``members`` hold ``acc;site;direction`` texts per set.
    """
    p = F.split("member", ";")
    rows = members.where(F.size(p) >= 3).select("set_name", F.concat(p[0], F.lit(";"), p[1]).alias("feature"), F.lower(F.substring(p[2], 1, 1)).alias("d"))
    rows = rows.where(F.col("d").isin("u", "d")).distinct().join(z.select("feature").distinct(), "feature", "left_semi")
    big = (rows.groupBy("set_name").agg(F.count_distinct("feature").alias("features_used"), F.count_if(F.col("d") == "u").alias("n_up"), F.count_if(F.col("d") == "d").alias("n_down"))
           .where(F.col("features_used") >= min_sites))
    g = z.join(materialize(rows.join(big, "set_name"), "usable_sets"), "feature").groupBy(*KEYS, F.col("set_name").alias("score"), "features_used", "n_up", "n_down").agg(
        F.avg(F.when(F.col("d") == "u", F.col("z"))).alias("up"), F.avg(F.when(F.col("d") == "d", F.col("z"))).alias("down"))
    both = (F.col("n_up") > 0) & (F.col("n_down") > 0)
    raw = (F.coalesce("up", F.lit(0.0)) - F.coalesce("down", F.lit(0.0))) / F.when(both, 2.0).otherwise(1.0)
    return (written_zscore(g.withColumn("value", raw), ["cohort", "score"], "value", "z")
            .select(*KEYS, "score", "features_used", "n_up", "n_down", F.col("z").alias("value")))


def mapped_matrix(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mean per mapped name; features without a name are dropped."""
    named = df.withColumn("accession", feature_accession(F.col("feature"))).drop("feature")
    m = mapping.select("accession", "symbol").where("symbol <> ''").distinct()
    return named.join(m, "accession").groupBy(*KEYS, F.col("symbol").alias("feature")).agg(F.avg("value").alias("value"))


def loading_projection(df: DataFrame, loadings: DataFrame, target_set: str, plus: str, minus: str) -> DataFrame:
    """Weighted sums of two factors' positive loadings, each z-scored, and their difference.

    Weights are renormalised over the features present in the new matrix.
    """
    w = loadings.where((F.col("target_set") == target_set) & (F.col("direction") == "positive") & (F.col("loading") > 0) & F.col("factor").isin(plus, minus))
    w = w.join(df.select("feature").distinct(), "feature", "left_semi")
    totals = w.groupBy("factor").agg(F.sum("loading").alias("total"))
    w = w.join(totals, "factor").select("factor", "feature", (F.col("loading") / F.col("total")).alias("w"))
    raw = df.join(w, "feature").groupBy(*KEYS, "factor").agg(F.sum(F.col("value") * F.col("w")).alias("raw"))
    z = zscore_sample(raw, ["cohort", "factor"], "raw")
    diff = z.groupBy(*KEYS).agg((F.sum(F.when(F.col("factor") == plus, F.col("z"))) - F.coalesce(F.sum(F.when(F.col("factor") == minus, F.col("z"))), F.lit(0.0))).alias("proxy"))
    return zscore_sample(diff, ["cohort"], "proxy", "proxy_z")


def contrast_signature(df: DataFrame, label: str, size: int = SIGNATURE_SIZE) -> DataFrame:
    """Unit-norm weights per cohort: case minus control mean z of the strongest features."""
    stats = df.where(F.col(label).isNotNull()).groupBy("cohort", "feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"),
                                                                              F.avg(F.when(F.col(label) == 1, F.col("value"))).alias("a"),
                                                                              F.avg(F.when(F.col(label) == 0, F.col("value"))).alias("b"))
    w = stats.where("s > 0").withColumn("w", (F.col("a") - F.col("b")) / F.col("s")).where("w IS NOT NULL")
    top = top_per_group(w, ["cohort"], [F.abs("w").desc(), F.col("feature")], size, None)
    norm = top.groupBy("cohort").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scale = F.when(F.col("norm") > 1e-12, F.col("norm")).otherwise(F.lit(1.0))
    return top.join(norm, "cohort").select("cohort", "feature", "m", "s", (F.col("w") / scale).alias("w"))


def signature_scores(df: DataFrame, label: str, size: int = SIGNATURE_SIZE, threshold: float = 0.75) -> DataFrame:
    """Score labelled and unlabelled rows with the training mean, sd and cut."""
    sig = contrast_signature(df, label, size)
    raw = (df.join(sig, ["cohort", "feature"]).groupBy(*KEYS, label)
           .agg(F.sum(F.coalesce((F.col("value") - F.col("m")) / F.col("s") * F.col("w"), F.lit(0.0))).alias("raw")))
    train = raw.where(F.col(label).isNotNull())
    stats = train.groupBy("cohort").agg(F.avg("raw").alias("m"), F.stddev_samp("raw").alias("s"))
    sd = F.when(F.col("s") > 1e-12, F.col("s")).otherwise(F.lit(1.0))
    # Written once: the cut-off is compared with the very numbers it was taken from.
    z = materialize(raw.join(stats, "cohort").select(*KEYS, label, ((F.col("raw") - F.col("m")) / sd).alias("score_z")), "signature")
    cut = quantiles(z.where(F.col(label).isNotNull()), ["cohort"], "score_z", {"cutoff": threshold})
    return z.join(cut, "cohort").withColumn("high", F.col("score_z") >= F.col("cutoff"))


def burden_scores(df: DataFrame, block: Column, adverse: DataFrame | None = None) -> DataFrame:
    """Mean positive part and mean absolute value, overall and per block.

    ``adverse`` lists features whose plain mean is reported as well.
    """
    pos, mag = F.greatest(F.col("value"), F.lit(0.0)), F.abs("value")
    rows = df.withColumn("block", F.explode(F.array(block, F.lit("all"))))
    out = rows.groupBy(*KEYS, "block").agg(F.avg(pos).alias("positive_burden"), F.avg(mag).alias("absolute_burden"))
    if adverse is None:
        return out
    feats = adverse.select("feature").distinct()
    n = feats.count()
    bad = df.join(feats, "feature", "left_semi").groupBy(*KEYS).agg(F.avg("value").alias("adverse_score"))
    return out.join(bad, KEYS, "left").withColumn("adverse_status", F.lit(f"{n}_features" if n else "no_adverse_features"))


def direction_table(tests: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Per factor: mean r over cohorts, significance flags and its direction.

    Significant factors win; the sign of the mean r decides when there is none.
    """
    pos, neg, sig = F.col("r") > 0, F.col("r") < 0, F.col("p") < alpha
    g = tests.groupBy("factor").agg(F.avg("r").alias("mean_r"), F.count("r").alias("n_cohorts"), F.min("p").alias("min_p"),
                                    F.coalesce(F.bool_or(pos & sig), F.lit(False)).alias("strict_adverse"),
                                    F.coalesce(F.bool_or(neg & sig), F.lit(False)).alias("strict_protective"))
    any_ = g.agg(F.struct(F.bool_or("strict_adverse").alias("adverse"), F.bool_or("strict_protective").alias("protective")).alias("a")).scalar()
    j = g.withColumn("a", any_).select("*", F.col("a.adverse").alias("any_adverse"), F.col("a.protective").alias("any_protective"))
    adverse = F.when(F.col("any_adverse"), F.col("strict_adverse")).otherwise(F.col("mean_r") > 0)
    protective = F.when(F.col("any_protective"), F.col("strict_protective")).otherwise(F.col("mean_r") < 0)
    return j.select("factor", "mean_r", "n_cohorts", "min_p", "strict_adverse", "strict_protective", adverse.alias("adverse"), protective.alias("protective"))


def gated_risk(scores: DataFrame, directions: DataFrame) -> DataFrame:
    """Mean z of adverse minus mean z of protective factors, z-scored in the cohort."""
    z = zscore_sample(scores, ["cohort", "factor"], "value").join(directions.select("factor", "adverse", "protective"), "factor")
    risk = z.groupBy(*KEYS).agg((F.avg(F.when(F.col("adverse"), F.col("z"))) - F.coalesce(F.avg(F.when(F.col("protective"), F.col("z"))), F.lit(0.0))).alias("risk"))
    return zscore_sample(risk, ["cohort"], "risk", "risk_z")


def quadrant_groups(df: DataFrame, cutoffs: dict[str, float] = CUTOFFS) -> DataFrame:
    """Risk median by residual quantile, one row per entity and cut-off."""
    med = medians(df, ["cohort"], "risk", "risk_cut")
    cuts = quantiles(df, ["cohort"], "residual", {f"q_{k}": v for k, v in cutoffs.items()})
    options = F.explode(F.array(*[F.struct(F.lit(k).alias("cutoff"), F.col(f"q_{k}").alias("q")) for k in cutoffs]))
    x = df.join(med, "cohort", "left").join(cuts, "cohort", "left").select(*df.columns, "risk_cut", options.alias("c"))
    low = F.col("risk") <= F.col("risk_cut")
    hi = F.col("residual") > F.col("c.q")
    label = (F.when(low.isNull() | hi.isNull(), "unassigned").when(low & ~hi, "low_low").when(low & hi, "low_high")
             .when(~low & ~hi, "high_low").otherwise("high_high"))
    return x.select(*df.columns, F.col("c.cutoff").alias("cutoff"), label.alias("quadrant"))


def candidate_classes(df: DataFrame) -> DataFrame:
    """Predictability (r > 0 and at least the group median) by relevance (q and |r|)."""
    med = medians(df, ["cohort", "target_set"], "pearson", "group_median")
    high = (F.col("pearson") > 0) & (F.col("pearson") >= F.col("group_median"))
    relevant = F.coalesce((F.col("q") <= MAX_Q) & (F.abs("r") >= MIN_ABS_R), F.lit(False))
    label = F.when(relevant & ~F.coalesce(high, F.lit(False)), "blind_spot").when(relevant & high, "visible").otherwise("silent")
    return df.join(med, ["cohort", "target_set"], "left").withColumn("candidate_class", label)



def ranked_entities(scores: DataFrame, keys: Sequence[str] = ("cohort", "score"), k: int = 25) -> DataFrame:
    return top_per_group(scores, list(keys), [F.col("value").desc(), F.col("entity")], k)
