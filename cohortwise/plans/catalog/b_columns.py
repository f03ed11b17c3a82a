"""Column expressions: cleaning, labels, nested values, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions import numeric as num
from cohortwise.functions import text as tx
from cohortwise.operators import eligibility
from cohortwise.plans.registry import query, r
from cohortwise.plans.views import table, view

_MISS = "('', 'nan', 'none', 'null', 'not reported', 'unknown', 'not available', 'not applicable')"


def _nm(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN {_MISS} THEN NULL ELSE trim({c}) END"


@query("b1_norm_missing", f"SELECT case_id, {_nm('stage')} AS stage, {_nm('n_stage')} AS n_stage, {_nm('raw_value')} AS raw_value FROM v11", "v11")
def b1(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v11").select("case_id", *[tx.norm_missing(F.col(c)).alias(c) for c in ("stage", "n_stage", "raw_value")])


@query("b2_clean_text", f"SELECT case_id, coalesce({_nm('stage')}, 'Not Reported') AS stage, coalesce({_nm('sex')}, 'Not Reported') AS sex FROM v11", "v11")
def b2(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v11").select("case_id", tx.clean_text(F.col("stage")).alias("stage"), tx.clean_text(F.col("sex")).alias("sex"))


_SAMPLE = """CASE WHEN lower(coalesce(sample_type,'')) LIKE '%primary%' AND lower(coalesce(sample_type,'')) LIKE '%tumor%' THEN 'Primary Tumor'
  WHEN lower(coalesce(sample_type,'')) LIKE '%normal%' THEN 'Solid Tissue Normal'
  WHEN lower(trim(coalesce(sample_type,''))) IN ('', 'nan', 'none', 'not reported', 'unknown') THEN 'Not Reported'
  ELSE trim(sample_type) END"""


@query("b3_sample_type", f"SELECT case_id, {_SAMPLE} AS label FROM v11", "v11")
def b3(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v11").select("case_id", tx.sample_type(F.col("sample_type")).alias("label"))


_SIGNALS = f"""SELECT case_id,
  CASE WHEN regexp_matches(trim(replace(upper({_nm('stage')}), 'STAGE', '')), '^(III|IV)') THEN 1
       WHEN regexp_matches(trim(replace(upper({_nm('stage')}), 'STAGE', '')), '^[0I]') THEN 0 END AS stage_flag,
  CASE WHEN upper({_nm('n_stage')}) LIKE 'N0%' THEN 0 WHEN regexp_matches(upper({_nm('n_stage')}), '^N.*[1-9]') THEN 1 END AS n_flag,
  CASE WHEN upper({_nm('m_stage')}) LIKE 'M0%' THEN 0 WHEN upper({_nm('m_stage')}) LIKE 'M1%' THEN 1 END AS m_flag FROM v11"""


@query("b4_tri_state_staging", _SIGNALS, "v11")
def b4(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v11").select(
        "case_id", tx.stage_advanced(F.col("stage")).cast("int").alias("stage_flag"),
        tx.node_positive(F.col("n_stage")).cast("int").alias("n_flag"), tx.metastasis_positive(F.col("m_stage")).cast("int").alias("m_flag"))


@query("b5_endpoint_from_signals", f"""WITH s AS ({_SIGNALS})
SELECT case_id, CASE WHEN stage_flag IS NULL AND n_flag IS NULL AND m_flag IS NULL THEN NULL
  WHEN greatest(coalesce(stage_flag,0), coalesce(n_flag,0), coalesce(m_flag,0)) = 1 THEN '1' ELSE '0' END AS endpoint,
  CASE WHEN stage_flag IS NULL AND n_flag IS NULL AND m_flag IS NULL THEN 'missing_signals' ELSE 'stage or node or metastasis' END AS endpoint_source FROM s""", "v11")
def b5(spark: SparkSession, sf: str) -> DataFrame:
    hit = tx.any_known(tx.stage_advanced(F.col("stage")), tx.node_positive(F.col("n_stage")), tx.metastasis_positive(F.col("m_stage")))
    return view(spark, sf, "v11").select(
        "case_id", hit.cast("int").cast("string").alias("endpoint"),
        F.when(hit.isNull(), "missing_signals").otherwise("stage or node or metastasis").alias("endpoint_source"))


@query("b6_numeric_coercion", "SELECT case_id, CASE WHEN isfinite(TRY_CAST(raw_value AS DOUBLE)) THEN TRY_CAST(raw_value AS DOUBLE) END AS value FROM v11", "v11")
def b6(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v11").select("case_id", num.to_number(F.col("raw_value")).alias("value"))


@query("b7_normalize_table", """
SELECT case_id, coalesce(CASE WHEN sex IS NOT NULL THEN sex = 'Male' END, false) AS flag,
  CAST(coalesce(trunc(CASE WHEN isfinite(TRY_CAST(raw_value AS DOUBLE)) THEN TRY_CAST(raw_value AS DOUBLE) END), 0) AS BIGINT) AS amount,
  coalesce(stage, '') AS stage, coalesce(n_stage, '') AS n_stage FROM v11""", "v11")
def b7(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v11").select("case_id", (F.col("sex") == "Male").alias("flag"), F.col("raw_value").alias("amount"), "stage", "n_stage")
    return eligibility.typed_table(v, booleans=["flag"], integers=["amount"], keep=["case_id"])


_FID = "'NP_' || CAST(l_partkey AS VARCHAR) || '.1:s' || CAST(l_orderkey % 100 AS VARCHAR) || 't' || CAST(l_linenumber AS VARCHAR)"


@query("b8_feature_sites", """SELECT DISTINCT 'NP_' || CAST(l_partkey AS VARCHAR) || '.1' AS accession,
  unnest(['S' || CAST(l_orderkey % 100 AS VARCHAR), 'T' || CAST(l_linenumber AS VARCHAR)]) AS site, l_orderkey, l_linenumber FROM lineitem""")
def b8(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    fid = F.concat(F.lit("NP_"), F.col("l_partkey").cast("string"), F.lit(".1:s"), (F.col("l_orderkey") % 100).cast("string"), F.lit("t"), F.col("l_linenumber").cast("string"))
    ids = li.select("l_orderkey", "l_linenumber", fid.alias("f"))
    return ids.select(tx.feature_accession(F.col("f")).alias("accession"), F.explode(tx.feature_sites(F.col("f"))).alias("site"), "l_orderkey", "l_linenumber").distinct()


@query("b9_split_feature_name", """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.04 THEN 'positive' ELSE 'negative' END AS direction,
  l_returnflag AS target_set, CAST(l_partkey AS VARCHAR) || '__x' AS feature FROM lineitem""")
def b9(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    name = F.concat_ws("__", F.when(F.col("l_tax") > 0.04, "pos").otherwise("neg"), "l_returnflag", F.col("l_partkey").cast("string"), F.lit("x"))
    return li.select("l_orderkey", "l_linenumber", *tx.split_feature(name))


@query("b10_safe_component", """SELECT page_id, left(regexp_replace(CASE WHEN trim(url) = '' THEN 'unknown' ELSE trim(url) END, '[^\\p{L}\\p{N}_.\\-]', '_', 'g'), 160) AS name FROM pages""")
def b10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.safe_component(F.col("url")).alias("name"))


@query("b11_bag_key", "SELECT page_id, left(sha1(url), 16) AS bag_key FROM pages")
def b11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.bag_key(F.col("url")).alias("bag_key"))


@query("b12_first_usable_value", f"""
SELECT case_id, coalesce({_nm('stage')}, {_nm('n_stage')}, {_nm('sex')}, {_nm('recurrence')}) AS value FROM v11""", "v11")
def b12(spark: SparkSession, sf: str) -> DataFrame:
    items = F.array(F.struct(F.col("stage").alias("a"), F.col("n_stage").alias("b")), F.struct(F.col("sex").alias("a"), F.col("recurrence").alias("b")))
    return view(spark, sf, "v11").select("case_id", tx.first_usable(items, ["a", "b"]).alias("value"))


@query("b13_max_numeric", """
SELECT case_id, greatest(CASE WHEN isfinite(TRY_CAST(raw_value AS DOUBLE)) THEN TRY_CAST(raw_value AS DOUBLE) END, CAST(case_id AS DOUBLE)) AS value FROM v11""", "v11")
def b13(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v11").select("case_id", tx.max_numeric(F.array(F.col("raw_value"), F.col("case_id").cast("string"), F.col("stage"))).alias("value"))


_V7 = """
WITH t AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts,
  min(CASE WHEN event_type = 'purchase' AND value > 100 THEN ts END) AS hit_ts FROM events GROUP BY user_id)"""


@query("b14_survival_derivation", _V7 + """
SELECT user_id AS entity, CASE WHEN hit_ts IS NOT NULL THEN 1 ELSE 0 END AS event,
  round((epoch_us(coalesce(hit_ts, last_ts)) - epoch_us(first_ts)) / 86400e6 / 365.25e0, 6) AS years FROM t""")
def b14(spark: SparkSession, sf: str) -> DataFrame:
    from cohortwise.plans.derived import survival

    s = survival(spark, sf)
    return s.select("entity", "event", F.round(F.col("days") / F.lit(365.25), 6).alias("years"))


@query("b15_log_transforms", f"SELECT l_orderkey, l_linenumber, l_partkey, {r('log2(l_quantity + 1)')} AS log2p1, {r('ln(1 + l_extendedprice)')} AS log1p FROM lineitem")
def b15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", num.rounded(num.log2p1(F.col("l_quantity"))).alias("log2p1"),
                                               num.rounded(F.log1p("l_extendedprice")).alias("log1p"))


@query("b16_sign_split", """SELECT entity, 'pos__' || cohort AS feature, greatest(value, 0e0) AS value FROM v1
UNION ALL SELECT entity, 'neg__' || cohort, greatest(-value, 0e0) FROM v1""", "v1")
def b16(spark: SparkSession, sf: str) -> DataFrame:
    from cohortwise.operators.factors import split_signs

    return split_signs(view(spark, sf, "v1").select("entity", F.col("cohort").alias("feature"), "value"))


@query("b17_manifest_flags", """SELECT p_partkey, lower(p_name) LIKE '%red%' AS is_primary, lower(p_type) LIKE '%promo%' OR lower(p_name) LIKE '%bolt%' AS is_diagnostic FROM part""")
def b17(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", tx.contains_flag((F.col("p_name"), "Red")).alias("is_primary"),
                                           tx.contains_flag((F.col("p_type"), "Promo"), (F.col("p_name"), "Bolt")).alias("is_diagnostic"))


@query("b18_comma_list_explode", """SELECT o_orderkey, unnest([CAST(o_custkey AS VARCHAR), o_orderstatus]) AS id FROM orders""")
def b18(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.concat(F.col("o_custkey").cast("string"), F.lit(",,"), F.col("o_orderstatus"), F.lit(","))
    return table(spark, sf, "orders").select("o_orderkey", F.explode(tx.comma_items(cell)).alias("id"))


@query("b19_clinical_encoders", f"""
SELECT case_id, CASE lower(sex) WHEN 'male' THEN 1e0 WHEN 'female' THEN 0e0 END AS sex_male,
  CASE WHEN lower(sex) = 'male' THEN 1e0 ELSE 0e0 END AS sex_male_filled, CASE WHEN lower(recurrence) = 'yes' THEN 1e0 END AS recurred,
  {r("(price - avg(price) OVER w) / CASE WHEN stddev_samp(price) OVER w > 1e-8 THEN stddev_samp(price) OVER w ELSE 1 END")} AS age_z
FROM v11 WINDOW w AS (PARTITION BY cohort)""", "v11")
def b19(spark: SparkSession, sf: str) -> DataFrame:
    from cohortwise.operators.windows import zscore_sample

    z = zscore_sample(view(spark, sf, "v11"), ["cohort"], "price", "age_z")
    return z.select("case_id", tx.sex_male(F.col("sex")).alias("sex_male"), tx.sex_male(F.col("sex"), True).alias("sex_male_filled"),
                    tx.recurrence_yes(F.col("recurrence")).alias("recurred"), num.rounded(F.col("age_z")).alias("age_z"))


@query("b20_safe_logit", f"""SELECT l_orderkey, l_linenumber, l_partkey,
  {r("ln(least(greatest(l_discount * 10, 1e-6), 1 - 1e-6) / (1 - least(greatest(l_discount * 10, 1e-6), 1 - 1e-6)))")} AS logit FROM lineitem""")
def b20(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", num.rounded(num.logit(F.col("l_discount") * 10)).alias("logit"))


@query("b21_item_quality_gate", """SELECT cohort, CASE WHEN occupancy < 0.70 OR quantity / 50 > 0.75 OR line < 3 THEN 'WARN' ELSE 'PASS' END AS status,
  count(*) AS n_items FROM v4 GROUP BY 1, 2""", "v4")
def b21(spark: SparkSession, sf: str) -> DataFrame:
    gate = tx.quality_gate(F.col("occupancy"), F.col("quantity") / 50, F.col("line"))
    return view(spark, sf, "v4").withColumn("status", gate).groupBy("cohort", "status").agg(F.count(F.lit(1)).alias("n_items"))


@query("b22_foreground_mask", """SELECT item, count(*) AS n_points, sum(CASE WHEN (r+g+b)/3e0 < 235 AND (greatest(r,g,b)-least(r,g,b) > 8 OR (r+g+b)/3e0 < 220) THEN 1 ELSE 0 END)::BIGINT AS n_foreground
FROM v10 GROUP BY item""", "v10")
def b22(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v10").groupBy("item").agg(F.count(F.lit(1)).alias("n_points"), F.count_if(tx.foreground(F.col("r"), F.col("g"), F.col("b"))).alias("n_foreground"))


@query("b23_guarded_fraction", f"""SELECT o_orderkey, {r("l.a / nullif(CAST(l.b AS DOUBLE), 0)")} AS fraction
FROM (SELECT l_orderkey AS o_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS b FROM lineitem GROUP BY 1) l""")
def b23(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_linestatus") == "F").alias("b"))
    return g.select("o_orderkey", num.rounded(num.ratio(F.col("a"), F.col("b"))).alias("fraction"))


@query("b24_box_and_polygon_area", f"""SELECT item, type_id, bag, {r('box_w * box_h')} AS box_area, {r('box_w * box_h / 2')} AS triangle_area FROM v9""", "v9")
def b24(spark: SparkSession, sf: str) -> DataFrame:
    z, w, h = F.lit(0.0), F.col("box_w"), F.col("box_h")
    tri = F.array(F.struct(z.alias("x"), z.alias("y")), F.struct(w.alias("x"), z.alias("y")), F.struct(w.alias("x"), h.alias("y")))
    return view(spark, sf, "v9").select("item", "type_id", "bag", num.rounded(tx.box_area(z, z, w, h)).alias("box_area"), num.rounded(tx.polygon_area(tri)).alias("triangle_area"))


@query("b25_model_slug", "SELECT doc_id, translate(source || '/' || lang || '-v', '/-', '__') AS slug, CASE WHEN lang = 'en' THEN 'primary' ELSE 'sensitivity' END AS role FROM documents")
def b25(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("source", F.lit("/"), "lang", F.lit("-v"))
    return table(spark, sf, "documents").select("doc_id", tx.model_slug(name).alias("slug"), F.when(F.col("lang") == "en", "primary").otherwise("sensitivity").alias("role"))


@query("b26_eligibility_filters", """
SELECT cohort, count(*) AS n, sum(y)::BIGINT AS events, CASE WHEN count(*) < 10 OR sum(y) < 3 OR count(*) - sum(y) < 3 OR count(DISTINCT score) < 2 THEN 'SKIP' ELSE 'PASS' END AS status,
  CASE WHEN count(*) < 10 THEN 'too_few_rows' WHEN sum(y) < 3 OR count(*) - sum(y) < 3 THEN 'too_few_per_class' WHEN count(DISTINCT score) < 2 THEN 'no_variation' ELSE '' END AS skip_reason
FROM v6b GROUP BY cohort""", "v6b")
def b26(spark: SparkSession, sf: str) -> DataFrame:
    return eligibility.group_eligibility(view(spark, sf, "v6b"), ["cohort"], "y", "score").select("cohort", "n", "events", "status", "skip_reason")


@query("b27_include_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def b27(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.where(tx.include_filter(F.col("lang"), "en, de")).where(tx.include_filter(F.col("source"), "")).select("doc_id", "lang")
