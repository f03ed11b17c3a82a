"""Sources and sinks: every input file is first written by Spark from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions.numeric import rounded
from cohortwise.functions.text import missing_cell
from cohortwise.plans.registry import query, r
from cohortwise.plans.views import table, view
from cohortwise.session import materialize, new_path
from cohortwise.sources import tables as src
from cohortwise.sources.cases import CASE_SCHEMA, flatten_cases
from cohortwise.streaming.resume import expected_files


@query("a1_keyed_tsv_scan", "SELECT cohort, CAST(entity AS VARCHAR) AS entity, round(value, 2) AS value, name FROM v1", "v1")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "keyed")
    src.write_tsv(view(spark, sf, "v1").select("cohort", "entity", "value", "name"), path)
    out = src.read_keyed_tsv(spark, path, "cohort string, entity string, value double, name string")
    return out.withColumn("value", F.round("value", 2))


@query("a2_missing_token_scan", """
SELECT case_id, CASE WHEN raw_value IN ('NaN','nan','NA','') OR NOT isfinite(TRY_CAST(raw_value AS DOUBLE)) THEN NULL
  ELSE TRY_CAST(raw_value AS DOUBLE) END AS value FROM v11""", "v11")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "tokens")
    src.write_tsv(view(spark, sf, "v11").select("case_id", "raw_value"), path)
    rows = src.read_keyed_tsv(spark, path, "case_id bigint, raw_value string")
    return rows.select("case_id", missing_cell(F.col("raw_value")).alias("value"))


def _wide_file(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Feature rows by one column per brand, named ``<digits>:<brand>``."""
    cells = view(spark, sf, "v2")
    names = [x[0] for x in table(spark, sf, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    wide = (cells.select(F.col("entity").cast("string").alias("feature"), F.col("feature").alias("brand"), "value")
            .groupBy("feature").pivot("brand", names).agg(F.first("value")))
    wide = wide.toDF("feature", *[f"q{len(n)}:{n}" for n in names])
    path = new_path(spark, "wide")
    # Every feature row appears twice, the second time doubled, so that rows must be averaged.
    twice = wide.unionByName(wide.select("feature", *[(F.col(f"`{c}`") * 2).alias(c) for c in wide.columns[1:]]))
    twice.write.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)
    return path, wide


@query("a3_wide_matrix_scan", """
SELECT feature AS entity, CAST(entity AS VARCHAR) AS feature, value * 1.5e0 AS value FROM v2
UNION ALL
SELECT f.feature, CAST(e.entity AS VARCHAR), NULL FROM (SELECT DISTINCT entity FROM v2) e, (SELECT DISTINCT feature FROM v2) f
WHERE NOT EXISTS (SELECT 1 FROM v2 x WHERE x.entity = e.entity AND x.feature = f.feature)""", "v2")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    path, _ = _wide_file(spark, sf)
    selection = src.header_map(spark, path).select("matrix_column", F.col("submitter").alias("entity"))
    out = src.read_wide_matrix(spark, path, selection)
    return out.select("entity", "feature", "value")


@query("a4_matrix_header_map",
       "SELECT DISTINCT concat('q', length(p_brand), ':', p_brand) AS matrix_column, p_brand AS submitter FROM part")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    path, _ = _wide_file(spark, sf)
    return src.header_map(spark, path)


def _count_files(spark: SparkSession, sf: str) -> str:
    """One tab-separated count file per nation, with comment lines."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = li.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("p_type") == "PROMO", "lncRNA").otherwise("protein_coding")
    name = F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("gene"), F.floor(F.col("p_partkey") / 2).cast("string")))
    tpm = F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_quantity").cast("string"))
    lines = rows.select(F.col("s_nationkey").alias("file"), F.concat_ws("\t", F.col("p_partkey").cast("string"), name, kind, tpm).alias("value"))
    notes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("file"), F.concat(F.lit("# model "), "n_name").alias("value"))
    path = new_path(spark, "counts")
    lines.join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("file")), "file").unionByName(notes).write.partitionBy("file").text(path)
    return path


_A5 = """
WITH g AS (SELECT s_nationkey AS nation, upper('gene' || CAST(p_partkey // 2 AS VARCHAR)) AS feature,
  avg(CASE WHEN l_linenumber = 3 THEN 0e0 ELSE l_quantity END) AS m
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  WHERE p_type <> 'PROMO' AND p_partkey % 11 <> 0 GROUP BY 1, 2)
"""


@query("a5_count_file_scan", _A5 + f"""
SELECT n_name AS entity, feature, {r('log2(m + 1)')} AS value FROM g JOIN nation ON nation = n_nationkey""")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    path = _count_files(spark, sf)
    files = table(spark, sf, "nation").select(F.col("n_name").alias("entity"), F.concat(F.lit("file="), F.col("n_nationkey").cast("string")).alias("file_name"))
    out = src.read_count_files(spark, path, files)
    return out.select("entity", "feature", rounded(F.col("value")).alias("value"))


@query("a5_missing_count_files", """
SELECT count(*) AS manifest_rows, count(s_nationkey) AS files_found, count(*) - count(s_nationkey) AS files_missing
FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_nationkey + 1000 FROM nation) m
LEFT JOIN (SELECT DISTINCT n_nationkey AS s_nationkey FROM nation) s ON k = s_nationkey""")
def a5_missing(spark: SparkSession, sf: str) -> DataFrame:
    found = src.file_inventory(spark, _count_files(spark, sf))
    nation = table(spark, sf, "nation")
    wanted = nation.select("n_nationkey").unionByName(nation.select((F.col("n_nationkey") + 1000).alias("n_nationkey")))
    wanted = wanted.select(F.concat(F.lit("file="), F.col("n_nationkey").cast("string")).alias("directory"))
    return (wanted.join(found, "directory", "left")
            .agg(F.count(F.lit(1)).alias("manifest_rows"), F.count("files").alias("files_found"),
                 (F.count(F.lit(1)) - F.count("files")).alias("files_missing")))


def _set_file(spark: SparkSession, sf: str) -> str:
    path = new_path(spark, "sets")
    short = table(spark, sf, "region").select(F.concat_ws("\t", "r_name", F.lit("na")).alias("value"))
    src.set_lines(view(spark, sf, "v8").select("set_name", F.concat(F.lit(" "), F.lower("feature")).alias("feature"))).unionByName(short).write.text(path)
    return path


@query("a6_set_file_scan", "SELECT set_name, upper(feature) AS feature FROM v8", "v8")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return src.read_sets(spark, _set_file(spark, sf))


@query("a7_set_file_sink", """
SELECT set_name || chr(9) || 'na' || chr(9) || string_agg(upper(feature), chr(9) ORDER BY upper(feature)) AS value
FROM v8 GROUP BY set_name""", "v8")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "setsink")
    v8 = view(spark, sf, "v8")
    src.write_sets(v8.select("set_name", F.concat("feature", F.lit("  ")).alias("feature")).unionByName(v8.select("set_name", "feature")), path)
    return spark.read.text(path)


@query("a8_parquet_roundtrip", "SELECT cohort, entity, feature, round(value, 4) AS value FROM v2", "v2")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(view(spark, sf, "v2"), "matrix").withColumn("value", F.round("value", 4))


@query("a9_key_union_tsv", """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, NULL AS status, c_mktsegment AS segment FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL, NULL FROM supplier
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, o_orderstatus, NULL FROM orders""")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"))
    rows = src.union_rows(c, s, o)
    path = new_path(spark, "rows")
    src.write_tsv(rows, path)
    return src.read_keyed_tsv(spark, path, ", ".join(f"`{x}` string" for x in rows.columns))


@query("a10_gzip_sink", "SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag FROM lineitem")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "gzip")
    src.write_tsv(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"), path, compression="gzip")
    return src.read_keyed_tsv(spark, path, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_returnflag string")


def _case_json(spark: SparkSession, sf: str) -> DataFrame:
    """One nested record per order row."""
    o = view(spark, sf, "v11")
    k = F.col("case_id")

    def s(c):
        return c.cast("string")

    dx = F.array(
        F.struct(F.when(k % 3 == 0, "").otherwise(s(9000 + k % 20000)).alias("age_at_diagnosis"), F.col("stage").alias("ajcc_pathologic_stage"),
                 F.when(k % 2 == 0, "Stage II").alias("ajcc_clinical_stage"), s(k % 700).alias("days_to_last_follow_up"),
                 F.when(k % 10 == 0, s(k % 365)).alias("days_to_recurrence"), F.when(k % 4 == 0, "unknown").alias("tumor_grade")),
        F.struct(s(8000 + k % 10000).alias("age_at_diagnosis"), F.lit("Stage I").alias("ajcc_pathologic_stage"), F.lit(None).cast("string").alias("ajcc_clinical_stage"),
                 F.lit("x").alias("days_to_last_follow_up"), F.lit(None).cast("string").alias("days_to_recurrence"), F.when(k % 5 != 0, "G2").alias("tumor_grade")),
    )
    fu = F.array(F.struct(s(k % 900).alias("days_to_follow_up"), F.when(k % 6 == 0, "Progression").otherwise("no").alias("progression_or_recurrence")))
    demo = F.struct(F.col("sex").alias("gender"), F.when(k % 3 == 0, "Dead").when(k % 3 == 1, "Alive").alias("vital_status"),
                    F.when(k % 3 == 0, s(k % 1000)).alias("days_to_death"), F.lit(None).cast("string").alias("days_to_last_follow_up"))
    return o.select(F.to_json(F.struct(s(k).alias("case_id"), s(F.col("entity")).alias("submitter_id"),
                                       F.struct(F.col("cohort").alias("project_id")).alias("project"), demo.alias("demographic"),
                                       dx.alias("diagnoses"), fu.alias("follow_ups"))).alias("value"))


_A11 = """
SELECT CAST(case_id AS VARCHAR) AS case_id, CAST(entity AS VARCHAR) AS entity, cohort,
  round((CASE WHEN case_id % 3 = 0 THEN 8000 + case_id % 10000 ELSE 9000 + case_id % 20000 END) / 365.25e0, 2) AS age,
  CASE WHEN sex IS NULL OR sex = 'Not Reported' THEN 'Not Reported' ELSE sex END AS sex,
  CASE WHEN stage IS NOT NULL AND stage NOT IN ('Unknown', 'Not Reported') THEN trim(stage)
       WHEN case_id % 2 = 0 THEN 'Stage II' ELSE 'Stage I' END AS stage,
  CASE WHEN case_id % 5 <> 0 THEN 'G2' ELSE 'Not Reported' END AS grade,
  CASE WHEN case_id % 10 = 0 OR case_id % 6 = 0 THEN 'Yes' ELSE 'Not Reported' END AS recurrence,
  CAST(CASE WHEN case_id % 3 = 0 THEN case_id % 1000 ELSE greatest(case_id % 700, case_id % 900) END AS DOUBLE) AS survival_time,
  CASE case_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' END AS survival_event,
  CASE case_id % 3 WHEN 0 THEN 'Dead' WHEN 1 THEN 'Alive' ELSE 'Not Reported' END AS vital_status
FROM v11"""


@query("a11_nested_case_flatten", _A11, "v11")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "cases")
    _case_json(spark, sf).write.text(path)
    return flatten_cases(spark.read.json(path, schema=CASE_SCHEMA))


@query("a12_json_report_sink", """
SELECT '{"case_id":' || CAST(case_id AS VARCHAR) || ',"priority":"' || priority || '","known":' ||
  CASE WHEN raw_value IN ('NaN','nan','NA','','inf','abc') THEN 'null' ELSE 'true' END || '}' AS value FROM v11""", "v11")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v11")
    # The raw number is parsed here without cleaning, so NaN and infinity reach the report.
    num = F.col("raw_value").try_cast("double")
    rows = v.select("case_id", "priority", num.alias("number"))
    path = new_path(spark, "report")
    src.json_rows(rows).write.text(path)
    back = spark.read.json(path, schema="case_id bigint, priority string, number double")
    return src.json_rows(back.select("case_id", "priority", F.when(F.col("number").isNotNull(), True).alias("known")))


@query("a13_item_vector_store", f"""
SELECT bag, item, i AS position, {r('CAST(embedding[i + 1] AS DOUBLE)')} AS value
FROM v5, (SELECT unnest(range(0, 64)) AS i)""", "v5")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    stored = materialize(view(spark, sf, "v5"), "vectors", partition_by=["cohort"])
    return stored.select("bag", "item", F.posexplode("embedding").alias("position", "v")).select("bag", "item", F.col("position").cast("bigint").alias("position"), rounded(F.col("v")).alias("value"))


@query("a14_item_score_store", f"""
SELECT cohort, bag, item, score AS score_raw,
  {r("coalesce((score - avg(score) OVER w) / nullif(stddev_pop(score) OVER w, 0), 0)")} AS score_z,
  {r("CASE WHEN count(*) OVER w = 1 THEN 1e0 ELSE (row_number() OVER (PARTITION BY bag ORDER BY score, item) - 1) / CAST(count(*) OVER w - 1 AS DOUBLE) END")} AS score_percentile
FROM v4 WINDOW w AS (PARTITION BY bag)""", "v4")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    from cohortwise.operators.windows import percentile_rank, zscore_population

    scored = zscore_population(view(spark, sf, "v4").select("cohort", "bag", "item", "score"), ["bag"], "score", "score_z")
    scored = percentile_rank(scored, ["bag"], "score", "item", "score_percentile")
    path = new_path(spark, "scores")
    src.write_scores(scored, path)
    back = spark.read.parquet(path)
    return back.select("cohort", "bag", "item", F.col("score").alias("score_raw"), rounded(F.col("score_z")).alias("score_z"),
                       rounded(F.col("score_percentile")).alias("score_percentile"))


@query("a15_file_inventory", """
SELECT 'file=' || CAST(k AS VARCHAR) AS directory, CASE WHEN k < 1000 THEN 'present' ELSE 'absent' END AS state
FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_nationkey + 1000 FROM nation)""")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey")
    wanted = nation.unionByName(nation.select((F.col("n_nationkey") + 1000).alias("n_nationkey")))
    manifest = wanted.select(F.concat(F.lit("file="), F.col("n_nationkey").cast("string")).alias("directory"))
    return expected_files(manifest, src.file_inventory(spark, _count_files(spark, sf))).select("directory", "state")


@query("a16_content_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", src.content_hash(F.col("text")).alias("digest"))
