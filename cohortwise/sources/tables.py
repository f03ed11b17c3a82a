"""Readers and writers for delimited matrices, set files, nested records and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.functions.numeric import finite, log2p1
from cohortwise.functions.text import missing_cell, stripped

# Fixed value: the only kind of measurement kept from count files.
KEPT_KIND = "protein_coding"


def read_keyed_tsv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def write_tsv(df: DataFrame, path: str, compression: str | None = None) -> None:
    writer = df.write.option("sep", "\t").option("header", True).option("emptyValue", "")
    (writer.option("compression", compression) if compression else writer).csv(path)


def union_rows(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the union of their columns, first-seen order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def matrix_columns(spark: SparkSession, path: str) -> list[str]:
    """Header of a wide matrix; no data row is read."""
    return spark.read.csv(path, sep="\t", header=True).columns


def header_map(spark: SparkSession, path: str) -> DataFrame:
    """One row per measurement column of a wide matrix, ``a:b`` keyed by ``b``."""
    names = matrix_columns(spark, path)[1:]
    rows = spark.createDataFrame([(n,) for n in names], "matrix_column string")
    return rows.select("matrix_column", F.regexp_replace("matrix_column", "^[^:]*:", "").alias("submitter"))


def read_wide_matrix(spark: SparkSession, path: str, selection: DataFrame, column: str = "matrix_column",
                     entity: str = "entity", require_all: bool = True) -> DataFrame:
    """Long ``(entity, feature, value)`` from the selected columns of a wide matrix.

    Only the chosen columns are parsed. Duplicate feature rows are averaged.
    The selection names file columns, so it is as small as the file header.
    """
    header = matrix_columns(spark, path)
    limit = len(header)
    wanted = [r[0] for r in selection.select(column).distinct().limit(limit + 1).collect()]
    absent = sorted(set(wanted) - set(header))
    if absent and require_all:
        raise ValueError(f"{len(absent)} selected columns are not in the matrix, e.g. {absent[:5]}")
    keep = [c for c in header[1:] if c in set(wanted)]
    raw = spark.read.csv(path, sep="\t", header=True)
    feature = header[0]
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("matrix_column"), F.col(f"`{c}`").alias("cell")) for c in keep]))
    long = (raw.select(F.col(f"`{feature}`").alias("feature"), cells)
            .select("feature", "matrix_column", missing_cell(F.col("cell")).alias("value")))
    names = selection.select(F.col(column).alias("matrix_column"), F.col(entity).alias("entity")).distinct()
    return (long.join(names, "matrix_column").groupBy("entity", "feature")
            .agg(F.avg("value").alias("value")))


def read_count_files(spark: SparkSession, path: str, file_map: DataFrame) -> DataFrame:
    """Per-file transformed counts: ``log2(mean + 1)`` per upper-cased name.

    ``file_map`` holds ``(entity, file_name)``; entities whose file is absent
    simply have no rows (see :func:`missing_files`).
    """
    rows = spark.read.csv(path, sep="\t", comment="#", recursiveFileLookup=True,
                          schema="gene_id string, gene_name string, gene_type string, tpm string")
    kept = (rows.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("file_name"), "gene_name", "gene_type", "tpm")
            .where((F.col("gene_type") == KEPT_KIND) & (F.coalesce(F.col("gene_name"), F.lit("")) != "")))
    value = F.coalesce(finite(F.col("tpm").try_cast("double")), F.lit(0.0))
    per_name = (kept.groupBy("file_name", F.upper("gene_name").alias("feature"))
                .agg(F.avg(value).alias("m")))
    return (file_map.join(per_name, "file_name")
            .select("entity", "file_name", "feature", log2p1(F.col("m")).alias("value")))


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """Set file lines ``name <tab> note <tab> member...`` to long rows."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 3)
    return (parts.select(F.col("p")[0].alias("set_name"), F.explode(F.slice("p", F.lit(3), F.size("p") - 2)).alias("member"))
            .select("set_name", F.upper(stripped("member")).alias("feature")).where(F.col("feature") != "").distinct())


def set_lines(sets: DataFrame) -> DataFrame:
    """Set file lines with trimmed, upper-cased, distinct, sorted members."""
    clean = sets.select("set_name", F.upper(stripped("feature")).alias("feature")).where(F.col("feature") != "").distinct()
    members = clean.groupBy("set_name").agg(F.array_sort(F.collect_list("feature")).alias("m"))
    return members.select(F.concat_ws("\t", "set_name", F.lit("na"), F.array_join("m", "\t")).alias("value"))


def write_sets(sets: DataFrame, path: str) -> None:
    set_lines(sets).write.text(path)


def json_rows(df: DataFrame, out: str = "value") -> DataFrame:
    """Report rows as JSON text with non-finite numbers as null."""
    cols = [finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(out))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes per directory; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return (files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("directory"), "length")
            .groupBy("directory").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
                                      F.count_if(F.col("length") > 0).alias("non_empty_files")))


def content_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def write_scores(df: DataFrame, path: str, partition: Sequence[str] = ("cohort",)) -> None:
    df.write.partitionBy(*partition).parquet(path)
