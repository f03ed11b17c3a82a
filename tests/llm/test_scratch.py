"""Shuffle files of written tables, and what the n-gram join leaves and sends."""

import glob
import os
import time

from pyspark.sql import functions as F

from cohortwise.llm import ngram_join
from cohortwise.session import materialize, scratch_dir


def test_shuffle_files_go_when_a_table_is_written(spark):
    # A local session keeps its shuffle files under the folder of its block manager.
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]

    def held():
        return {f for f in glob.glob(f"{root}/**/shuffle_*.data", recursive=True) if os.path.getsize(f)}

    before = held()
    table = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    time.sleep(1)
    assert not held() - before
    assert sum(r.n for r in table.collect()) == 1000


def test_the_ngram_join_leaves_no_sets(spark):
    """Neither a table of whole sets nor the shuffle files of its bitmaps stay behind."""
    def tables():
        return set(glob.glob(f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/*"))

    before = tables()
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(8)], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.group(docs).collect()} == {0}
    left = [spark.read.parquet(t) for t in tables() - before]
    assert left and not [t.columns for t in left if "tokens" in t.columns]

    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    held = set(glob.glob(f"{root}/**/shuffle_*.data", recursive=True))
    assert ngram_join._bitmap(spark.range(1000, numPartitions=4).select(F.col("id").alias("cell")), "cell", 1 << 16).sum() == 1000
    time.sleep(1)
    assert not {f for f in glob.glob(f"{root}/**/shuffle_*.data", recursive=True) if os.path.getsize(f)} - held


def test_sets_go_to_python_a_few_at_a_time(spark):
    def sizes(batches):
        for b in batches:
            yield b.iloc[:1].assign(id=len(b))

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(0, 2000, numPartitions=1).mapInPandas(sizes, "id long")
    assert max(r.id for r in ngram_join.written_few(rows, "few").collect()) <= ngram_join.SENT_ROWS
    assert spark.conf.get(key) == before
