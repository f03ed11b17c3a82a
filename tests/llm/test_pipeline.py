"""The pipeline's stages against brute force on their own inputs."""

from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cohortwise.llm import bpe, ngram_join
from test_operators import WORD, grouped


@pytest.fixture(scope="module")
def results(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{corpus_pipeline.new_path(spark, name)}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_columns_and_drop_rows(spark, sf, results):
    before = spark.read.parquet(f"{sf}/documents.parquet")
    for after in results[:3]:
        assert after.columns == corpus_pipeline.COLUMNS
        assert after.exceptAll(before.select(after.columns)).isEmpty()
        before = after
    assert results[3].columns == corpus_pipeline.COLUMNS
    assert results[3].distinct().exceptAll(results[2]).isEmpty()


def test_rules_keep_only_long_enough_documents(results):
    assert all(len(WORD.findall(r.text)) >= 50 for r in results[0].collect())


def test_clean_documents_stay(spark, sf, results):
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    kept = results[1].join(good, "doc_id").count()
    assert kept >= 0.97 * results[0].join(good, "doc_id").count()


def test_one_document_of_each_group_stays(results):
    rows = [(r.doc_id, r.text) for r in results[1].collect()]
    want = {d for d, _, least in grouped(rows, ngram_join.NEAR_NGRAM, ngram_join.NEAR_THRESHOLD) if d == least}
    assert Counter(r.doc_id for r in results[2].collect()) == Counter(want)


def test_ids_are_those_of_the_library(results):
    pieces = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    want = Counter((r.doc_id, tuple(encoding.encode_ordinary(r.text))) for r in results[3].collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in results[4].select("doc_id", "ids").collect()) == want


def test_stages_on_empty_tables(spark, sf, results):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
