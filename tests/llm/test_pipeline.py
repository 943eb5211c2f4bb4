"""The corpus pipeline against its stages' operators on the smallest tables."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import neardup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, start, seen = docs.columns, docs.count(), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "sentencepiece":
            assert docs.columns == columns
        docs = docs.cache()
        seen.append(docs.count())
        if name == "minhash_near_dedup":
            assert neardup.near_duplicates(docs).filter("not kept").count() == 0
    assert start > seen[0] > seen[1] >= seen[2] > 0 and seen[3] == seen[4]
    assert docs.filter(~F.col("lossless")).count() == 0


def test_clean_documents_stay(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.keep_quality(spark, corpus_pipeline.drop_toxic(spark, docs, SF), SF)
    clean = labels.filter("quality = 1 and toxic = 0")
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.05 * clean.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_pieces", "ids", "decoded_sha256", "lossless"] and out.count() > 0
    assert all(re.fullmatch("[0-9a-f]{64}", r.decoded_sha256) for r in out.limit(5).collect())
