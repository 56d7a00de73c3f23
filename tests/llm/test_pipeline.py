"""The pipeline on the smallest test tables and on odd ones."""

import os

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_stages_keep_clean_documents_and_take_effect(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n, seen = docs.count(), docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, seen, DATA)
        assert out.columns == docs.columns, name
        ids = {r[0] for r in out.select("doc_id").collect()}
        assert ids <= {r[0] for r in seen.select("doc_id").collect()}, name
        seen = p.written(out, "t")
    assert n * 0.5 < seen.count() < n
    bins = p.packing_stage(spark, seen, DATA)
    got = bins.select(F.explode("doc_ids").alias("d")).distinct()
    assert got.count() == seen.where("text rlike '\\\\S'").count()


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_stages_on_an_empty_table(spark):
    import corpus_pipeline as p

    none = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, none, DATA).count() == 0, name
