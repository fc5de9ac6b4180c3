"""The registered queries on the smallest tables, and the pipeline against its operators one by one."""

import os

import pytest
from pyspark.sql import functions as F

from gristmill.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    from tests.test_catalogue import compare

    compare(spark, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(path := f"{tmp_path}/{name}")
        out = spark.read.parquet(path)
        assert 0 < out.count() <= docs.count()
        if name != "sentencepiece":
            assert out.columns == docs.columns
            docs = out
    assert out.where(~F.col("exact")).isEmpty()
