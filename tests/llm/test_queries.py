"""Registered queries against their SQL, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from strataspark.llm import queries
from tests.test_oracle import TABLES, compare


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, spark, sf_dir, duck):
    compare(name, queries.queries()[name], queries.oracle_sql()[name], spark, sf_dir, duck)


def test_ten_queries():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).groupBy("shard").count().collect()
    assert max(r["count"] for r in rows) - min(r["count"] for r in rows) <= 1


def test_pipeline_of_odd_rows(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (1, "", "en", "a", 0), (2, "", None, None, 0), (2, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, sf_dir).count() <= 20
