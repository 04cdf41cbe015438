import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import registry, simhash

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert oracle.compare(spark, con, QUERIES[name], SQL[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_returns_every_document(spark, sf_dir, name):
    table = "embeddings" if name.startswith("op10") else "documents"
    key = "vec_id" if name.startswith("op10") else "doc_id"
    got = QUERIES[name](spark, sf_dir).select(key)
    assert sorted(got.collect()) == sorted(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect())


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k == 4:
            assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
            assert out.count() == before.count()
            break
        assert out.columns == columns
        if k in (0, 1):
            assert out.exceptAll(before).count() == 0 and 0 < out.count() < before.count()
        if k == 1:
            assert simhash.near_duplicates(out).where("doc_id != component_id").count() == 0
        if k == 2:
            same = out.join(before, ["doc_id", "text"], "left_semi").count()
            assert same >= 0.8 * before.count()
        if k == 3:
            assert out.join(before, "doc_id", "left_anti").count() == 0
            assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
        before = out
    assert corpus_pipeline.ORACLE_SQL is None
