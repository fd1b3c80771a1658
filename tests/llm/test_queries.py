"""The registered queries of the training-data operators."""

import pytest

import __spark_entry__
from dialogweave.llm import oracles, queries
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


def test_registered():
    known = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(known) and "pipeline" in known
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), name, SF) is None


def test_pipeline_keeps_what_it_should(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0.7 * docs.count() < len(ids) < docs.count()
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
