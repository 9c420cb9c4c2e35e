import pytest

pytest.importorskip("tracewright.llm.queries")
import corpus_pipeline
from oracle import difference

from tracewright.llm import common, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    assert difference(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) == ""


def test_all_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} >= {f"op{i}" for i in range(1, 14)}


def test_pipeline_stages(spark):
    docs = common.documents(spark, SF)
    n = docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.staged(stage(spark, docs, SF), "test-stage")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert 0 < out.count() <= n
        docs, n = out, out.count()
    assert all(r["round_trip"] for r in docs.select("round_trip").collect())


def test_pipeline_on_empty_documents(spark):
    docs = common.documents(spark, SF).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, SF), "test-stage")
    assert docs.count() == 0
