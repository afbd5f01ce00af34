"""Every query of the catalogue runs, and gives what its SQL gives."""

import pytest

from lodeseam.queries import ORACLES, QUERIES

from . import oracle

pytestmark = pytest.mark.skipif(not oracle.DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    oracle.compare(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, str(oracle.DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_ann_recall_is_of_every_query_of_the_set(spark):
    asked = spark.read.parquet(f"{oracle.DATA}/embeddings.parquet").where("embedding IS NOT NULL AND vec_id % 25 = 0").count()
    got = QUERIES["ann_recall"](spark, str(oracle.DATA)).collect()
    assert asked > 0 and len(got) == len({r.qid for r in got}) == asked
    assert sum(r.recall_at_10 for r in got) >= 0.9 * asked


@pytest.mark.parametrize("name", ["batch_vector_topk", "eval_recall", "bm25_batch_queries"])
def test_query_sets_beyond_a_batch_are_joined_in_parts(spark, monkeypatch, name):
    from lodeseam.operators import retrieval

    monkeypatch.setattr(retrieval, "BATCH_QUERIES", 7)
    monkeypatch.setattr(retrieval, "BATCH_ROWS", 9)
    monkeypatch.setattr(retrieval, "FILTER_TERMS", 3)
    oracle.compare(spark, QUERIES[name], ORACLES[name])
