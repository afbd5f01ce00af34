"""The vector index against the exact search."""

import numpy as np
import pytest

from lodeseam.operators import ann, retrieval, vector_index


def table(spark, x, odd=()):
    rows = [(f"r{i}", [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows + list(odd), "id string, vector array<float>")


def key(df):
    return sorted((r.qid, r["rank"], r.id, r.distance) for r in df.collect())


def ask(rows, where):
    return rows.where(where).selectExpr("id AS qid", "vector AS qvec")


ODD = [("zero", [0.0] * 9), ("none", None), ("short", [1.0]), ("hole", [None] * 9)]


@pytest.mark.parametrize("kind", ["even", "clustered", "equal"])
def test_bounds_give_the_exact_result(spark, monkeypatch, tmp_path, kind):
    monkeypatch.setattr(retrieval, "BATCH_ROWS", 37)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 9))
    if kind == "clustered":
        x = x * 0.2 + 3 * rng.normal(size=(7, 9))[rng.integers(0, 7, 600)]
    if kind == "equal":
        x = np.repeat(x[:20], 30, axis=0)
    rows = table(spark, x, ODD)
    queries = ask(rows, "id IN ('r1', 'r2', 'r300', 'r599', 'zero', 'none', 'short')")
    index = vector_index.VectorIndex.build(rows, str(tmp_path), 9, 12)
    exact = retrieval.vector_topk_batch(ann.usable(rows, 9), queries.where("qid LIKE 'r%'"), 7)
    assert key(index.exact(queries, 7)) == key(exact) and len(key(exact)) == 28
    everything = index.search(queries, 7, probes=12, pool=700)
    assert key(everything) == key(exact)
    monkeypatch.setattr(vector_index, "FETCHED", 0)
    assert key(index.search(queries, 7, probes=12, pool=700)) == key(exact)


def test_few_cells_and_codes_find_most_and_read_little(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = 2 * rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32))
    rows = table(spark, x)
    index = vector_index.VectorIndex.build(rows, str(tmp_path), 32, 64)
    queries = ask(rows, "cast(substring(id, 2) AS int) % 100 = 0")
    recall = ann.recall(index.search(queries, 10), retrieval.vector_topk_batch(rows, queries, 10)).agg({"recall": "avg"}).first()[0]
    share = index.read_share(queries, 10).agg({"share": "avg"}).first()[0]
    assert index.model.probes < 40 and recall >= 0.95 and share <= 0.2


def test_scan_reads_codes_of_wanted_cells_only(spark, tmp_path):
    rows = table(spark, np.random.default_rng(4).normal(size=(300, 8)))
    index = vector_index.VectorIndex.build(rows, str(tmp_path), 8, 10)
    x = index._asked(ask(rows, "id = 'r5'"))[1]
    plan = index._scan(x, index._cells(x, 2), lambda q, far, error: far, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("#", "").replace("isnotnull", "") or "PartitionFilters: [isnotnull(cell" in plan or "cell#" in plan.split("PartitionFilters")[1][:60]
    assert "vector" not in plan.split("ReadSchema")[1]


def test_empty_and_tiny_tables(spark, tmp_path):
    empty = vector_index.VectorIndex.build(table(spark, np.empty((0, 4))), f"{tmp_path}/e", 4, 3)
    queries = ask(table(spark, np.ones((1, 4))), "true")
    assert empty.search(queries, 3).count() == empty.exact(queries, 3).count() == 0
    tiny = vector_index.VectorIndex.build(table(spark, [[1.0, 0, 0], [1, 1, 0]]), f"{tmp_path}/t", 3, 9)
    queries = ask(table(spark, [[1.0, 0, 0]]), "true")
    assert [r[2] for r in key(tiny.exact(queries, 5))] == [r[2] for r in key(tiny.search(queries, 5))] == ["r0", "r1"]
