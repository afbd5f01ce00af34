"""Vector searches against brute force."""

import math
import random

import numpy as np
import pytest

from lodeseam.llm import topk_search, vector_blocks, vp_tree

SCHEMA = "vec_id long, embedding array<float>, label int, score int, rank int, query_id int, dim int"


def vectors(n, dim=8, seed=1, whole=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    if whole:  # many ties
        x = np.round(x).astype(np.float32) / 4
    return [(i, [float(v) for v in row], 0, 0, 0, 0, 0) for i, row in enumerate(x)]


ODD = [(900, None, 0, 0, 0, 0, 0), (950, [float("nan")] * 8, 0, 0, 0, 0, 0), (1000, [float("inf")] * 8, 0, 0, 0, 0, 0), (1050, [1.0, None, *[0.0] * 6], 0, 0, 0, 0, 0), (1100, [], 0, 0, 0, 0, 0), (1150, [1.0, 2.0], 0, 0, 0, 0, 0), (None, [1.0] * 8, 0, 0, 0, 0, 0), (1200, [0.0] * 8, 0, 0, 0, 0, 0)]


def save(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def usable(rows):
    return [(r[0], np.array(r[1], float)) for r in rows if r[0] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1])]


@pytest.mark.parametrize("whole", [False, True])
def test_topk_query_is_exact(spark, tmp_path, whole):
    rows = vectors(400, whole=whole) + ODD + vectors(400, whole=whole)[50:52]
    got = {}
    for r in topk_search.op2_fagin_topk(spark, save(spark, rows, tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    own = [(i, np.floor(256 * v).astype(int)) for i, v in usable(rows)]
    for q, x in own:
        if q % 50 or q == 50:
            continue
        scores = sorted((-int(x @ v), i) for i, v in own if i != q and len(v) == len(x))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)], q


def test_threshold_stops_early_and_stays_exact():
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([rng.normal(size=(3000, 3)), [[9, 9, 9], [8, 9, 9]]]))
    lists = topk_search.SortedLists(np.arange(len(x)), x)
    ids, scores, cost = lists.search(np.array([200.0, 150, 100]), -1, 2)
    assert ids.tolist() == [3000, 3001] and cost < 600 and scores[0] == 450 * 9 * 256


def test_scores_beyond_doubles_are_exact():
    x = np.array([[2.0**40 + 1, 1], [2.0**40, 3], [-(2.0**40), 5]])
    _, scores, _ = topk_search.SortedLists(np.arange(3), x).search(np.array([2.0**20 + 1, 1]), -1, 3)
    assert [int(s) for s in scores] == sorted((int(a) * (2**20 + 1) + int(b) for a, b in x), reverse=True)


def test_packing_keeps_every_row(spark, tmp_path):
    rows = vectors(300) + ODD
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = vector_blocks.block_pairs(vector_blocks.usable(df), vector_blocks.usable(df.where("vec_id % 3 = 0")), 64, 16).collect()
    met = {(q, i) for p in pairs for q in np.frombuffer(p.query_ids, np.int64).tolist() for i in np.frombuffer(p.ids, np.int64).tolist()}
    own = usable(rows)
    assert met == {(q, i) for q, x in own for i, v in own if q % 3 == 0 and len(x) == len(v)}


def vp_recall(got, rows):
    """Share of the true neighbours that were found; checks order, ranks and scores."""
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    own = [(i, v) for i, v in usable(rows) if v.any()]
    by, hits, total = dict(own), 0, 0
    for q, x in own:
        if q % 20:
            continue
        truth = sorted((-float(x @ v), i) for i, v in own if i != q and len(v) == len(x))[:20]
        found = sorted(by_query.get(q, []))
        assert [k for k, _, _ in found] == list(range(1, len(truth) + 1))
        assert all(abs(s - float(x @ by[i])) < 1e-9 for _, i, s in found) and [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in truth})
        total += len(truth)
    assert set(by_query) <= {i for i, _ in own}
    return hits / total


@pytest.mark.parametrize("files", [1, 8, 64])
def test_vp_tree_query(spark, tmp_path, files):
    rows = vectors(500, seed=3) + ODD
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vp_recall(vp_tree.op3_vp_tree_neighbours(spark, str(tmp_path)).collect(), rows) >= 0.9


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = 3 * rng.normal(size=(20, dim))
    x = (centres[rng.integers(0, 20, n)] + rng.normal(size=(n, dim))).astype(np.float32)
    return [(i + 2000, [float(v) for v in row], 0, 0, 0, 0, 0) for i, row in enumerate(x)]


@pytest.mark.parametrize("n", [500, 6000])
@pytest.mark.parametrize("make", ["gaussian", "clustered"])
def test_vp_tree_recall_by_size_and_kind(spark, n, make):
    rows = vectors(n, 32, seed=n) if make == "gaussian" else clustered(n, 32, n)
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.where("vec_id % 20 = 0")
    assert vp_recall(vp_tree.nearest(df, asked, shard_rows=2000).collect(), rows) >= 0.9
    figures = vp_tree.search_figures(df, asked, shard_rows=2000).collect()
    assert sum(r["rows"] for r in figures) == n * len({r.queries for r in figures}) or sum(r["rows"] * r.queries for r in figures) == n * (n // 20)
    assert all(r.factor >= 1 and r.distances > 0 for r in figures)


def test_threshold_stops_early_in_few_dimensions(spark):
    rows = vectors(3000, 3, seed=9)
    df = spark.createDataFrame(rows, SCHEMA)
    figures = topk_search.search_figures(df, df.where("vec_id % 50 = 0")).collect()
    assert sum(r["rows"] * r.queries for r in figures) == 3000 * 60 and sum(r.scores for r in figures) < 0.3 * 3000 * 60


@pytest.mark.parametrize("factor", [1.0, 2.0])
def test_factor_one_is_exact_and_more_looks_at_less(factor):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 3))
    ids, q = np.arange(4000), x[::40] + 0.01
    tree = vp_tree.VantagePointTree(vp_tree.even_lengths(x))
    rows, _, cost = tree.search(np.concatenate([q, np.zeros((len(q), 1))], axis=1), np.full(len(q), -1), ids, 10, factor)
    truth = np.argsort(-(q @ x.T), axis=1)[:, :10]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(rows.tolist(), truth.tolist(), strict=True)])
    assert recall == 1.0 if factor == 1 else recall > 0.6
    assert cost < (0.9 if factor == 1 else 0.5) * len(q) * len(x)


def test_equal_points_make_a_leaf():
    x = np.ones((5000, 4))
    tree = vp_tree.VantagePointTree(vp_tree.even_lengths(x))
    rows, _, _ = tree.search(np.ones((1, 5)), np.array([7]), np.arange(5000), 20, 1.0)
    assert sorted(rows[0].tolist()) == [*range(7), *range(8, 21)]  # ties to smaller ids


@pytest.mark.parametrize("factor", [1.0, None])
def test_equal_vectors_go_by_id(spark, factor):
    rng = np.random.default_rng(2)
    kinds = rng.normal(size=(3, 16))
    rows = [(int(i), [float(x) for x in kinds[i % 3]], 0, 0, 0, 0, 0) for i in rng.permutation(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = vp_tree.nearest(df, df.where("vec_id IN (0, 1, 3000)"), factor=factor, shard_rows=1000).collect()
    scores = kinds @ kinds.T
    for q in (0, 1, 3000):
        nearest = int(scores[q % 3].argmax())
        want = [i for i in range(nearest, 6000, 3) if i != q][:20]
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == want



def test_empty_table(spark, tmp_path):
    folder = save(spark, [], tmp_path)
    assert topk_search.op2_fagin_topk(spark, folder).count() == 0 and vp_tree.op3_vp_tree_neighbours(spark, folder).count() == 0
    random.seed(0)
