"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Each block of vectors has one list per dimension, sorted by that component once a task. A query reads the list of a dimension from the top if its own component is
positive, from the bottom if it is negative, and not at all if it is zero. It reads its lists in lockstep, to a depth that doubles each round; rows that come up are fetched and
scored, each once and for this query alone; what the query gives for the components at the current depth bounds all rows not yet seen, and the query stops once that
bound is below its k-th score so far (an equal bound may still hide a tie with a smaller id).

Components are turned into integers ``floor(scale * x)``. Scores are exact: products are taken in doubles while no sum can reach 2**53, else in Python's integers.

Scale: see ``vector_blocks``; each pair of blocks gives ``k`` rows a query.

Cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id; vectors of unlike
length are not compared; rows with the query's own id are no candidates; repeated rows may each be a result; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm.common import table
from lodeseam.llm.vector_blocks import best, block_pairs, unpack, usable

K = 5
SCALE = 256
QUERY_EVERY = 50
FIRST_DEPTH = 8


class SortedLists:
    """A block of vectors with its per-dimension lists (rows in the order of falling components)."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray):
        self.ids, self.numbers = ids, numbers
        self.order = np.argsort(-numbers, axis=0, kind="stable")
        self.largest = float(np.abs(numbers).max(initial=0))

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The ids and scores of the ``k`` best rows, and how many scores were computed."""
        n, dim = self.numbers.shape
        exact = float(np.abs(query).max(initial=0)) * self.largest * dim < 2**53
        whole = query if exact else np.array([int(x) for x in query], object)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        ids, scores = np.empty(0, np.int64), np.empty(0, float if exact else object)
        fetched, cost, before, depth = np.zeros(n, bool), 0, 0, FIRST_DEPTH
        while before < n:
            depth = min(depth, n)
            new = np.zeros(n, bool)
            new[self.order[before:depth, up].ravel()] = True
            new[self.order[n - depth : n - before, down].ravel()] = True
            if not len(up) + len(down):  # a zero query: all scores are equal
                new[:] = True
            rows = np.flatnonzero(new & ~fetched)
            fetched[rows] = True
            cost += len(rows)
            if len(rows):
                found = self.numbers[rows] @ query if exact else _exactly(query[None], self.numbers[rows])[0]
                ids, scores = _merge(ids, scores, self.ids[rows], found, own, k)
            ends = np.concatenate([self.numbers[self.order[depth - 1, up], up], self.numbers[self.order[n - depth, down], down]])
            parts = whole[np.concatenate([up, down])]
            bound = float(ends @ parts) if exact else sum(int(x) * y for x, y in zip(ends, parts, strict=True))
            if len(ids) >= k and bound < scores[k - 1] or cost == n:
                break
            before, depth = depth, 2 * depth
        return ids, scores, cost


def _exactly(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return whole(a).dot(whole(b).T)


def _merge(ids: np.ndarray, scores: np.ndarray, new_ids: np.ndarray, new_scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(new_scores) > 4 * k and new_scores.dtype != object:  # first what can't be among the k best, even without the query's own rows
        other = new_ids != own
        new_ids, new_scores = new_ids[other], new_scores[other]
        if len(new_scores) > k:
            least = np.partition(new_scores, len(new_scores) - k)[len(new_scores) - k]
            near = new_scores >= (max(least, scores[k - 1]) if len(scores) >= k else least)
            new_ids, new_scores = new_ids[near], new_scores[near]
    ids, scores = np.concatenate([ids, new_ids]), np.concatenate([scores, new_scores])
    other = ids != own
    ids, scores = ids[other], scores[other]
    order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)
    return ids[order[:k]], scores[order[:k]]


def _searched(batches: Iterator[pa.RecordBatch], k: int, scale: int) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """What is found for each pair of blocks, and its figures."""
    block, lists = None, None
    for batch in batches:
        for at in range(batch.num_rows):
            b = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
            if block != (b["ids"], b["numbers"]):  # pairs of a block follow one another
                block = (b["ids"], b["numbers"])
                ids, numbers = unpack(b["ids"], b["numbers"], b["dim"])
                lists = SortedLists(ids, np.floor(scale * numbers))
            query_ids, asked = unpack(b["query_ids"], b["query_numbers"], b["dim"])
            asked = np.floor(scale * asked)
            found = [lists.search(q, own, k) for q, own in zip(asked, query_ids, strict=True)]
            columns = [pa.array(np.repeat(query_ids, [len(x[0]) for x in found])), pa.array(np.concatenate([x[0] for x in found])), pa.array([int(s) for x in found for s in x[1]], pa.int64())]
            figures = [pa.array([len(lists.ids)]), pa.array([len(query_ids)]), pa.array([sum(x[2] for x in found)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"]), pa.RecordBatch.from_arrays(figures, ["rows", "queries", "scores"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` highest integer inner products; both inputs have ``vec_id`` and ``embedding``."""
    pairs = block_pairs(usable(vectors), usable(queries))
    return best(pairs.mapInArrow(lambda batches: (rows for rows, _ in _searched(batches, k, scale)), "query_id long, vec_id long, score long"), k)


def search_figures(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """``(rows, queries, scores)`` of each pair of blocks: how many scores the search computes; all would be ``rows * queries``."""
    pairs = block_pairs(usable(vectors), usable(queries))
    return pairs.mapInArrow(lambda batches: (figures for _, figures in _searched(batches, k, scale)), "rows long, queries long, scores long")


def op2_fagin_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


OP2_SQL = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v) WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
