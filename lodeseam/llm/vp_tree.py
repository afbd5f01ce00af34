"""Approximate nearest neighbours by vantage-point trees, one per shard.

A node splits its rows by their distance to a vantage point at the median. A query skips the far side of a node if the triangle inequality, with the
distance to the border multiplied by ``factor``, rules out anything nearer than its k-th hit so far; factor 1 is the exact search, larger
factors skip more. A first descent to the near leaf gives every query a radius to start from; queries that share a node are handled together.

The factor is tuned by measurement: for each block of queries beside a tree, at most ``MEASURED`` of the queries are searched exactly, and the largest of ``FACTORS`` with a recall
of at least ``RECALL`` on them serves the block (1, the exact search, if no other does). So the recall holds for any data, dimension, number of rows and number of files.

Nearness is the inner product: each vector gets one more component that brings all of a shard to the same length, and each query is brought to that length, after which
the largest product is the smallest Euclidean distance, a metric that the trees need. Every row is in the tree of its shard; scores are the products of the original vectors.

Scale: see ``vector_blocks``; a shard is a block of rows, dealt by a hash, and its tree is built once a task.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id; vectors of unlike length are
not compared; rows with the query's own id are no candidates; repeated rows may each be a result; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm.common import table
from lodeseam.llm.vector_blocks import best, block_pairs, unpack, usable

K = 20
QUERY_EVERY = 20
#: Factors to choose from, largest first, by the least recall on that many queries of a block.
FACTORS = (16.0, 12.0, 9.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.5)
RECALL = 0.97
MEASURED = 64
LEAF = 64
SHARD_ROWS = 8_192


class VantagePointTree:
    """Nodes are ``(vantage row, median, inner, outer)``, leaves arrays of rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 1):
        self.points, self.leaf, self.rng = points, leaf, np.random.default_rng(seed)
        self.square = (points * points).sum(axis=1)
        self.root = self._build(np.arange(len(points)))

    def _distance(self, a: np.ndarray, a_square: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(a_square[:, None] + self.square[rows] - 2 * (a @ self.points[rows].T), 0))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        vantage = int(self.rng.choice(rows))
        far = self._distance(self.points[[vantage]], self.square[[vantage]], rows)[0]
        middle = float(np.median(far))
        inside = far <= middle
        if inside.all():  # ties at the median: nothing to split
            inside = far < middle
        if not inside.any():
            return rows
        return vantage, middle, self._build(rows[inside]), self._build(rows[~inside])

    def search(self, queries: np.ndarray, forbidden: np.ndarray, ids: np.ndarray, k: int, factor: float, score: Callable[[int, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows of each query's ``k`` nearest (-1: none) and their distances, and how many distances were computed.

        Distances differ from what they stand for by rounding. Rows that are as near as the ``k``-th, within that, are told apart by ``score`` of the query (its place)
        and rows (None: the product of the points), higher first, and then by smaller id.
        """
        self.score = score or (lambda i, rows: products(np.broadcast_to(queries[i], (len(rows), queries.shape[1])), self.points[rows]))
        self.rounding = 1e-7 * np.sqrt(self.square.max(initial=0))
        self.queries, self.asked, self.forbidden, self.ids, self.k, self.cost = queries, (queries * queries).sum(axis=1), forbidden, ids, k, 0
        self.rows, self.far = np.full((len(queries), k), -1), np.full((len(queries), k), np.inf)
        everyone = np.arange(len(queries))
        first = np.empty(len(queries), object)
        self._descend(self.root, everyone, first)
        self._visit(self.root, everyone, first, factor)
        return self.rows, self.far, self.cost

    def _to_vantage(self, node, active: np.ndarray) -> np.ndarray:
        self.cost += len(active)
        return self._distance(self.queries[active], self.asked[active], np.array([node[0]]))[:, 0]

    def _descend(self, node, active: np.ndarray, first: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            self._look(node, active)
            for a in active:
                first[a] = id(node)
            return
        near = self._to_vantage(node, active) <= node[1]
        self._descend(node[2], active[near], first)
        self._descend(node[3], active[~near], first)

    def _visit(self, node, active: np.ndarray, first: np.ndarray, factor: float) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            self._look(node, active[first[active] != id(node)])
            return
        far = self._to_vantage(node, active)
        slack = self.rounding
        self._visit(node[2], active[factor * (far - node[1]) <= self.far[active, -1] + slack], first, factor)
        self._visit(node[3], active[factor * (node[1] - far) <= self.far[active, -1] + slack], first, factor)

    def _look(self, rows: np.ndarray, active: np.ndarray) -> None:
        for at in range(0, len(rows), 4096):  # a leaf of equal points may be long
            part = rows[at : at + 4096]
            far = self._distance(self.queries[active], self.asked[active], part)
            self.cost += far.size
            far[self.forbidden[active][:, None] == self.ids[part]] = np.inf
            far = np.concatenate([self.far[active], far], axis=1)
            which = np.concatenate([self.rows[active], np.broadcast_to(part, (len(active), len(part)))], axis=1)
            order = np.argpartition(far, self.k - 1, axis=1)[:, : self.k]
            edge = np.take_along_axis(far, order, 1).max(axis=1)
            near = (far <= (edge + self.rounding)[:, None]) & np.isfinite(edge)[:, None]
            for i in np.flatnonzero(near.sum(axis=1) > self.k):
                tied = np.flatnonzero(near[i])
                own = which[i, tied]
                order[i] = tied[np.lexsort((self.ids[own], -self.score(active[i], own)))[: self.k]]
            far, which = np.take_along_axis(far, order, 1), np.take_along_axis(which, order, 1)
            order = np.argsort(far, axis=1)
            self.far[active], self.rows[active] = np.take_along_axis(far, order, 1), np.take_along_axis(which, order, 1)


def even_lengths(numbers: np.ndarray) -> np.ndarray:
    """Each row with one more component, so that all rows are as long as the longest."""
    square = (numbers * numbers).sum(axis=1)
    return np.concatenate([numbers, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, added up from the first component on."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def tuned(tree: VantagePointTree, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, score: Callable[[int, np.ndarray], np.ndarray], least: float = RECALL, most: int = MEASURED) -> float:
    """The largest factor with a recall of ``least`` on ``most`` of the ``queries``, evenly picked."""
    picked = np.unique(np.linspace(0, len(queries) - 1, min(most, len(queries))).astype(np.int64))
    queries, own = queries[picked], own[picked]
    of = lambda i, rows: score(picked[i], rows)
    kth = tree.search(queries, own, ids, k, 1.0, of)[1]
    wanted = np.isfinite(kth).sum()
    edge = np.where(np.isfinite(kth), kth, -1).max(axis=1)[:, None] * (1 + 1e-9) + 1e-7 * np.sqrt(tree.square.max(initial=0))  # rounding
    for factor in FACTORS:
        far = tree.search(queries, own, ids, k, factor, of)[1]
        if (far <= edge).sum() >= least * wanted:
            return factor
    return 1.0


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the nearest rows found; both inputs have ``vec_id`` and ``embedding``. Without a ``factor`` it is tuned."""
    found = _pairs(vectors, queries, shard_rows).mapInArrow(lambda batches: (rows for rows, _ in _searched(batches, k, factor)), "query_id long, vec_id long, score double")
    return best(found, k)


def search_figures(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(rows, queries, factor, distances)`` of each tree and block of queries: what the search costs; all distances would be ``rows * queries``."""
    return _pairs(vectors, queries, shard_rows).mapInArrow(lambda batches: (figures for _, figures in _searched(batches, k, factor)), "rows long, queries long, factor double, distances long")


def _pairs(vectors: DataFrame, queries: DataFrame, shard_rows: int) -> DataFrame:
    nonzero = lambda df: usable(df).where(F.exists("v", lambda x: x != 0))
    return block_pairs(nonzero(vectors), nonzero(queries), block_rows=shard_rows)


def _searched(batches: Iterator[pa.RecordBatch], k: int, factor: float | None) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """What is found for each pair of blocks, and its figures."""
    if factor is not None and factor < 1:
        raise ValueError("factor must be at least 1")
    block, tree, ids, numbers = None, None, None, None
    for batch in batches:
        for at in range(batch.num_rows):
            b = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
            if block != (b["ids"], b["numbers"]):  # pairs of a block follow one another
                block = (b["ids"], b["numbers"])
                ids, numbers = unpack(b["ids"], b["numbers"], b["dim"])
                scale = max(float(np.abs(numbers).max(initial=0)), 1e-300)
                tree = VantagePointTree(even_lengths(numbers / scale))
            query_ids, asked = unpack(b["query_ids"], b["query_numbers"], b["dim"])
            even = asked / np.abs(asked).max(axis=1, keepdims=True)
            even *= np.sqrt(tree.square.max(initial=0)) / np.sqrt((even * even).sum(axis=1, keepdims=True))
            even = np.concatenate([even, np.zeros((len(asked), 1))], axis=1)
            score = lambda i, rows, asked=asked, numbers=numbers: products(np.broadcast_to(asked[i], (len(rows), asked.shape[1])), numbers[rows])
            own = tuned(tree, even, query_ids, ids, k, score) if factor is None else factor
            rows, _, cost = tree.search(even, query_ids, ids, k, own, score)
            who, hit = np.nonzero(rows >= 0)
            hit = rows[who, hit]
            hit, who = hit[ids[hit] != query_ids[who]], who[ids[hit] != query_ids[who]]
            found = pa.RecordBatch.from_arrays([pa.array(query_ids[who]), pa.array(ids[hit]), pa.array(products(asked[who], numbers[hit]))], ["query_id", "vec_id", "score"])
            yield found, pa.RecordBatch.from_arrays([pa.array([len(ids)]), pa.array([len(query_ids)]), pa.array([float(own)]), pa.array([int(cost)])], ["rows", "queries", "factor", "distances"])


def op3_vp_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))
