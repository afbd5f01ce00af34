"""Rows of vectors as packed blocks, and blocks of queries beside every block of rows.

A stated set of queries meets all rows, block against block: each pair of blocks is one row with a few MB of numbers, so a task holds one
pair at a time, and a block's pairs follow one another, so that what is built for a block is built once a task. Rows and queries are dealt to blocks by a hash of id and
vector, whatever files they come from; more rows than a block takes (equal rows) make further blocks of the same shard.
Each pair keeps a bounded number of candidates per query, and a ranking window (combined before its shuffle) picks the best over all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 16_384
QUERY_ROWS = 2_048

_PACKED = "shard int, dim int, ids binary, numbers binary"


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` with ``v`` as doubles, of the rows that have an id and a vector of finite numbers."""
    v = F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(v, finite)).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def _pack(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``(shard, vec_id, v)`` to blocks of one shard and dimension with at most ``rows`` rows."""
    names = [c.split()[0] for c in _PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def blocks(key: tuple[int, int], least: int) -> Iterator[pa.RecordBatch]:
            parts = waiting.pop(key)
            ids, numbers = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            while len(order) >= least:
                part, order = order[:rows], order[rows:]
                columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([ids[part].tobytes()], pa.binary()), pa.array([numbers[part].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
            if len(order):
                waiting[key] = [(ids[order], numbers[order])]

        for batch in batches:
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            lists = batch.column("v")
            sizes = np.asarray(lists.value_lengths())
            flat = np.asarray(lists.flatten(), dtype=np.float64)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
            for shard, dim in sorted(set(zip(shards.tolist(), sizes.tolist(), strict=True))):
                here = np.flatnonzero((shards == shard) & (sizes == dim))
                key = (shard, dim)
                waiting.setdefault(key, []).append((ids[here], flat[starts[here][:, None] + np.arange(dim)]))
                if sum(len(p[0]) for p in waiting[key]) >= 2 * rows:
                    yield from blocks(key, 2 * rows)
        for key in list(waiting):
            yield from blocks(key, 1)

    return run


def unpack(ids: bytes, numbers: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(numbers, np.float64).reshape(-1, dim)


def blocks(vectors: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``vectors`` (from ``usable``) dealt to shards of about ``rows`` rows and packed, and the number of shards."""
    shards = max(1, math.ceil(vectors.count() / rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    return dealt.select("shard", "vec_id", "v").mapInArrow(_pack(2 * rows), _PACKED), shards


def block_pairs(vectors: DataFrame, queries: DataFrame, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Rows ``(dim, ids, numbers, query_ids, query_numbers)``: every block of ``vectors`` beside every block of ``queries`` (both from ``usable``)."""
    spark = vectors.sparkSession
    own, _ = blocks(vectors, block_rows)
    asked, query_shards = blocks(queries, query_rows)
    asked = asked.select("dim", F.col("ids").alias("query_ids"), F.col("numbers").alias("query_numbers"))
    # a salt spreads the pairs of a few query blocks over all tasks; it follows from the shard alone, so that a task that runs again sends its rows where they went before
    salts = max(1, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / query_shards))
    own = own.withColumn("_ls_salt", F.pmod("shard", F.lit(salts)).cast("int")).drop("shard")
    asked = asked.withColumn("_ls_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return own.join(asked, ["dim", "_ls_salt"]).drop("_ls_salt")


def best(found: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest scores of each query, ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
