"""A text index in blocks of rows, with the largest weight of each, and an exact search that opens only the blocks that can hold a hit.

Rows are laid out in an order that brings like rows together (by source and path, say) and cut into blocks of ``2 ** BITS`` rows. For each term and block there is one line: how many of the block's rows hold the term, the
largest count, the smallest length, and the rows themselves. The first three bound what the term can add to a score in that block, as BM25 grows with the count and falls with the length. All terms share the blocks, so
the bounds of a query's terms add up to a bound for a block.

A search reads the bounds only (the columns of rows are pruned), opens for each query the ``k`` blocks of the largest bounds, whose ``k``-th score is a floor, and then the blocks whose bound reaches it. A row elsewhere scores
less than the floor, so the result is that of scoring every posting. A query with fewer than ``k`` hits there has no floor and opens all blocks of its terms.

A table of queries asks for most terms and opens most blocks. Its terms go to the tasks, lines are dealt by block, and a task bounds and opens its blocks one by one against the best rows that it has found so far.

Scale: one shuffle of the rows, by ranges of what they are laid out by, writes the table; a task counts its rows in order, in runs of blocks that are sorted by term, and hands on whole lines. Blocks that a search wants go to
the scan as literals while they are few (row groups without them are skipped), and are joined beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodeseam import constants as C
from lodeseam.operators import retrieval

#: Rows of a block, as a power of two.
BITS = 5
#: Wanted blocks up to which they are sent to the scan as a filter.
LISTED = 1_000
#: Bytes of a row group: small, so that a filter skips most of a common term's blocks.
ROW_GROUP = 4 << 20
#: What rounding may take from a bound.
SLACK = 1e-8
POSTING = ("term", "id", "tf", "length")
LINE = ["term", "block", "size", "most", "least", "rows"]


def gain(tf: Column, length: Column, mean: float) -> Column:
    """What a term of weight 1 adds to the score of a row."""
    return tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * length / F.lit(mean)))


@dataclass
class BlockIndex:
    """``lines(term, block, size, most, least, rows)`` and the corpus figures ``n`` (rows) and ``mean`` (length)."""

    lines: DataFrame
    n: int
    mean: float

    @classmethod
    def build(cls, index: retrieval.TextIndex, rows: DataFrame, folder: str, order: Sequence[str] = (), text: str = "text") -> BlockIndex:
        """Writes ``index`` in blocks of ``rows`` (``id``, ``text`` and the columns of ``order``); columns that its postings hold besides are kept for filters."""
        keys, kept = [*order, "id"], [c for c in index.postings.columns if c not in POSTING]
        laid = rows.select(*dict.fromkeys([*keys, *kept]), F.col(text).cast("string").alias("_text")).repartitionByRange(*keys).sortWithinPartitions(*keys)
        held = pa.struct([pa.field("id", pa.string()), pa.field("tf", pa.int32()), pa.field("length", pa.int32()), *[pa.field(c, to_arrow_type(laid.schema[c].dataType)) for c in kept]])
        bits = BITS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = TaskContext.get().partitionId() << 33
            for b in batches:
                for at in range(0, b.num_rows, retrieval.RUN_ROWS):
                    part = b.slice(at, retrieval.RUN_ROWS)
                    names, term, row, tf, length = retrieval.run_of(part.column("_text").to_pylist())
                    first = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(row >> bits, prepend=-1))  # of each line; rows are in order within a term
                    size, of_row = np.diff(first, append=len(term)), pa.array(row)
                    columns = [part.column("id").cast(pa.string()).take(of_row), pa.array(tf), pa.array(length[row]), *[part.column(c).take(of_row) for c in kept]]
                    each = pa.ListArray.from_arrays(pa.array(np.append(first, len(term)).astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(held)))
                    most, least = (np.maximum.reduceat(tf, first), np.minimum.reduceat(length[row], first)) if len(first) else (tf, length[:0])
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(term[first])), pa.array(block + (row[first] >> bits)), pa.array(size), pa.array(most), pa.array(least), each], LINE)
                    block += -(-part.num_rows >> bits)

        kinds = ", ".join(["id: string, tf: int, length: int", *[f"{c}: {laid.schema[c].dataType.simpleString()}" for c in kept]])
        lines = laid.mapInArrow(run, f"term string, block long, size long, most int, least int, rows array<struct<{kinds}>>")
        lines.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/lines")
        return cls.open(index, folder)

    @classmethod
    def open(cls, index: retrieval.TextIndex, folder: str) -> BlockIndex:
        return cls(index.postings.sparkSession.read.parquet(f"{folder}/lines"), index.n, index.mean)

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The lines of the terms of ``queries``, and ``(qid, term, weight)``."""
        asked = retrieval.query_terms(queries)
        found = [r.term for r in asked.select("term").distinct().limit(retrieval.FILTER_TERMS + 1).collect()]  # bounded
        own = self.lines.where(F.col("term").isin(found)) if len(found) <= retrieval.FILTER_TERMS else self.lines.join(asked.select("term").distinct(), "term", "left_semi")
        df, qtf = F.col("df"), F.col("qtf")
        weight = F.log(1 + (F.lit(self.n) - df + 0.5) / (df + 0.5)) * qtf * (C.BM25_K3 + 1) / (C.BM25_K3 + qtf)
        return own, asked.join(own.groupBy("term").agg(F.sum("size").alias("df")), "term").select("qid", "term", weight.alias("weight"))

    def _bounds(self, own: DataFrame, known: DataFrame) -> DataFrame:
        """``(qid, block, bound)`` of each block that holds a term of a query."""
        most = F.col("weight") * gain(F.col("most"), F.col("least"), self.mean)
        return own.select("term", "block", "most", "least").join(known, "term").groupBy("qid", "block").agg(F.sum(most).alias("bound"))

    def _scores(self, own: DataFrame, known: DataFrame, wanted: DataFrame, where: Column | None) -> DataFrame:
        """``(qid, id, score)`` of the rows of the ``wanted`` blocks (``qid``, ``block``)."""
        each = own.select("term", "block", "rows").join(wanted.join(known, "qid"), ["term", "block"]).select("qid", "weight", F.inline("rows"))
        each = each if where is None else each.where(where)
        score = F.sum(F.col("weight") * gain(F.col("tf"), F.col("length"), self.mean))
        return each.groupBy("qid", "id").agg(F.round(score, 9).alias("score")).where("score > 0")

    def _best(self, scores: DataFrame, k: int) -> DataFrame:
        return retrieval.ranked(scores, [F.desc("score"), F.col("id")], k, ["qid"])

    def _wanted(self, own: DataFrame, known: DataFrame, k: int, where: Column | None) -> DataFrame:
        """``(qid, block, bound)`` of the blocks that can hold one of the ``k`` best."""
        bounds = self._bounds(own, known)
        first = retrieval.ranked(bounds, [F.desc("bound"), F.col("block")], k, ["qid"]).select("qid", "block")
        floor = self._best(self._scores(own, known, first, where), k).where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
        return bounds.join(floor, "qid", "left").where(F.col("bound") + SLACK >= F.coalesce("floor", F.lit(0.0))).select("qid", "block", "bound")

    def topk(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """``(qid, id, score, rank)`` for ``queries`` (``qid``, ``query``); ``where`` filters by columns that the postings hold."""
        if where is None and self._many(queries):
            return reduce(DataFrame.unionByName, (self._batch_topk(part, k) for part in retrieval.parts(queries, retrieval.BATCH_QUERIES)))
        own, known = self._asked(queries)
        wanted = self._wanted(own, known, k, where).select("qid", "block")
        found = wanted.limit(LISTED + 1).collect()  # bounded
        if len(found) <= LISTED:
            wanted = queries.sparkSession.createDataFrame(found, wanted.schema)
            own = own.where(F.col("block").isin(sorted({r.block for r in found})))
        return self._best(self._scores(own, known, wanted, where), k)

    def _many(self, queries: DataFrame) -> bool:
        return len(queries.select("qid").limit(retrieval.FEW_QUERIES + 1).collect()) > retrieval.FEW_QUERIES

    def _batch(self, queries: DataFrame, k: int) -> tuple[DataFrame, retrieval.Weights, np.ndarray]:
        """The lines of a batch's terms with the terms' numbers, its weights, and the floor of each of its queries: the ``k``-th score in the ``k`` blocks of the largest bounds."""
        own, known = self._asked(queries)
        weights, mean = retrieval.Weights.of(known.collect()), self.mean  # bounded by a batch
        spark, kind = queries.sparkSession, queries.schema["qid"].dataType
        terms = spark.createDataFrame(list(weights.terms.items()), "term string, number int")
        lines, shared = own.join(F.broadcast(terms), "term"), spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, best = shared.value, retrieval.Best(len(shared.value.qids), k)
            for b in _blocks(batches):
                best.add([f"{b.column('block')[0].as_py():020}"], np.round(_bound(b, weights, mean), 12)[:, None])
            yield best.rows(weights.qids, to_arrow_type(kind))

        bounds = _dealt(lines.select("block", "number", "most", "least")).mapInArrow(run, f"qid {kind.simpleString()}, id string, score double")
        first = spark.createDataFrame(self._best(bounds, k).select("qid", F.col("id").cast("long").alias("block")).collect(), f"qid {kind.simpleString()}, block long")  # k rows a query
        floors = {r.qid: r.score for r in self._best(self._scores(own, known, first, None), k).where(F.col("rank") == k).collect()}  # one row a query
        return lines, weights, np.array([floors.get(q, 0.0) for q in weights.qids])

    def _batch_topk(self, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
        lines, weights, floor = self._batch(queries, k)
        kind, mean = queries.schema["qid"].dataType, self.mean
        shared = queries.sparkSession.sparkContext.broadcast((weights, floor))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (weights, floor), best = shared.value, retrieval.Best(len(shared.value[0].qids), k)
            for b in _blocks(batches):
                if not (_bound(b, weights, mean) + SLACK >= np.maximum(floor, best.floor())).any():
                    continue
                rows = b.column("rows")
                flat, size = rows.flatten(), np.asarray(rows.value_lengths())
                ids, row = np.unique(np.array(flat.field("id").to_pylist(), object).astype(str), return_inverse=True)
                term = b.column("number").to_numpy()
                gain = retrieval.gains(flat.field("tf").to_numpy(), flat.field("length").to_numpy(), mean)
                best.add(ids.tolist(), weights.scores(row, np.repeat(term, size).astype(np.int64), gain, len(ids), digits))
            yield best.rows(weights.qids, to_arrow_type(kind))

        dealt = lines.select("block", "number", "most", "least", F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["tf"].alias("tf"), r["length"].alias("length"))).alias("rows"))
        found = _dealt(dealt).mapInArrow(run, f"qid {kind.simpleString()}, id string, score double")
        return self._best(found, k)

    def opened(self, queries: DataFrame, k: int) -> DataFrame:
        """``(qid, blocks, opened)``: how many blocks hold a term of a query, and how many of them its search opens."""
        if self._many(queries):
            return reduce(DataFrame.unionByName, (self._batch_opened(part, k) for part in retrieval.parts(queries, retrieval.BATCH_QUERIES)))
        own, known = self._asked(queries)
        wanted = self._wanted(own, known, k, None).select("qid", "block", F.lit(1).alias("one"))
        return self._bounds(own, known).join(wanted, ["qid", "block"], "left").groupBy("qid").agg(F.count(F.lit(1)).alias("blocks"), F.count("one").alias("opened"))

    def _batch_opened(self, queries: DataFrame, k: int) -> DataFrame:
        lines, weights, floor = self._batch(queries, k)
        kind, mean = queries.schema["qid"].dataType, self.mean
        shared = queries.sparkSession.sparkContext.broadcast((weights, floor))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, floor = shared.value
            blocks, opened = np.zeros(len(floor), np.int64), np.zeros(len(floor), np.int64)
            for b in _blocks(batches):
                bound = _bound(b, weights, mean)
                blocks, opened = blocks + (bound > 0), opened + ((bound > 0) & (bound + SLACK >= floor))
            yield pa.RecordBatch.from_arrays([pa.array(weights.qids, to_arrow_type(kind)), pa.array(blocks), pa.array(opened)], ["qid", "blocks", "opened"])

        found = _dealt(lines.select("block", "number", "most", "least")).mapInArrow(run, f"qid {kind.simpleString()}, blocks long, opened long")
        return found.groupBy("qid").agg(F.sum("blocks").alias("blocks"), F.sum("opened").alias("opened")).where("blocks > 0")


def _dealt(lines: DataFrame) -> DataFrame:
    """Lines by block, those of one together."""
    return lines.repartition("block").sortWithinPartitions("block")


def _bound(lines: pa.RecordBatch, weights: retrieval.Weights, mean: float) -> np.ndarray:
    """What each query can score at most in the block of these lines."""
    term, gain = lines.column("number").to_numpy().astype(np.int64), retrieval.gains(lines.column("most").to_numpy(), lines.column("least").to_numpy(), mean)
    return weights.scores(np.zeros(len(term), np.int64), term, gain, 1)[:, 0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each block, of lines in the order of blocks."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        block = b.column("block").to_numpy()
        for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
            piece = b.slice(int(part[0]), len(part)) if len(part) else b
            if held and len(part) and held[0].column("block")[0] != piece.column("block")[0]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held += [piece] if len(part) else []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
