"""A vector index in files: rows by cell, short codes that are scanned first, vectors that are fetched for the best few.

Rows stand under the nearest of some centres (``partitionBy("cell")``), each with a code: its difference from the centre, cut into runs of ``SUB`` components, each run replaced by the nearest of 256
values (product quantisation). A search reads the columns of codes in the cells that it looks into; all other cells are pruned at the scan, and vectors are not read. What codes stand for is compared with the queries
by matrix products, a block of queries and a block of rows at a time. Then the vectors of the ``pool`` best rows of each query are read, by cell and id, for the exact distance.

``exact`` gives the true nearest by the same files: a code knows how far it is from its vector, so it bounds the distance from above. The ``k``-th smallest upper bound of the nearest cells bounds the result; a cell
farther away than that, by its centre and radius, is not read. In the others the tasks compare the vectors themselves and keep ``k`` rows a query, so that pairs are neither shuffled nor joined, however little the bounds tell apart.

Scale: centres and values are fitted on a bounded sample (rows with the smallest hashes), their number is a parameter; encoding is a map, writing one rebalanced shuffle, in which a crowded cell is split over tasks. A
search sends at most ``retrieval.BATCH_QUERIES`` queries to the tasks at a time, which keep a bounded number of rows a query. Rows without a usable vector are not in the index; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

from lodeseam.operators import ann, retrieval

#: Components that one byte of a code stands for, values of a byte, rows that they are fitted on at most.
SUB, VALUES, FITTED = 2, 256, 8_192
#: Centres at most, queries of the sample that the number of cells to look into is measured on, and the share of neighbours that are to lie there.
MOST_CELLS, MEASURED, IN_CELLS = 4_096, 64, 0.985
#: Queries that a task compares with rows at a time; rows that it keeps before it lets go what is not among the nearest; tasks of a scan for each core.
QUERY_ROWS, PENDING, TASKS_PER_CORE = 1_024, 2_000_000, 2
#: Rows whose vectors are fetched for each query; candidates, and different ids, that go to the scan as literals.
POOL, FETCHED, LISTED = 100, 20_000, 1_000
#: What rounding may add to a bound.
SLACK = 1e-5
#: Distances of queries (their places and vectors) from some rows.
Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]
MODEL, CELLS = "kind string, place int, numbers array<double>", "cell int, radius double, n long"


def _numbers(vectors: pa.Array, dimensions: int) -> np.ndarray:
    """Vectors of that many numbers each, without nulls, as a matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), dimensions)


def _nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return ((to * to).sum(axis=1) - 2 * (x @ to.T)).argmin(axis=1)


def _values(x: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """``VALUES`` points that stand for the rows of ``x`` (k-means); fewer rows repeat."""
    points = x[np.resize(rng.permutation(len(x)), VALUES)]
    for _ in range(rounds):
        own = _nearest(x, points)
        n = np.bincount(own, minlength=VALUES)[:, None]
        sums = np.stack([np.bincount(own, x[:, d], VALUES) for d in range(x.shape[1])], axis=1)
        points = np.where(n > 0, sums / np.maximum(n, 1), points)
    return points


@dataclass
class Model:
    centres: np.ndarray  # cells, dimensions
    values: np.ndarray  # bytes of a code, VALUES, SUB
    probes: int
    dimensions: int

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into runs of ``SUB`` components."""
        return np.pad(x, ((0, 0), (0, len(self.values) * SUB - x.shape[1]))).reshape(len(x), len(self.values), SUB)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code, squared length of what the code stands for, distance from it, and distance from the centre, of each row of length 1."""
        cell = (x @ self.centres.T).argmax(axis=1)
        rest = self.parts(x - self.centres[cell])
        codes = np.stack([_nearest(rest[:, j], self.values[j]) for j in range(len(self.values))], axis=1).astype(np.uint8)
        stands = np.stack([self.values[j][codes[:, j]] for j in range(len(self.values))], axis=1)
        whole = self.centres[cell] + stands.reshape(len(x), -1)[:, : self.dimensions]
        return cell.astype(np.int32), codes, (whole * whole).sum(axis=1), np.linalg.norm(x - whole, axis=1), np.linalg.norm(x - self.centres[cell], axis=1)

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """What the codes of rows of a cell stand for."""
        stands = np.stack([self.values[j][codes[:, j]] for j in range(len(self.values))], axis=1)
        return self.centres[cell] + stands.reshape(len(codes), -1)[:, : self.dimensions]


class _Nearest:
    """The ``most`` nearest rows of each query so far, ties to the smaller id; a row farther than a query's ``edge`` is passed over. Holds ``most`` rows a query and ``PENDING`` that are not compared yet."""

    def __init__(self, most: int, edge: np.ndarray):
        self.most, self.edge, self.pending, self.found = most, edge.copy(), 0, []
        self.names: list[str] = []
        self.homes: list[int] = []

    def rows(self, names: list[str], cell: int) -> int:
        """Takes rows that ``add`` will tell of; the place of the first."""
        self.names += names
        self.homes += [cell] * len(names)
        return len(self.names) - len(names)

    def add(self, who: np.ndarray, first: int, far: np.ndarray) -> None:
        """How far the rows from ``first`` on are from the queries ``who``."""
        q, at = np.nonzero(far <= self.edge[who][:, None])
        self.found.append((who[q], first + at, far[q, at]))
        self.pending += len(q)

    def settle(self, least: int = 0) -> None:
        """Lets go what is not among the nearest, if more than ``least`` are pending."""
        if self.pending <= least or not self.found:
            return
        q, row, far = (np.concatenate(x) for x in zip(*self.found, strict=True))
        place = np.empty(len(self.names), np.int64)
        place[np.argsort(np.array(self.names, object), kind="stable")] = np.arange(len(self.names))
        by = np.lexsort((place[row], far, q))
        q, row, far = q[by], row[by], far[by]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q)))
        last, kept = rank == self.most - 1, rank < self.most
        self.edge[q[last]] = far[last]
        used, row = np.unique(row[kept], return_inverse=True)
        self.names, self.homes = [self.names[i] for i in used], [self.homes[i] for i in used]
        self.found, self.pending = [(q[kept], row, far[kept])], 0

    def batch(self) -> pa.RecordBatch:
        self.settle()
        q, row, far = self.found[0] if self.found else (np.empty(0, int), np.empty(0, int), np.empty(0))
        columns = [pa.array(q.astype(np.int32)), pa.array([self.names[i] for i in row], pa.string()), pa.array([self.homes[i] for i in row], pa.int32()), pa.array(far)]
        return pa.RecordBatch.from_arrays(columns, ["q", "id", "cell", "bound"])


def _fit(rows: DataFrame, dimensions: int, cells: int, seed: int = 3) -> Model:
    centres = ann.Cells.fit(rows, dimensions, max(1, min(cells, MOST_CELLS)), seed=seed).centres
    sample = ann.usable(rows, dimensions).orderBy(F.xxhash64("id")).limit(ann.SAMPLE).select("vector").toArrow().column("vector")
    x = retrieval.unit(np.array(sample.to_pylist(), float).reshape(-1, dimensions))
    model = Model(centres, np.zeros((-(-dimensions // SUB), VALUES, SUB)), 1, dimensions)
    if len(x):
        cell, rng = (x @ centres.T).argmax(axis=1), np.random.default_rng(seed)
        rest = model.parts((x - centres[cell])[:FITTED])
        model.values = np.stack([_values(rest[:, j], rng) for j in range(rest.shape[1])])
        asked = x[:: max(1, len(x) // MEASURED)]
        near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, 1:11]
        place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
        seen = np.sort(np.take_along_axis(place, cell[near], 1).ravel())
        model.probes = int(seen[min(len(seen) - 1, int(np.ceil(IN_CELLS * len(seen))))]) + 1 if len(seen) else 1
    return model


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        rows = spark.read.schema(MODEL).parquet(f"{folder}/model").collect()  # MOST_CELLS rows and the values of a code
        by = {kind: [r.numbers for r in sorted((r for r in rows if r.kind == kind), key=lambda r: r.place)] for kind in ("centre", "value", "figure")}
        probes, dimensions = (int(v) for v in by["figure"][0])
        self.model = Model(np.array(by["centre"], float).reshape(-1, dimensions), np.array(by["value"], float).reshape(-1, VALUES, SUB), probes, dimensions)
        self.radius, self.sizes = np.full(len(self.model.centres), -np.inf), np.zeros(len(self.model.centres), np.int64)
        for r in spark.read.schema(CELLS).parquet(f"{folder}/cells").collect():  # at most MOST_CELLS
            self.radius[r.cell], self.sizes[r.cell] = r.radius, r.n

    @classmethod
    def build(cls, rows: DataFrame, folder: str, dimensions: int, cells: int) -> VectorIndex:
        """Writes an index of ``rows`` (``id``, ``vector``) under ``folder``."""
        spark, model = rows.sparkSession, _fit(rows, dimensions, cells)
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    x = retrieval.unit(np.array(part.column("vector").to_pylist(), float).reshape(part.num_rows, dimensions))
                    cell, codes, square, error, far = shared.value.encode(x)
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cell), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, (square, error, far)), part.column("vector")], ["id", "cell", "code", "square", "error", "far", "vector"])

        own = ann.usable(rows, dimensions).select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        coded = own.mapInArrow(run, "id string, cell int, code binary, square double, error double, far double, vector array<float>")
        coded.hint("rebalance", "cell").sortWithinPartitions("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows")
        numbers = [("centre", i, c.tolist()) for i, c in enumerate(model.centres)] + [("value", i, v.ravel().tolist()) for i, v in enumerate(model.values)]
        spark.createDataFrame([*numbers, ("figure", 0, [float(model.probes), float(dimensions)])], MODEL).coalesce(1).write.mode("overwrite").parquet(f"{folder}/model")
        figures = cls._rows(spark, folder).groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
        figures.coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
        return cls(spark, folder)

    @staticmethod
    def _rows(spark: SparkSession, folder: str) -> DataFrame:
        return spark.read.schema("id string, code binary, square double, error double, far double, vector array<float>, cell int").parquet(f"{folder}/rows")

    def _asked(self, part: DataFrame) -> tuple[list, np.ndarray]:
        own = ann.usable(part.withColumnRenamed("qvec", "vector"), self.model.dimensions).collect()  # bounded by a batch
        return [r.qid for r in own], retrieval.unit(np.array([r.vector for r in own], float).reshape(-1, self.model.dimensions))

    def _cells(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """Whether each query looks into each cell."""
        looks = np.zeros((len(queries), len(self.model.centres)), bool)
        for at in range(0, len(queries), QUERY_ROWS):
            products = queries[at : at + QUERY_ROWS] @ self.model.centres.T
            np.put_along_axis(looks[at : at + QUERY_ROWS], np.argsort(-products, axis=1, kind="stable")[:, : max(1, probes)], True, axis=1)
        return looks

    def _scan(self, queries: np.ndarray, looks: np.ndarray, each: Callable[[np.ndarray, np.ndarray, np.ndarray | None], np.ndarray], most: int, errors: bool = True) -> DataFrame:
        """``(q, id, cell, bound, rank)``: per query the ``most`` rows with the smallest bounds; ``each`` makes them of queries' places, distances from what codes stand for, and errors (which are read if asked for)."""

        def measure(model: Model, part: pa.RecordBatch, cell: int) -> Measure:
            x = model.decode(cell, np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1))
            square, error = 1 + part.column("square").to_numpy(), part.column("error").to_numpy() if errors else None
            return lambda who, asked: each(who, np.sqrt(np.maximum(square - 2 * (asked @ x.T), 0)), error)

        return self._best(queries, looks, ["code", "square", *(["error"] if errors else [])], measure, most, np.full(len(queries), np.inf))

    def _compared(self, queries: np.ndarray, looks: np.ndarray, most: int, edge: np.ndarray, digits: int) -> DataFrame:
        """``(q, id, cell, bound, rank)``: per query the ``most`` rows with the smallest cosine distances up to its ``edge``, of the vectors themselves."""

        def measure(model: Model, part: pa.RecordBatch, cell: int) -> Measure:
            x = retrieval.unit(_numbers(part.column("vector"), model.dimensions))
            return lambda who, asked: np.round(1 - asked @ x.T, digits) + 0.0

        return self._best(queries, looks, ["vector"], measure, most, edge)

    def _best(self, queries: np.ndarray, looks: np.ndarray, columns: list[str], measure: Callable[[Model, pa.RecordBatch, int], Measure], most: int, edge: np.ndarray) -> DataFrame:
        """The ``most`` rows of each query in the cells that it looks into; ``measure`` makes of rows of a cell what measures them. A block of queries is compared with a block of rows at a time; a task keeps ``most``
        rows a query, and there are few tasks, as each hands on that many."""
        cells = np.flatnonzero(looks.any(axis=0) & (self.sizes > 0))
        # who looks into a cell goes out as bits
        shared = self.spark.sparkContext.broadcast((self.model, queries, {int(c): np.packbits(looks[:, c]) for c in cells}, edge))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, queries, wanted, edge = shared.value
            best = _Nearest(most, edge)
            for b in batches:
                homes = b.column("cell").to_numpy()
                for cell in map(int, np.unique(homes)):
                    here, asking = np.flatnonzero(homes == cell), np.flatnonzero(np.unpackbits(wanted[cell], count=len(queries)))
                    for rows in (here[i : i + retrieval.BATCH_ROWS] for i in range(0, len(here), retrieval.BATCH_ROWS)):
                        part = b.take(pa.array(rows))
                        first, far = best.rows(part.column("id").to_pylist(), cell), measure(model, part, cell)
                        for who in (asking[i : i + QUERY_ROWS] for i in range(0, len(asking), QUERY_ROWS)):
                            best.add(who, first, far(who, queries[who]))
                        best.settle(PENDING)  # not within a block: places change
            yield best.batch()

        own = self._rows(self.spark, self.folder).where(F.col("cell").isin(cells.tolist())).select("id", "cell", *columns)
        found = own.coalesce(TASKS_PER_CORE * self.spark.sparkContext.defaultParallelism).mapInArrow(run, "q int, id string, cell int, bound double")
        return retrieval.ranked(found, [F.col("bound"), F.col("id")], most, ["q"])

    def _fetched(self, found: DataFrame, few: bool, asked: list, queries: np.ndarray, kind: DataType, k: int, digits: int) -> DataFrame:
        """Exact distances of what was found, and the ``k`` nearest. What is ``few`` goes to the scan as filters: cells are pruned and pages without an id passed over."""
        rows = self._rows(self.spark, self.folder).select("cell", "id", "vector")
        if few:
            known = found.select("q", "cell", "id").collect()  # at most FETCHED
            rows, ids = rows.where(F.col("cell").isin(sorted({r.cell for r in known}))), {r.id for r in known}
            rows = rows.where(F.col("id").isin(sorted(ids))) if len(ids) <= LISTED else rows
            found = F.broadcast(self.spark.createDataFrame(known, "q int, cell int, id string"))
        shared, key = self.spark.sparkContext.broadcast((asked, queries)), to_arrow_type(kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, queries = shared.value
            for b in batches:
                q = b.column("q").to_numpy()
                x = retrieval.unit(_numbers(b.column("vector"), queries.shape[1]))
                far = np.round(1 - (x * queries[q]).sum(axis=1), digits) + 0.0
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q], key), b.column("id"), pa.array(far)], ["qid", "id", "distance"])

        exact = rows.join(found.select("q", "cell", "id"), ["cell", "id"]).select("q", "id", "vector").mapInArrow(run, f"qid {kind.simpleString()}, id string, distance double")
        return retrieval.ranked(exact, [F.col("distance"), F.col("id")], k, ["qid"])

    def search(self, queries: DataFrame, k: int, probes: int | None = None, pool: int = POOL, digits: int = 9) -> DataFrame:
        """``(qid, id, distance, rank)`` for ``queries`` (``qid``, ``qvec``): the nearest found; distances are exact."""
        kind, pool = queries.schema["qid"].dataType, max(pool, k)

        def part(some: DataFrame) -> DataFrame:
            asked, x = self._asked(some)
            found = self._scan(x, self._cells(x, probes or self.model.probes), lambda q, far, error: far, pool, errors=False).drop("rank")
            return self._fetched(found, len(asked) * pool <= FETCHED, asked, x, kind, k, digits)

        return reduce(DataFrame.unionByName, map(part, retrieval.parts(queries, retrieval.BATCH_QUERIES)))

    def exact(self, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
        """``(qid, id, distance, rank)`` for ``queries`` (``qid``, ``qvec``): the true nearest, ties to the smaller id."""
        kind = queries.schema["qid"].dataType

        def part(some: DataFrame) -> DataFrame:
            asked, x = self._asked(some)
            first = self._scan(x, self._cells(x, self.model.probes), lambda q, far, error: far + error, k)
            edge = np.full(len(asked), np.inf)
            for r in first.where(F.col("rank") == k).select("q", "bound").collect():  # one row a query at most
                edge[r.q] = r.bound + SLACK
            looks = np.empty((len(asked), len(self.model.centres)), bool)
            for at in range(0, len(asked), QUERY_ROWS):
                own = slice(at, at + QUERY_ROWS)
                to = np.sqrt(np.maximum((self.model.centres**2).sum(axis=1) + 1 - 2 * (x[own] @ self.model.centres.T), 0))
                looks[own] = to - self.radius <= edge[own][:, None] + SLACK
            # of vectors of length 1 the cosine distance is half the squared distance
            found = self._compared(x, looks, k, edge**2 / 2 + SLACK, digits)
            names = self.spark.createDataFrame(list(enumerate(asked)), StructType([StructField("q", IntegerType()), StructField("qid", kind)]))
            return found.join(F.broadcast(names), "q").select("qid", "id", F.col("bound").alias("distance"), "rank")

        return reduce(DataFrame.unionByName, map(part, retrieval.parts(queries, retrieval.BATCH_QUERIES)))

    def read_share(self, queries: DataFrame, k: int, probes: int | None = None, pool: int = POOL) -> DataFrame:
        """``(qid, share)``: the bytes of codes and vectors that ``search`` needs for a query alone, of the bytes of all vectors."""
        code, vector, total = len(self.model.values) + 8, 4 * self.model.dimensions, max(1, int(self.sizes.sum()))

        def part(some: DataFrame) -> DataFrame:
            asked, x = self._asked(some)
            scanned = self._cells(x, probes or self.model.probes) @ self.sizes
            shares = (scanned * code + np.minimum(scanned, max(pool, k)) * vector) / (total * vector)
            return self.spark.createDataFrame(list(zip(asked, map(float, shares), strict=True)), f"qid {queries.schema['qid'].dataType.simpleString()}, share double")

        return reduce(DataFrame.unionByName, map(part, retrieval.parts(queries, retrieval.BATCH_QUERIES)))
