"""Cells for approximate vector search, and the recall of what a search finds.

Centres are fitted (spherical k-means) on a bounded sample, those rows with the smallest hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.operators import retrieval

#: Rows that centres are fitted on at most, and rounds of the fit.
SAMPLE, ROUNDS = 20_000, 12


def usable(rows: DataFrame, dimensions: int) -> DataFrame:
    """Rows with a vector of that many numbers, not all zero."""
    vector = F.col("vector")
    return rows.where(vector.isNotNull() & (F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull()) & F.exists(vector, lambda x: x != 0))


@dataclass
class Cells:
    centres: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, dimensions: int, cells: int, sample: int = SAMPLE, seed: int = 3) -> Cells:
        found = usable(rows, dimensions).orderBy(F.xxhash64("id")).limit(sample).select("vector").toArrow().column("vector")
        x = retrieval.unit(np.array(found.to_pylist(), float).reshape(-1, dimensions))
        centres = x[np.random.default_rng(seed).permutation(len(x))[: max(1, cells)]]
        for _ in range(ROUNDS if len(x) else 0):
            own = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
        return cls(centres)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(qid, recall)``: the share of the ``exact`` neighbours that are as near as something that was found at their distance or below."""
    edge = exact.groupBy("qid").agg(F.max("distance").alias("edge"), F.count(F.lit(1)).alias("n"))
    hits = found.join(edge, "qid").where("distance <= edge").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    return edge.join(hits, "qid", "left").select("qid", (F.least(F.coalesce("hits", F.lit(0)), F.col("n")) / F.col("n")).alias("recall"))
