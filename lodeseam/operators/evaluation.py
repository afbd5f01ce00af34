"""Retrieval metrics over long tables: ``qrels(qid, did, grade)`` and ``run(qid, did, rank)``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lodeseam.operators import retrieval

#: Whole words of a passage, and characters of one without such words, by which documents are found before it is looked for in them.
KEY_WORDS, KEY_CHARACTERS = 3, 16


def _gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def _dcg(gain: Column, rank: Column) -> Column:
    return gain / (F.log(rank + F.lit(1.0)) / F.log(F.lit(2.0)))


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10, recall_k: int = 100) -> DataFrame:
    """``(qid, ndcg, recall, success, mrr)`` of every judged query; a query without a run has zeros."""
    ideal = qrels.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "did"))).groupBy("qid").agg(
        F.sum(F.when(F.col("r") <= k, _dcg(_gain(F.col("grade")), F.col("r"))).otherwise(0.0)).alias("idcg"), F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)).alias("relevant"))
    hits = run.join(qrels, ["qid", "did"]).groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= k, _dcg(_gain(F.col("grade")), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when((F.col("grade") > 0) & (F.col("rank") <= recall_k), 1).otherwise(0)).alias("found"),
        F.min(F.when((F.col("grade") > 0) & (F.col("rank") <= k), F.col("rank"))).alias("first"),
    )
    both = ideal.join(hits, "qid", "left")
    share = lambda a, b: F.when(b > 0, F.coalesce(a, F.lit(0)) / b).otherwise(0.0)
    return both.select(
        "qid", share(F.col("dcg"), F.col("idcg")).alias("ndcg"), share(F.col("found"), F.col("relevant")).alias("recall"),
        F.when(F.col("first").isNotNull(), 1).otherwise(0).alias("success"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


@dataclass
class Passages:
    """Passages by keys that a text which holds one has, too: its first ``KEY_WORDS`` whole words, or one, or, if it has none (white space only at its ends), its first characters."""

    qids: list
    texts: list[str]
    #: By the size of a key (words, or characters if below 0): keys and the places of their passages.
    keys: dict[int, dict[tuple[str, ...] | str, list[int]]]

    @classmethod
    def of(cls, rows: Sequence) -> Passages:
        """Of ``(qid, passage)``."""
        keys: dict[int, dict] = {}
        for place, r in enumerate(rows):
            inner = r.passage.split(" ")[1:-1]
            size = KEY_WORDS if len(inner) >= KEY_WORDS else 1 if inner else -min(len(r.passage), KEY_CHARACTERS)
            keys.setdefault(size, {}).setdefault(tuple(inner[:size]) if size > 0 else r.passage[:-size], []).append(place)
        return cls([r.qid for r in rows], [r.passage for r in rows], keys)

    def held(self, text: str) -> list[int]:
        """The places of the passages that ``text`` holds."""
        words, found = text.split(" "), []
        for size, keys in self.keys.items():
            windows = zip(*(words[i:] for i in range(size))) if size > 0 else (text[i : i - size] for i in range(len(text) + size + 1))
            found += [p for key in keys.keys() & windows for p in keys[key] if self.texts[p] in text]
        return found


def passage_judgements(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``(qid, did, ...)``: the ``docs`` (``id``, ``text``, further columns are kept) that hold a passage (``qid``, ``passage``).

    About ``retrieval.BATCH_QUERIES`` passages at a time are sent to the tasks, which go through the texts once, find those with a key of a passage and look into them: neither words nor texts are shuffled.
    """
    kept = [c for c in docs.columns if c not in ("id", "text")]
    kinds = {"qid": passages.schema["qid"].dataType, "did": docs.schema["id"].dataType, **{c: docs.schema[c].dataType for c in kept}}
    own = docs.where(F.col("text").isNotNull()).select("id", F.col("text").cast("string").alias("text"), *kept)

    def part(some: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(Passages.of(some.select("qid", "passage").collect()))  # bounded by a batch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, key = shared.value, to_arrow_type(kinds["qid"])
            for b in batches:
                found = [(p, i) for i, text in enumerate(b.column("text").to_pylist()) for p in asked.held(text)]
                if found:
                    at = pa.array([i for _, i in found])
                    yield pa.RecordBatch.from_arrays([pa.array([asked.qids[p] for p, _ in found], key), *[b.column(c).take(at) for c in ("id", *kept)]], list(kinds))

        return own.mapInArrow(run, ", ".join(f"`{c}` {kind.simpleString()}" for c, kind in kinds.items()))

    return reduce(DataFrame.unionByName, map(part, retrieval.parts(passages.where(F.length("passage") > 0), retrieval.BATCH_QUERIES)))


def macro(figures: DataFrame, digits: int = 5) -> DataFrame:
    """The means over judged queries."""
    return figures.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), digits).alias(c) for c in ("ndcg", "recall", "success", "mrr")])


def success_at(run: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Share of judged queries with a relevant document among the first ``k``, for each cut, the uncut reciprocal rank, and nDCG at 10 as if one document were relevant."""
    first = run.join(qrels.where("grade > 0"), ["qid", "did"]).groupBy("qid").agg(F.min("rank").alias("first"))
    both = qrels.select("qid").distinct().join(first, "qid", "left")
    return both.agg(*[F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 5).alias(f"success_at_{k}") for k in cuts], F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 5).alias("mrr"),
                    F.round(F.avg(F.when(F.col("first") <= 10, _dcg(F.lit(1.0), F.col("first"))).otherwise(0.0)), 5).alias("ndcg"))


def judged_ids(qrels: DataFrame, first: int | None = None) -> DataFrame:
    """The judged queries, sorted, the first ones if a number is given."""
    ids = qrels.select("qid").distinct().orderBy("qid")
    return ids if first is None else ids.limit(first)


def judged(queries: DataFrame, qrels: DataFrame, first: int | None = None) -> DataFrame:
    """The ``queries`` (``qid``) that have judgements."""
    return queries.join(judged_ids(qrels, first), "qid", "left_semi")


def throughput(steps: DataFrame, by: list[str], at: str = "ts") -> DataFrame:
    """``(by, items, seconds, per_second)``: how many steps each group took from its first to its last one."""
    span = F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))
    found = steps.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), (span / 1e6).alias("seconds"))
    return found.withColumn("per_second", F.when(F.col("seconds") > 0, F.round(F.col("items") / F.col("seconds"), 6)))


#: Accuracy of the bounds between which a percentile is looked for: ranks are off by one in so many rows at most.
ACCURACY = 10_000


def percentiles(df: DataFrame, column: str, by: list[str], points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """The value at place ``min(n - 1, floor(p n / 100))`` of each sorted group.

    Exact, without sorting a group: approximate percentiles (a sketch, combined before the shuffle) bound each place from both sides; values below the lower bound are counted, and only
    the few between the bounds are counted value by value.
    """
    values = df.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("_v"))
    slack = 3 / ACCURACY
    low, high = ([min(1.0, max(0.0, p / 100 + d)) for p in points] for d in (-slack, slack))
    bounds = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", low, ACCURACY).alias("_low"), F.percentile_approx("_v", high, ACCURACY).alias("_high"))
    near = values.join(bounds, by)
    below = [F.sum(F.when(F.col("_v") < F.col("_low")[i], 1).otherwise(0)).alias(f"_b{i}") for i in range(len(points))]
    counted = near.groupBy(*by).agg(F.first("n").alias("n"), *below)
    inside = F.filter(F.array(*[F.when((F.col("_v") >= F.col("_low")[i]) & (F.col("_v") <= F.col("_high")[i]), i) for i in range(len(points))]), lambda x: x.isNotNull())
    some = near.select(*by, "_v", F.explode(inside).alias("_i")).groupBy(*by, "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_i").orderBy("_v"))
    ranks = some.withColumn("_upto", upto).join(counted, by)
    place = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100))
    return ranks.groupBy(*by).agg(F.first("n").alias("n"), *[F.min(F.when((F.col("_i") == i) & (F.col(f"_b{i}") + F.col("_upto") > place(p)), F.col("_v"))).alias(f"p{p}") for i, p in enumerate(points)])


def trec_run(run: DataFrame, tag: str = "lodeseam") -> DataFrame:
    """Lines of a run file: query, Q0, document, rank, score with six digits, tag."""
    return run.select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), "did", F.col("rank").cast("string"), F.format_string("%.6f", F.col("score")), F.lit(tag)).alias("value"))
