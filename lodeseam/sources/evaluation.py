"""Published evaluation sets: corpus, queries and judgements, as Parquet or JSON lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.sources.files import exists

_TABLES = {
    "corpus": ({"did": ("_id", "id"), "text": ("text",)}, {}),
    "queries": ({"qid": ("_id", "id"), "text": ("text",)}, {}),
    "qrels": ({"qid": ("query-id", "query_id"), "did": ("corpus-id", "corpus_id")}, {"grade": ("score",)}),
}


@dataclass
class EvaluationTables:
    """``corpus(did, text)``, ``queries(qid, text)`` and ``qrels(qid, did, grade)``."""

    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


def evaluation_tables(spark: SparkSession, folder: str) -> EvaluationTables:
    """The three tables under ``folder``, each in a folder of its name or in ``<name>.parquet``; a judgement without a score counts 1."""

    def read(name: str) -> DataFrame:
        wanted, optional = _TABLES[name]
        packed = f"{folder}/{name}.parquet"
        found = spark.read.parquet(packed) if exists(spark, packed) else spark.read.json(f"{folder}/{name}", primitivesAsString=True)
        named = lambda names: next((F.col(f"`{n}`") for n in names if n in found.columns), None)
        columns = {k: named(names) for k, names in wanted.items()}
        if missing := [k for k, c in columns.items() if c is None]:
            raise ValueError(f"{name} has no column for {', '.join(missing)}")
        grades = [F.coalesce(c.cast("double"), F.lit(1.0)).alias(k) if (c := named(names)) is not None else F.lit(1.0).alias(k) for k, names in optional.items()]
        return found.select(*[c.cast("string").alias(k) for k, c in columns.items()], *grades)

    return EvaluationTables(read("corpus"), read("queries"), read("qrels"))
