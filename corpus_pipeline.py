"""A corpus pipeline of five stages: toxicity, line dedup, SimHash near-dedup, substring dedup, best-fit packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``. ``run`` writes what a stage
returns as Parquet to the shared folder and reads it again for the next one, so a lost executor costs no more than its stage's tasks; what a stage has read goes once its result is written.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm.common import table
from lodeseam.llm.line_dedup import drop_boilerplate_lines
from lodeseam.llm.packing import pack_documents
from lodeseam.llm.simhash_dedup import drop_near_duplicates, similar_groups
from lodeseam.llm.substring_dedup import drop_repeated_spans
from lodeseam.llm.toxicity import drop_toxic, learn
from lodeseam.sources.files import remove, shared_folder


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``n_chars`` as long as the text is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return drop_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go."""
    return _counted(drop_boilerplate_lines(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays: SimHash fingerprints give candidates, prefixes of the shingles those that fingerprints miss, and all are verified."""
    return drop_near_duplicates(docs, similar_groups(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat a passage go."""
    return _counted(drop_repeated_spans(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece of a document."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("best_fit_packing", packing)]

#: No stage but the second can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents`` of ``sf_dir``."""
    folder = f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        where = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(where)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(where), where
    return docs
