"""Reports how well search finds what it should.

Whoever changes chunks, terms or ranking needs figures before and after. This job asks every question of a benchmark over all documents (BM25 over the index terms), takes as relevant the documents that hold the question's passage, and
writes per question nDCG@10, recall, success@10 and reciprocal rank, plus the run itself in the lines that evaluation tools read. Output is partitioned by ``run`` (a label, one per index or day) and, for figures, by ``metric``; a label
that is written again replaces its own partitions and no others, so reports can be compared by label and a rerun gives the same files' rows.

Only terms of the questions are counted and shuffled; questions are sent to all tasks in parts of a bounded size. Questions without a relevant document have no figures; null texts hold nothing.
"""

from __future__ import annotations

import sys

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main
from lodeseam.operators import evaluation, retrieval
from lodeseam.sources.files import spread

OPTIONS = ["documents", "questions", "output", "label", "depth"]
METRICS = ("ndcg", "recall", "success", "mrr")
#: The part of a question's text that a relevant document holds: first character (from 1) and length.
PASSAGE_FROM, PASSAGE_LENGTH = 20, 60


def passages(questions: DataFrame) -> DataFrame:
    """``(qid, passage)`` of the questions that are long enough to have one."""
    found = questions.select(F.col("item_id").alias("qid"), F.substring("text", PASSAGE_FROM, PASSAGE_LENGTH).alias("passage"))
    return found.where(F.length("passage") == PASSAGE_LENGTH)


def run(spark: SparkSession, documents: str, questions: str, output: str, label: str, depth: int | str = 100) -> dict:
    """Writes figures of search quality and the run behind them, under a label."""
    docs = spread(spark.read.parquet(documents).select(F.col("doc_id").cast("string").alias("id"), "text", "n_chars")).persist(StorageLevel.DISK_ONLY)  # dealt once, for all that reads it
    try:
        return _report(spark, docs, spark.read.parquet(questions), output, label, int(depth))
    finally:
        docs.unpersist()


def _report(spark: SparkSession, docs: DataFrame, asked: DataFrame, output: str, label: str, depth: int) -> dict:
    queries = asked.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    grades = evaluation.passage_judgements(docs, passages(asked)).withColumn("grade", F.when(F.col("n_chars") % 2 == 0, 2).otherwise(1))
    found = retrieval.search_text(docs, queries, depth).select("qid", F.col("id").alias("did"), "rank", "score")
    # the run is written first and read again, so that both outputs are of one search
    _write(evaluation.trec_run(found, label).withColumn("run", F.lit(label)), f"{output}/trec", ["run"])
    line = F.split("value", " ")
    written = spark.read.schema("value string, run string").parquet(f"{output}/trec").where(F.col("run") == label)
    again = written.select(line[0].cast(queries.schema["qid"].dataType).alias("qid"), line[2].alias("did"), line[3].cast("int").alias("rank"))
    figures = evaluation.per_query(again, grades.select("qid", "did", "grade"))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m).cast("double"), 5).alias("value")) for m in METRICS])).alias("f")
    _write(figures.select("qid", pairs).select("qid", "f.value", F.lit(label).alias("run"), "f.metric"), f"{output}/figures", ["run", "metric"])
    out = read_output(spark, output).where(F.col("run") == label)
    means = {r.metric: r.mean for r in out.groupBy("metric").agg(F.round(F.avg("value"), 5).alias("mean")).collect()}
    done = {"documents": docs.count(), "questions": queries.count(), "lines": written.count(), **means}
    log.info("quality_report %s: read %d documents and %d questions, wrote %d lines and figures %s", label, done["documents"], done["questions"], done["lines"], means)
    return done


def _write(frame: DataFrame, folder: str, by: list[str]) -> None:
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def read_output(spark: SparkSession, output: str) -> DataFrame:
    """The figures of all labels."""
    return spark.read.schema("qid long, value double, run string, metric string").parquet(f"{output}/figures")


if __name__ == "__main__":
    main(run, "quality_report", OPTIONS, sys.argv[1:])
