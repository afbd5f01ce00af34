"""The jobs as queries: each runs twice over the whole tables into one new folder, and gives the output as it then stands; with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import embedding_worklist, quality_report
from lodeseam.queries import ORACLES as ENGINE_SQL
from lodeseam.queries.evaluate import EVAL_SQL
from lodeseam.queries.ingest import redact_sql
from lodeseam.sources.files import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_embedding_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "embedding_worklist")
    for _ in range(2):
        embedding_worklist.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output", f"{folder}/checkpoint")
    return embedding_worklist.read_output(spark, f"{folder}/output")


def job2_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "quality_report")
    for _ in range(2):
        quality_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{folder}/output", "whole")
    return quality_report.read_output(spark, f"{folder}/output")


QUERIES = {f.__name__: f for f in (job1_embedding_worklist, job2_quality_report)}
ORACLES = {
    # the chunks of the engine's query, with their text
    "job1_embedding_worklist": ENGINE_SQL["chunk_greedy_merge"].rpartition("SELECT substring(sha256(path")[0]
    + f"SELECT DISTINCT sha256(text) AS key, text, length(text)::INT AS n_chars, 'x' || substring(sha256(text), 1, 1) AS shard FROM (SELECT {redact_sql('raw')} AS text FROM c)",
    "job2_quality_report": f"""{EVAL_SQL} SELECT qid, round(value, 5) AS value, 'whole' AS run, metric
FROM (SELECT qid, ndcg::DOUBLE AS ndcg, recall::DOUBLE AS recall, success::DOUBLE AS success, mrr::DOUBLE AS mrr FROM figures) UNPIVOT (value FOR metric IN (ndcg, recall, success, mrr))""",
}
