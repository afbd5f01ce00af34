"""What the queries share: registration, and the test tables read as rows of an index (in Spark and in SQL)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.functions import text as T
from lodeseam.sources.files import parts_for, shared_folder
from lodeseam.store import IndexStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

QUERY = "Erst the thing, idiot ntly the onth"
SECOND_QUERY = "moron hant eren"
QUERY_VECTORS = (7, 12)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as index rows: sources, kinds, paths and what the other sources carry follow from the id."""
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    unit = d % 10
    source = F.when(unit.isin(6, 7), "docs").when(unit == 8, "history").when(unit == 9, "conversation").otherwise("code")
    kind = F.when(F.col("source") == "history", "commit").when(F.col("source").isin("docs", "conversation"), F.col("source")).when(d % 7 == 0, "test").otherwise("code")
    path = F.concat("source", F.lit("/"), "language", F.lit("/The_f"), (d % 40).cast("string"), F.lit(".ts"))
    history, talk = F.col("source") == "history", F.col("source") == "conversation"
    return (
        docs.select("doc_id", d.cast("string").alias("id"), source.alias("source"), F.col("lang").alias("language"), "text", F.col("n_chars").cast("long").alias("n_chars"))
        .withColumn("kind", kind).withColumn("path", path).withColumn("path_text", T.path_text(F.col("path")))
        .withColumn("symbol", F.when(d % 4 == 0, F.concat(F.lit("sym"), "id")).otherwise("")).withColumn("start_line", F.when(d % 3 == 0, 0).otherwise(d % 90).cast("int")).withColumn("end_line", F.when(d % 3 == 0, 0).otherwise(d % 90 + 5).cast("int"))
        .withColumn("sha", F.when(history, F.sha2("id", 256))).withColumn("committed_at", F.when(history & (d % 20 != 8), 1_600_000_000 + d * 86_400)).withColumn("author", F.when(history, F.col("language")))
        .withColumn("ts", F.when(talk, 1_500_000_000 + d * 86_400)).withColumn("role", F.when(talk, "turn"))
    )


ROWS = r"""rows AS (
  SELECT *, trim(regexp_replace(path, '[/_.\-]+', ' ', 'g')) AS path_text, CASE WHEN doc_id % 4 = 0 THEN 'sym' || id ELSE '' END AS symbol,
    CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 90 END::INT AS start_line, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 90 + 5 END::INT AS end_line,
    CASE WHEN source = 'history' THEN sha256(id) END AS sha, CASE WHEN source = 'history' AND doc_id % 20 <> 8 THEN 1600000000 + doc_id * 86400 END AS committed_at, CASE WHEN source = 'history' THEN language END AS author,
    CASE WHEN source = 'conversation' THEN 1500000000 + doc_id * 86400 END AS ts, CASE WHEN source = 'conversation' THEN 'turn' END AS role
  FROM (SELECT *, source || '/' || language || '/The_f' || (doc_id % 40)::VARCHAR || '.ts' AS path,
      CASE WHEN source = 'history' THEN 'commit' WHEN source IN ('docs', 'conversation') THEN source WHEN doc_id % 7 = 0 THEN 'test' ELSE 'code' END AS kind
    FROM (SELECT doc_id, doc_id::VARCHAR AS id, lang AS language, text, n_chars::BIGINT AS n_chars,
      CASE WHEN doc_id % 10 IN (6, 7) THEN 'docs' WHEN doc_id % 10 = 8 THEN 'history' WHEN doc_id % 10 = 9 THEN 'conversation' ELSE 'code' END AS source FROM documents)))"""


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, as a path that Python can open."""
    return f"{shared_folder(spark).removeprefix('file://').removeprefix('file:')}/query-{uuid.uuid4().hex}"


_PREPARED: dict[tuple[str, str], IndexStore] = {}


def prepared(spark: SparkSession, sf_dir: str) -> IndexStore:
    """The kept index over ``rows`` with their vectors, written by the first query of a session that asks for it: searches read it, as they do in use."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PREPARED:
        own, vectors = rows(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
        n = parts_for(own)  # partitions of a bounded size, whatever the session's number; only the vectors are hashed
        store = IndexStore(spark, f"{shared_folder(spark)}/prepared-{uuid.uuid4().hex}", "rows", sf_dir)
        store.commit(own.repartition(n, "doc_id").join(vectors.repartition(n, "doc_id").hint("shuffle_hash"), "doc_id", "left"))
        _PREPARED[key] = store
    return _PREPARED[key]


def write_files(contents: DataFrame, folder: str) -> int:
    """Writes ``contents`` (``path``, ``content``, ``mtime_s``) under a folder that all workers mount; the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for b in batches:
            for r in b.to_pylist():
                full = f"{folder}/{r['path']}"
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:
                    f.write((r["content"] or "").encode())
                os.utime(full, (r["mtime_s"], r["mtime_s"]))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return contents.select("path", "content", "mtime_s").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def with_vectors(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    base = rows(spark, sf_dir) if base is None else base
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return base.join(vectors, "doc_id")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def semantic_sql(name: str, vec_id: int, k: int, where: str = "TRUE") -> str:
    """CTE ``name(id, distance, rank)``."""
    return f"""{name} AS (
  SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS rank FROM (
    SELECT r.id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS distance
    FROM rows r JOIN embeddings e ON e.vec_id = r.doc_id CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) q WHERE {where})
  ORDER BY distance, id LIMIT {k})"""


def terms_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9_]+'), lambda x: length(x) <= 39)"


def bm25_sql(name: str, queries: str, k: int, source: str = "rows", text: str = "coalesce(text, '')", where: str = "TRUE") -> str:
    """CTEs up to ``name(qid, id, score, rank)``; ``queries`` is a relation of qid and query."""
    return f"""{name}_t AS (SELECT id, {terms_sql(text)} AS tokens FROM {source}),
{name}_p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM {name}_t) GROUP BY ALL),
{name}_l AS (SELECT id, len(tokens) AS length FROM {name}_t),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_f AS (SELECT count(*) AS n, avg(length) AS mean FROM {name}_l),
{name}_q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({terms_sql("query")}) AS term FROM {queries}) GROUP BY ALL),
{name}_s AS (
  SELECT qid, p.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))) * (qtf * 9.0 / (8.0 + qtf))), 9) AS score
  FROM {name}_q JOIN {name}_d USING (term) JOIN {name}_p p USING (term) JOIN {name}_l l ON l.id = p.id CROSS JOIN {name}_f WHERE p.id IN (SELECT id FROM {source} WHERE {where}) GROUP BY qid, p.id),
{name} AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {name}_s WHERE score > 0) WHERE rank <= {k})"""


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens_sql(text: str) -> str:
    """The query tokens of a text."""
    return f"list_filter(string_split_regex(lower({text}), '[^a-z0-9_.$/-]+'), lambda x: length(x) >= 2)[1:12]"
