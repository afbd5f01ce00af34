"""Line dedup by site-relative frequency, with DataFrame functions only.

A line's share is the number of a host's documents that contain it, divided by the number of the
host's documents. Lines whose share exceeds ``ratio`` are boilerplate of that host and are dropped from its documents. A line that
fewer than ``min_pages`` documents (two) have does not repeat, whatever its share; hosts of ``min_pages / ratio`` documents or more are judged by the ratio alone. A document of which no line would be
left is no page with boilerplate but a copy of others on a small host, which near-dedup is for: it keeps its lines.

Scale: each document gives each of its distinct lines once, as a 16-byte digest; counts are combined before
the shuffle, so a line in a third of all rows is no hot key. A host keeps at most
``(mean distinct lines per document) / ratio`` boilerplate digests. If all hosts together have at most ``BROADCAST_DIGESTS`` (counted), the
table is broadcast and no text is shuffled; else an equi-join on host and a salt takes them to the documents.

Cases: a null text stays null with 0 lines; an empty text has one blank line; blank lines are never counted nor dropped; lines
are compared after trimming spaces, tabs and carriage returns; a null host is a host of its own; repeated rows count as
documents of their own; other columns pass through, save that ``n_lines`` and ``n_dropped`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm.common import durable, table

RATIO = 0.05
MIN_PAGES = 2
BROADCAST_DIGESTS = 500_000
#: Parts that each host's documents are dealt to where digests are too many to broadcast.
SALTS = 64
_EDGES = " \t\r"


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line, F.lit(_EDGES))))


def _blank(line: Column) -> Column:
    return F.trim(line, F.lit(_EDGES)) == ""


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, digests)``: the digests of each host's boilerplate lines."""
    own = docs.select(F.col(host).alias("_ls_host"), F.split(F.col(text), "\n").alias("_ls_lines"))
    digests = F.array_distinct(F.transform(F.filter("_ls_lines", lambda x: ~_blank(x)), _digest))
    counts = (
        own.select("_ls_host", F.explode(digests).alias("_ls_digest"))
        .groupBy("_ls_host", "_ls_digest").agg(F.count(F.lit(1)).alias("_ls_pages"))
        .where(F.col("_ls_pages") >= min_pages)
    )
    totals = own.groupBy("_ls_host").agg(F.count(F.lit(1)).alias("_ls_total")).withColumnRenamed("_ls_host", "_ls_owner")
    frequent = counts.join(totals, F.col("_ls_host").eqNullSafe(F.col("_ls_owner"))).where(F.col("_ls_pages") > ratio * F.col("_ls_total"))
    return frequent.groupBy("_ls_host").agg(F.collect_set("_ls_digest").alias("_ls_digests"))


def drop_boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text``, plus ``n_lines`` and ``n_dropped`` (long)."""
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    known = durable(boilerplate(docs, host, text, ratio, min_pages))
    size = known.agg(F.sum(F.size("_ls_digests"))).first()[0] or 0
    same = F.col(host).eqNullSafe(F.col("_ls_host"))
    if size <= BROADCAST_DIGESTS:
        known = F.broadcast(known)
    else:
        docs = docs.withColumn("_ls_salt", F.pmod(F.xxhash64(text), F.lit(SALTS)))
        known = known.withColumn("_ls_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        same = same & (F.col("_ls_salt") == F.col("_ls_part"))
    lines = F.split(F.col(text), "\n")
    kept = F.when(F.col("_ls_digests").isNull(), lines).otherwise(F.filter(lines, lambda x: _blank(x) | ~F.array_contains("_ls_digests", _digest(x))))
    joined = docs.join(known, same, "left").withColumn("_ls_kept", kept)
    joined = joined.withColumn("_ls_kept", F.when(F.forall("_ls_kept", _blank), lines).otherwise(F.col("_ls_kept")))
    return joined.select(
        *[F.array_join("_ls_kept", "\n").alias(text) if c == text else F.col(c) for c in names],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size("_ls_kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


OP1_SQL = f"""
WITH own AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
counts AS (
  SELECT source, line, count(*) AS pages
  FROM (SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS line FROM own)
  WHERE line <> '' GROUP BY ALL),
totals AS (SELECT source, count(*) AS total FROM own GROUP BY source),
known AS (
  SELECT c.source, list(c.line) AS frequent FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.pages >= {MIN_PAGES} AND c.pages > {RATIO} * t.total GROUP BY c.source),
cut AS (
  SELECT o.doc_id, o.source, o.lines,
    list_filter(o.lines, lambda x: NOT list_contains(coalesce(k.frequent, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept
  FROM own o LEFT JOIN known k ON o.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, source, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped,
  CASE WHEN lines IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text
FROM (SELECT doc_id, source, lines, CASE WHEN len(list_filter(kept, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) = 0 THEN lines ELSE kept END AS kept FROM cut)
"""
