"""Change gates, differences and keyed writes as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_by_stat(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose size or time differs from the manifest's, or that it lacks. ``files``: path, size, mtime_ms."""
    known = manifest.select("path", F.col("size").alias("_size"), F.col("mtime_ms").alias("_mtime"))
    return files.join(known, "path", "left").where(~(F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime_ms").eqNullSafe(F.col("_mtime")))).drop("_size", "_mtime")


def changed_by_content(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` (path, file_hash, ...) with ``changed``: whether the content differs from the manifest's."""
    known = manifest.select("path", F.col("file_hash").alias("_hash"))
    return files.join(known, "path", "left").withColumn("changed", ~F.col("file_hash").eqNullSafe(F.col("_hash"))).drop("_hash")


def missing_from(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks: chunks to embed, chunks or files to delete."""
    return left.join(right.select(on).distinct(), on, "left_anti")


def chunk_ids(manifest: DataFrame) -> DataFrame:
    return manifest.select("path", F.explode("chunk_ids").alias("id"))


def upsert(rows: DataFrame, new: DataFrame, on: str = "id") -> DataFrame:
    """``rows`` with those of ``new`` in place of rows with the same key."""
    return missing_from(rows, new, on).unionByName(new, allowMissingColumns=True)


def delete_where(rows: DataFrame, predicate) -> DataFrame:
    """Rows for which ``predicate`` is false or unknown."""
    return rows.where(~F.coalesce(predicate, F.lit(False)))


def replace_paths(rows: DataFrame, new: DataFrame, paths: DataFrame) -> DataFrame:
    """All rows of ``paths`` gone and ``new`` put in, as one change."""
    return missing_from(rows, paths, "path").unionByName(new, allowMissingColumns=True)


def wanted_vectors(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, vector)`` of the cache for ``keys`` (``key``), each once: the cache is cut down to them first, so that no more of it is shuffled."""
    return cache.select("key", "vector").join(keys.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])


def split_cached(texts: DataFrame, cache: DataFrame, dimensions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts (``id``, ``text``) with a cached vector, and the distinct ones without: ``(id, text, key, vector)`` and ``(key, text)``."""
    keyed = texts.withColumn("key", F.sha2("text", 256))
    usable = cache if dimensions is None else cache.where(F.size("vector") == dimensions)
    hits = keyed.join(wanted_vectors(usable, keyed), "key")
    misses = keyed.join(usable.select("key"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))
    return hits, misses


def index_stats(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.size("chunk_ids")), F.lit(0)).cast("long").alias("chunks"))
