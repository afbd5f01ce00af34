"""Helpers that several operators share: tables, durable lineage cuts, gapless numbers, components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeseam.sources.files import shared_folder, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


#: Lets go of an execution's shuffle files when it ends; nothing reads them once its result is checkpointed.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the folder that all executors share.

    The folder is the one named by ``spark.checkpoint.dir``; a session without it (tests, a laptop)
    gets a folder of its own. A lost executor loses nothing of the result.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, which takes the setting over
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def gapless_numbers(df: DataFrame, groups: list[str], name: str, rows_per_block: int = 100_000) -> DataFrame:
    """Add ``name``: numbers from 0 without gaps inside each group of ``groups`` (any order).

    A group may hold any share of the rows: each group is cut into blocks of about
    ``rows_per_block`` rows by the hash of a row number, blocks are numbered on their own, and
    the sizes of the blocks before are added. The row number is stable because the rows are checkpointed first.
    """
    df = durable(df).withColumn("_ls_uid", F.monotonically_increasing_id())
    blocks = max(1, math.ceil(df.count() / rows_per_block))
    df = df.withColumn("_ls_block", F.pmod(F.xxhash64("_ls_uid"), F.lit(blocks)).cast("int"))
    keys = [*groups, "_ls_block"]
    before = Window.partitionBy(*groups).orderBy("_ls_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ls_n"))
        .withColumn("_ls_offset", F.coalesce(F.sum("_ls_n").over(before), F.lit(0)))
        .drop("_ls_n")
    )
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("_ls_uid"))
    numbered = df.withColumn("_ls_row", within.cast("long")).join(offsets, keys)
    return numbered.withColumn(name, F.col("_ls_row") - 1 + F.col("_ls_offset")).drop("_ls_uid", "_ls_block", "_ls_row", "_ls_offset")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for each node of the undirected ``edges`` (columns ``a``, ``b``, longs); root: the smallest node reachable.

    Large-star and small-star rounds take turns until the edges stay the same; each is a minimum per
    node (combined before its shuffle) joined back, so no neighbourhood is gathered anywhere. Every
    round is checkpointed. The number of rounds is logarithmic in the number of nodes.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = durable(small.unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
