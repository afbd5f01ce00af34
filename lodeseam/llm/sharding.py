"""Sharding by jump consistent hashing, with DataFrame functions only.

The published generator (a 64-bit linear congruence) jumps from shard to shard without any ring table; when a
shard is appended, a row either stays or moves into the new shard. The 64-bit products are built from 16 and 32-bit limbs,
so that no step overflows under ANSI arithmetic, and shards for ``n`` and ``n + 1`` come from one walk.

Cases: a null key counts as 0; negative keys are read as unsigned; rows with equal keys share a shard; a null text has no
bytes (size 1) and CRC 0; repeated rows get slots of their own; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm.common import gapless_numbers, table

SHARDS = 8
_MULTIPLIER = 2862933555777941757
_MASK = (1 << 32) - 1


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Halves of ``key * multiplier + 1`` modulo 2**64; every intermediate stays under 2**63."""
    mh, ml = F.lit(_MULTIPLIER >> 32), F.lit(_MULTIPLIER & _MASK)
    low0 = (lo.bitwiseAND(F.lit(0xFFFF))) * ml
    low1 = F.shiftright(lo, 16) * ml
    low = low0 + F.shiftleft(low1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    cross = (hi.bitwiseAND(F.lit(0xFFFF))) * ml + F.shiftleft((F.shiftright(hi, 16) * ml).bitwiseAND(F.lit(0xFFFF)), 16)
    high = F.shiftright(low, 32) + F.shiftright(low1, 16) + (lo * mh).bitwiseAND(F.lit(_MASK)) + cross.bitwiseAND(F.lit(_MASK))
    return high.bitwiseAND(F.lit(_MASK)), low.bitwiseAND(F.lit(_MASK))


def jump_hash(key: Column, shards: int) -> Column:
    """``struct(shard, grown_shard)``: the bucket of the long ``key`` among ``shards`` and among ``shards + 1``."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_MASK)).alias("lo"),
        F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("g"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        # the top 31 bits of the key give the next jump
        j = F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        going = s["j"] <= shards
        return F.struct(
            F.when(going, hi).otherwise(s["hi"]).alias("hi"), F.when(going, lo).otherwise(s["lo"]).alias("lo"),
            F.when(going, j).otherwise(s["j"]).alias("j"),
            F.when(going & (j < shards), j).otherwise(s["b"]).alias("b"),
            F.when(going & (j <= shards), j).otherwise(s["g"]).alias("g"),
        )

    walk = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return F.struct(walk["b"].cast("int").alias("shard"), walk["g"].cast("int").alias("grown_shard"))


def assign_shards(df: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """``df`` with ``shard`` and ``grown_shard``; a string key is hashed to 64 bits first. No shuffle."""
    column = F.col(key)
    if dict(df.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        column = F.xxhash64(column)
    return df.drop("shard", "grown_shard").withColumn("_ls_jump", jump_hash(column, shards)).select("*", "_ls_jump.shard", "_ls_jump.grown_shard").drop("_ls_jump")


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = gapless_numbers(assign_shards(docs, "doc_id", SHARDS), ["shard"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
