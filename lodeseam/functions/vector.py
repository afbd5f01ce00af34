"""Vector functions as Column expressions."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector."""
    return F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def encode_f32(values: list[float]) -> bytes:
    return struct.pack(f"<{len(values)}f", *values)


def decode_f32(blob: bytes, dimensions: int) -> list[float] | None:
    """The vector of a cache entry, or None if its length is wrong."""
    return list(struct.unpack(f"<{dimensions}f", blob)) if len(blob) == 4 * dimensions else None
