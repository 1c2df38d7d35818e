"""Vector arithmetic with higher-order functions, and deterministic hash embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a vector is all zeros."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def hash_embedding(c: Column, size: int = 16) -> Column:
    """A unit vector from a text's SHA-256: components from -1 to 1 by 16-bit words, the digest repeated."""
    words = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda k: F.conv(F.substring(F.sha2(F.concat(c, F.lit("#"), F.floor(k / 16).cast("string")), 256), k % 16 * 4 + 1, F.lit(4)), 16, 10).cast("double") / 32767.5 - 1.0,
    )
    return unit(words)
