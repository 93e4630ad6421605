"""Vectors as arrays of numbers: products, norms, quantisation, test embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sondera.functions.text import bound


def dot(a: Column, b: Column) -> Column:
    """The inner product, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """The length of a vector."""
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 if one has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    """A vector at length 1; one without length stays."""
    scaled = lambda b: F.transform(b["v"], lambda x: x.cast("double") / b["n"])
    sized = lambda w: F.struct(w.alias("v"), F.coalesce(F.nullif(norm(w), F.lit(0.0)), F.lit(1.0)).alias("n"))
    return bound(bound(v, sized), scaled)


def hash_embedding(text: Column, dimensions: int) -> Column:
    """A deterministic unit vector from the bytes of a text's digest, for tests."""
    byte = lambda d: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.conv(F.substring(d, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2.0 - 1.0)
    return unit(bound(F.sha2(F.coalesce(text, F.lit("")), 256), byte))


def sign_bits(v: Column, dimensions: int) -> Column:
    """One bit for each number, set if it is positive, in words of 32 bits."""
    words = []
    for start in range(0, dimensions, 32):
        part = F.slice(v, start + 1, 32)
        words.append(F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0)))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    """In how many bits two arrays of words differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
