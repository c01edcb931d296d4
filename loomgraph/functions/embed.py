"""Vectors: the offline embedder, norms and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.textops import tokens

DIM = 16


def with_embedding(df: DataFrame, text: Column | str, out: str = "vec", dim: int = DIM) -> DataFrame:
    """``df`` with a deterministic stand-in for an embedding service: the sum of word vectors read off the hex digits of the words' MD5.

    Unit length, double; null for texts without words. At most 32 components. Stays in the JVM. Each step is a
    projection of its own, as an expression used inside a lambda would be evaluated for every element.
    """
    if dim > 32:
        raise ValueError("a digest has 32 digits")

    def component(j: int) -> Column:
        return F.aggregate("_h", F.lit(0.0), lambda a, h: a + F.instr(F.lit("0123456789abcdef"), F.substring(h, j + 1, 1)) - F.lit(8.5))

    hashed = df.withColumn("_h", F.transform(tokens(text), F.md5))
    raw = hashed.withColumn("_v", F.when(F.size("_h") > 0, F.array(*[component(j) for j in range(dim)]))).drop("_h")
    return with_unit(raw, "_v", out).drop("_v")


def with_unit(df: DataFrame, vec: str, out: str) -> DataFrame:
    """``df`` with the vector at unit length, double; null for a null or zero vector."""
    n = F.col("_n")
    return df.withColumn("_n", norm(vec)).withColumn(out, F.when(n > 0, F.transform(vec, lambda x: x.cast("double") / n))).drop("_n")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    """Euclidean length in double."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
