"""Synthetic inputs. The same seed gives the same rows however they are partitioned: each value is a hash of its row's number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, stream: int, row: Column | None = None) -> Column:
    """A number of [0, 1) for each row."""
    h = F.xxhash64(F.lit(seed), F.lit(stream), F.col("id") if row is None else row)
    return F.pmod(h, F.lit(1 << 40)) / float(1 << 40)


def symmetric(seed: int, stream: int) -> Column:
    return 2 * uniform(seed, stream) - 1


def autoencoder(spark: SparkSession, n: int, variance: float = 0.01, linear: bool = True, seed: int = 0) -> DataFrame:
    """(id, x0, x1): t within 2.2 of 0 and t or its cube, both with noise of the given width."""
    t = 2.2 * symmetric(seed, 0)
    rows = spark.range(n).withColumn("t", t)
    second = F.col("t") if linear else F.col("t") * F.col("t") * F.col("t")
    return rows.select("id", (F.col("t") + variance * symmetric(seed, 1)).alias("x0"), (second + variance * symmetric(seed, 2)).alias("x1"))


# The truth table with 0.1 for false and 0.9 for true.
XOR = [(0.1, 0.1, 0.1), (0.1, 0.9, 0.9), (0.9, 0.1, 0.9), (0.9, 0.9, 0.1)]


def xor(spark: SparkSession, groups: int, variance: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, x0, x1, y0): the truth table once for each group, each number with noise of [0, variance)."""
    table = F.array(*[F.array(*[F.lit(x) for x in r]) for r in XOR])
    row = F.element_at(table, (F.col("id") % 4 + 1).cast("int"))
    return spark.range(4 * groups).select("id", *[(row[i] + variance * uniform(seed, i)).alias(c) for i, c in enumerate(("x0", "x1", "y0"))])


def categories(spark: SparkSession, n: int, cardinalities: list[int], classes: int, seed: int = 0) -> DataFrame:
    """(id, class, a0, a1, ...)."""
    pick = lambda stream, size: F.floor(uniform(seed, stream) * size).cast("int")
    return spark.range(n).select("id", pick(0, classes).alias("class"), *[pick(i + 1, v).alias(f"a{i}") for i, v in enumerate(cardinalities)])


def integers(spark: SparkSession, n: int, below: int, seed: int = 0) -> DataFrame:
    """(id, v)."""
    return spark.range(n).select("id", F.floor(uniform(seed, 0) * below).cast("int").alias("v"))


def examples(spark: SparkSession, n: int, columns: int, seed: int = 0) -> DataFrame:
    """(id, x0, x1, ...) uniform in [0, 1)."""
    return spark.range(n).select("id", *[uniform(seed, i).alias(f"x{i}") for i in range(columns)])
