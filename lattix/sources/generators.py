"""Deterministic inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def constant_matrix(spark: SparkSession, m: int, n: int, value: float = 0.0) -> DataFrame:
    return _cells(spark, m, n).select("i", "j", F.lit(float(value)).alias("v"))


def modulo_matrix(spark: SparkSession, m: int, n: int, bound: int) -> DataFrame:
    return _cells(spark, m, n).select("i", "j", ((F.col("i") * n + F.col("j")) % bound).cast("double").alias("v"))


def random_matrix(spark: SparkSession, m: int, n: int, seed: int = 0) -> DataFrame:
    """Uniform in [0, 1), from a hash of the place: the same whatever the partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64("i", "j", F.lit(seed)), 11).cast("double")
    return _cells(spark, m, n).select("i", "j", (bits / float(1 << 53)).alias("v"))


def _cells(spark: SparkSession, m: int, n: int) -> DataFrame:
    return spark.range(m * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"))


def linspace(spark: SparkSession, start: float, stop: float, n: int) -> DataFrame:
    """``n`` evenly spaced values; the end is excluded."""
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(float(start)) + F.col("id") * ((stop - start) / n)).alias("x"))


def sine_series(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    # from a hash of the place: the same whatever the partitioning
    jitter = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") / float(1 << 53) * noise if noise else F.lit(0.0)
    x = F.col("id").cast("double")
    return spark.range(n).select(x.alias("x"), ((F.sin(x) + 1) * 10 + 2 * x + jitter).alias("y"))


def random_points(spark: SparkSession, n: int, bound: int = 500, seed: int = 0) -> DataFrame:
    """Integer points in [-bound, bound)."""
    axis = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(2 * bound)) - bound).cast("double")
    return spark.range(n).select("id", axis(1).alias("x"), axis(2).alias("y"))


def random_text(spark: SparkSession, n: int, length: int, seed: int = 0) -> DataFrame:
    letters = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda k: F.chr(F.lit(97) + F.pmod(F.xxhash64("id", k, F.lit(seed)), F.lit(26))))
    return spark.range(n).select("id", F.array_join(letters, "").alias("text"))
