"""Comma-separated text: scans by declared names and by lenient numbers, and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattix.functions.scalar import csv_cells, lenient_float


def log_schema(n_bounds: int = 48) -> T.StructType:
    """tid, bnd_s1 .. bnd_s<n>, target: all double."""
    names = ["tid", *[f"bnd_s{k}" for k in range(1, n_bounds + 1)], "target"]
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def read_named_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """No header; columns by declared name and type, so nothing is inferred."""
    return spark.read.schema(schema).option("header", False).csv(path)


def read_number_csv(spark: SparkSession, path: str) -> DataFrame:
    """One row a line after each file's first: cells (array<double>), text that isn't a number being 0.  Blank lines are skipped.

    The CSV source drops the header by its place; with a separator that no text holds, it leaves the line whole.
    """
    whole = spark.read.schema("value string").option("header", True).option("sep", "\x01").option("quote", "").option("enforceSchema", True)
    rows = whole.csv(path).filter("value is not null")
    return rows.select(F.transform(csv_cells(F.col("value")), lenient_float).alias("cells"))


def write_lines(df: DataFrame, path: str, *columns: str, separator: str = " ") -> None:
    df.select(F.concat_ws(separator, *[F.col(c).cast("string") for c in columns])).write.mode("overwrite").text(path)


def write_statistics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
