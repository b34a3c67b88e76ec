"""Exact deduplication by skew-safe combining.

Texts are equal when identical after lower-casing A-Z only; null counts as empty.
Three stages, each a hash aggregation whose key holds the *full* text, so that
content and not only digests is compared at every stage:

1. local: map-side combining leaves one row a text and input partition;
2. salted: (digest, salt, text), the salt being the input partition's number
   modulo ``salts``, so a text with copies everywhere meets in ``salts`` tasks;
3. global: the salts' winners of a text meet, ``salts`` rows a text at most.

The winners' ids then go back to every row through a join on narrow keys, whose
hot keys adaptive execution splits.

Edge cases: of equal texts the largest ``doc_id`` stays.  A null id counts in
``group_size`` but stays only if its group has no other id.  Rows that repeat an
id are one document, so all or none of them are kept.  Whole texts are compared,
however long (a text is one row).  An empty table gives an empty result.  Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_join


@F.arrow_udf(T.StringType())
def _normalised(text: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(text, ""))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = docs.select(F.col(id_col).alias("id"), _normalised(F.col(text_col).cast("string")).alias("norm"))
    # the digest is the group's key; the second fingerprint tells apart two texts of one digest in narrow rows
    return norm.withColumns({"digest": F.unhex(F.sha2("norm", 256)), "mark": F.xxhash64("norm")})


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row a distinct text: digest, mark, keep_id, group_size."""
    rows = _keyed(docs, id_col, text_col).withColumn("salt", F.spark_partition_id() % salts)
    salted = rows.groupBy("digest", "mark", "salt", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    whole = salted.groupBy("digest", "mark", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    classes = whole.groupBy("digest", "mark").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("texts")
    )
    # two texts with equal SHA-256 and equal xxhash64: refuse rather than merge them
    return classes.filter(
        F.when(F.col("texts") > 1, F.raise_error("different texts share both digests")).otherwise(F.lit(True)).cast("boolean")
    ).drop("texts")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256."""
    rows = _keyed(docs, id_col, text_col).drop("norm")
    out = fresh_join(rows, exact_classes(docs, id_col, text_col, salts), ["digest", "mark"], "left")
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
