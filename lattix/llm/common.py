"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only a session on one machine that names none gets a temporary folder; on a cluster
    that is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="lattix-checkpoint-")


def durable(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, of at most ``parts`` files."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder: smaller than a checkpoint, and read by column."""
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def parts_for(rows: int, width: int) -> int:
    """Partitions for so many rows of so many bytes: about 32 MB each, 8 at least."""
    return max(8, -(-rows * width // (32 << 20)))


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Hint a broadcast only if a count proves that ``df`` has ``max_rows`` rows at most.

    Beyond the bound the frame comes back without a hint, so the join shuffles.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df), True
    return df, False


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  For short strings; whole texts go through Arrow's ascii_lower."""
    return F.translate(c, UPPER, LOWER)


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fresh_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` behind a derived key that neither side is partitioned by yet.

    Both sides then get an exchange of their own directly under the join, which is
    what adaptive execution needs to split a hot key of ``left`` over many tasks.
    """
    key = F.xxhash64(*on, F.lit(7))
    return left.withColumn("_k", key).join(right.withColumn("_k", key), ["_k", *on], how).drop("_k")


def let(value: Column, body) -> Column:
    """Bind an expression to a lambda variable, so that it is evaluated once a row."""
    return F.transform(F.array(value), body)[0]
