"""Cutting the lineage of iterative plans so that a lost executor costs one round."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a session on one machine that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="lattix-checkpoint-")


class CachedCopy:
    """A frame as it was when it was read; ``refresh`` reads it anew."""

    def __init__(self, read: Callable[[], DataFrame]):
        self.read = read
        self.refresh()

    def refresh(self) -> DataFrame:
        self.value = durable(self.read())
        return self.value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
