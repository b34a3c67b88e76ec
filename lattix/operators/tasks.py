"""Life of tasks: numbers are given by rank in order of creation, and a task is finished once it is listed so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.operators.ordered import positions
from lattix.operators.queues import encode_task, task_index, task_owner


def last_ids(tasks: DataFrame) -> DataFrame:
    """The last task id of each rank that has one: (rank, last_id)."""
    return tasks.groupBy(task_owner(F.col("task")).alias("rank")).agg(F.max("task").alias("last_id"))


def create(tasks: DataFrame, new: DataFrame, rank: str, order: list[str]) -> DataFrame:
    """``new`` with a ``task`` id each, going on from the last id of its rank in ``tasks``."""
    last = last_ids(tasks).select(F.col("rank").alias(rank), (task_index(F.col("last_id")) + 1).alias("_next"))
    placed = positions(new, [rank], order, "_k").join(last, rank, "left")
    return placed.withColumn("task", encode_task(F.col(rank), F.coalesce("_next", F.lit(0)) + F.col("_k"))).drop("_k", "_next")


def finished(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """``tasks`` with whether ``done`` lists each."""
    return tasks.join(done.select("task").distinct().withColumn("finished", F.lit(True)), "task", "left").withColumn("finished", F.coalesce("finished", F.lit(False)))
