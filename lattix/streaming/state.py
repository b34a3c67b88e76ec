"""Keyed streaming state, load exchange, and consuming until empty.

Every query here runs with ``trigger(availableNow=True)``: it takes what is there,
in micro-batches, and ends when nothing is outstanding.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lattix.operators.balance import migrate_default
from lattix.plans.lineage import shared_folder


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def work_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share; machine-local only where no shared one is set."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(query_df: DataFrame, each_batch: Callable[[DataFrame, int], None], mode: str = "update", folder: str | None = None) -> None:
    """Run to the end of the input, each micro-batch through ``each_batch``."""
    folder = folder or work_folder(query_df.sparkSession)
    writer = query_df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(each_batch).start()
    query.awaitTermination()


def keyed_modify(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running count and sum of each key: state held by the engine, one row a changed key and batch."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def final_state(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's state once the input is drained; a later batch's row replaces an earlier one (last write wins)."""
    spark = stream.sparkSession
    folder = work_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/state/part={number}")

    drain(keyed_modify(stream, key, value), keep, "update", folder)
    seen = spark.read.parquet(f"{folder}/state").drop("part")
    return seen.groupBy(key).agg(F.max_by(F.struct("n", "total"), "batch").alias("s")).select(key, "s.n", "s.total")


def user_state(stream: DataFrame, key: str, value: str, fn: Callable[[int, int], int], start: int) -> DataFrame:
    """State of each key by a user's function of (state, value), once the input is drained: (key, state, updates).

    The function runs on the executors, on each key's new values of a batch as they come, so it
    must not depend on their order (``ordered_state`` takes any); the engine keeps the state.
    """
    spark = stream.sparkSession
    folder = work_folder(spark)
    kind = stream.schema[key].dataType.simpleString()

    def step(keys, frames, state):
        held, n = state.get if state.exists else (start, 0)
        for frame in frames:
            for v in frame[value]:
                held, n = fn(held, int(v)), n + 1
        state.update((held, n))
        yield pd.DataFrame({key: [keys[0]], "state": [held], "updates": [n]})

    changes = stream.select(key, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state bigint, updates bigint", "state bigint, updates bigint", "update", "NoTimeout")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/state/part={number}")

    drain(changes, keep, "update", folder)
    seen = spark.read.parquet(f"{folder}/state").drop("part")
    return seen.groupBy(key).agg(F.max_by(F.struct("state", "updates"), "batch").alias("s")).select(key, "s.state", "s.updates")


class _OrderedFold(StatefulProcessor):
    """A key's state as folded up to the watermark, and the later updates, which may still be preceded by others."""

    def __init__(self, key: str, fn: Callable[[int, int], int], start: int):
        self.key, self.fn, self.start = key, fn, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", "state bigint, updates bigint")
        self.later = handle.getListState("later", "at bigint, tie bigint, value bigint")

    def _held(self) -> tuple[tuple[int, int], list[tuple]]:
        folded = tuple(self.folded.get()) if self.folded.exists() else (self.start, 0)
        return folded, sorted(tuple(r) for r in self.later.get()) if self.later.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        folded, later = self._held()
        new = [r for frame in rows for r in zip(frame["at"].tolist(), frame["tie"].tolist(), frame["value"].tolist(), strict=True)]
        later = sorted(later + new)
        self.later.put(later)
        self.handle.registerTimer(later[-1][0] // 1000 + 1)  # milliseconds
        state, n = folded
        for _, _, v in later:
            state, n = self.fn(state, v), n + 1
        yield pd.DataFrame({self.key: [key[0]], "state": [state], "updates": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing earlier than the watermark can come any more: what lies before it is folded for good and forgotten."""
        (state, n), later = self._held()
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        for _, _, v in (r for r in later if r[0] < upto):
            state, n = self.fn(state, v), n + 1
        self.folded.update((state, n))
        rest = [r for r in later if r[0] >= upto]
        if rest:
            self.later.put(rest)
        else:
            self.later.clear()
        yield pd.DataFrame({self.key: pd.Series([], dtype="int64"), "state": pd.Series([], dtype="int64"), "updates": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def ordered_state(
    stream: DataFrame, key: str, time: str, tie: str, value: str, fn: Callable[[int, int], int], start: int, lateness: str
) -> DataFrame:
    """State of each key by a user's function, applied in the order (``time``, ``tie``) whatever order updates arrive in: (key, state, updates), once drained.

    Updates that are younger than the watermark (the largest time less ``lateness``) are
    held as a list; a timer folds them for good once the watermark has passed them, so a
    key's state doesn't grow with its history.  Updates that come later than the watermark
    are dropped, as in any such stream.  Key, tie and value are bigint; times without zone are taken as UTC.
    """
    spark = stream.sparkSession
    folder = work_folder(spark)
    provider, option = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(option)
    timed = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", lateness)
    rows = timed.select(F.col(key).cast("bigint").alias(key), "_time", F.unix_micros("_time").alias("at"), F.col(tie).cast("bigint").alias("tie"), F.col(value).cast("bigint").alias("value"))
    fold = _OrderedFold(key, fn, start)
    changes = rows.groupBy(key).transformWithStateInPandas(fold, f"{key} bigint, state bigint, updates bigint", "Update", "EventTime")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/state/part={number}")

    spark.conf.set(option, provider)
    try:
        drain(changes, keep, "update", folder)
    finally:
        spark.conf.set(option, before)
    seen = spark.read.parquet(f"{folder}/state").drop("part")
    return seen.groupBy(key).agg(F.max_by(F.struct("state", "updates"), F.struct("batch", "updates")).alias("s")).select(key, "s.state", "s.updates")


def answered(stream: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A request loop: each request of the stream gets its answer by a function without state; all answers, once drained."""
    spark = stream.sparkSession
    folder = work_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/answers/part={number}")

    drain(answer(stream), keep, "append", folder)
    return spark.read.parquet(f"{folder}/answers").drop("part")


def consumed(stream: DataFrame) -> DataFrame:
    """Rows of each micro-batch until the input is empty: (batch, taken)."""
    spark = stream.sparkSession
    folder = work_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.agg(F.count("*").alias("taken")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/taken/part={number}")

    drain(stream, keep, "append", folder)
    return spark.read.parquet(f"{folder}/taken").drop("part")


def windowed_counts(stream: DataFrame, time: str, lateness: str, width: str, by: list[str]) -> DataFrame:
    """Tumbling counts with a watermark (an extension); times without zone are taken as UTC."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return timed.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def load_exchange(stream: DataFrame, rank: str, load: str) -> DataFrame:
    """Decisions of a load exchange: after each batch, if the outstanding sum changed, who gives how much to whom.

    Each batch's sum is written beside the decisions, so a restarted query compares with the batch before and decides once.
    """
    spark = stream.sparkSession
    folder = work_folder(spark)
    sums = "batch int, total bigint"

    def decide(batch: DataFrame, number: int) -> None:
        loads = batch.select(F.col(rank).alias("rank"), F.col(load).alias("load"))
        total = loads.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
        seen = spark.read.schema(sums).parquet(f"{folder}/totals").filter(F.col("batch") < number) if number else spark.createDataFrame([], sums)
        before = seen.agg(F.max_by("total", "batch")).first()[0]
        changed = migrate_default(loads).filter(F.lit(total != before))
        changed.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/moves/part={number}")
        spark.createDataFrame([(number, total)], sums).write.mode("overwrite").parquet(f"{folder}/totals/part={number}")

    drain(stream.groupBy(rank).agg(F.sum(load).alias(load)), decide, "complete", folder)
    return spark.read.parquet(f"{folder}/moves").drop("part")


def batch_statistics(stream: DataFrame, value: str) -> DataFrame:
    """count, min, max and sum of each micro-batch: statistics start afresh with every cycle."""
    spark = stream.sparkSession
    folder = work_folder(spark)

    def measure(batch: DataFrame, number: int) -> None:
        v = F.col(value)
        one = batch.agg(F.count(v).alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.sum(v).alias("sum_value"))
        one.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/stats/part={number}")

    drain(stream, measure, "append", folder)
    return spark.read.parquet(f"{folder}/stats").drop("part")
