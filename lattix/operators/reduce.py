"""Reductions and statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.operators.scans import Monoid, in_ranges, scan


def statistics(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """count, min, max, sum and mean (0 for no value)."""
    return df.groupBy(*(by or [])).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.sum(value).alias("sum_value"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean_value"),
    )


def reduce_ordered(df: DataFrame, order: str, value: str, zero: Column, fn: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """Left fold over all ranks' values in rank order, for functions that aren't commutative (one value a rank)."""
    rows = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.agg(F.aggregate(F.transform(rows, lambda s: s[value]), zero, fn).alias(out))


def reduce_monoid(df: DataFrame, by: list[str], order: list[str], state: dict[str, Column], combine: Monoid, identity: dict[str, int | float]) -> DataFrame:
    """``state`` of each group's rows combined in ``order``: one row a group (one in all with ``by=[]``, the identity for no rows).

    ``combine`` is associative but needn't commute (see ``scans``), so a group is cut into
    ranges that are combined by themselves first; it may hold any share of all rows.
    """
    names = list(state)
    # the count alone adds up; the other values are combined under their own names
    both = lambda a, b: combine({k: a[k] for k in names}, {k: b[k] for k in names}) | {"_n": a["_n"] + b["_n"]}
    run = scan(in_ranges(df, [*by, *order]), by, state | {"_n": F.lit(1).cast("bigint")}, both, identity | {"_n": 0}, inclusive=True)
    total = run.groupBy(*by).agg(F.max_by(F.struct(*names), "_n").alias("_total"))
    return total.select(*by, *[F.coalesce(F.col(f"_total.{n}"), F.lit(identity[n])).alias(n) for n in names])


def all_reduce(df: DataFrame, aggregate: Column, out: str) -> DataFrame:
    """Every row with the global aggregate: one row is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(aggregate.alias(out))))


def rates(df: DataFrame, size: Column, seconds: Column, by: list[str]) -> DataFrame:
    """Effective MB/s of each group; samples of no duration are dropped."""
    timed = df.filter(seconds != 0)
    return timed.groupBy(*by).agg(F.count("*").alias("samples"), (F.sum(size) / (1e6 * F.sum(seconds))).alias("mb_per_s"))


def task_rates(df: DataFrame, seconds: Column, by: list[str]) -> DataFrame:
    """Tasks a second of each group (null without any duration)."""
    return df.groupBy(*by).agg(F.count("*").alias("tasks"), F.try_divide(F.count("*"), F.sum(seconds)).alias("tasks_per_s"))


def shares(df: DataFrame, elapsed: Column, by: list[str], **parts: Column) -> DataFrame:
    """Percentage of the elapsed time that each part takes."""
    return df.groupBy(*by).agg(*[(100 * F.try_divide(F.sum(c), F.sum(elapsed))).alias(n) for n, c in parts.items()])


def speed_up(df: DataFrame, without: Column, with_: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.sum(without), F.sum(with_)).alias("speed_up"))


def histogram(df: DataFrame, worker: str) -> DataFrame:
    """Tasks of each worker and its share of all."""
    counts = df.groupBy(worker).agg(F.count("*").alias("tasks"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("tasks").alias("_all")))).withColumn("share", F.col("tasks") / F.col("_all")).drop("_all")


def delays(df: DataFrame, submit: Column, start: Column, end: Column, by: list[str]) -> DataFrame:
    """Mean delay before and mean length of execution."""
    return df.groupBy(*by).agg(F.avg(start - submit).alias("avg_delay"), F.avg(end - start).alias("avg_length"))


def terminated(df: DataFrame, outstanding: Column, busy: Column) -> DataFrame:
    """Sums over all ranks, and whether all work is done and every rank idle."""
    sums = df.agg(F.sum(outstanding).alias("outstanding"), F.sum(busy).alias("busy"))
    return sums.withColumn("finished", (F.col("outstanding") == 0) & (F.col("busy") == 0))


def all_gather(df: DataFrame, rank: str, columns: list[str]) -> DataFrame:
    """One array of every rank's values, in rank order (one row a rank)."""
    return df.agg(F.array_sort(F.collect_list(F.struct(rank, *columns))).alias("gathered"))


def max_abs_error(df: DataFrame, value: Column, expected: Column) -> DataFrame:
    return df.agg(F.max(F.abs(value - expected)).alias("max_error"))
