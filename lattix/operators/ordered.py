"""Positions and running sums in an order, by a window a group, or by ranges where a group is too large for one task.

A count proves that no group has more than ``GROUP_ROWS`` rows; then one window is best.
Otherwise the order column's values are cut into ranges at approximate quantiles; each
(group, range) is counted first, then rows are numbered inside their range only.  A
group may hold any share of all rows: it is spread over the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

#: Rows of a group that one task may sort (it spills).
GROUP_ROWS = 4_000_000
#: Ranges that an order is cut into: an upper bound of the numbers that reach the driver.
RANGES = 64


def range_of(df: DataFrame, order: str, ranges: int = RANGES) -> Column:
    """Number of each row's range by ``order``; a column without quantiles (text) is one range."""
    if not isinstance(df.schema[order].dataType, (NumericType, TimestampType, TimestampNTZType, DateType)):
        return F.lit(0)
    cuts = df.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 1000)).first()[0] or []
    if not cuts:
        return F.lit(0)
    bounds = [F.lit(c).cast(df.schema[order].dataType) for c in sorted(set(cuts))]
    return F.coalesce(sum((F.col(order) >= b).cast("int") for b in bounds), F.lit(0))


def groups_fit(df: DataFrame, by: list[str], limit: int | None) -> bool:
    """Whether every group's rows fit one task: by the count of all rows, else by the largest group."""
    limit = GROUP_ROWS if limit is None else limit
    if df.count() <= limit:
        return True
    return (df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= limit


def positions(df: DataFrame, by: list[str], order: list[str], out: str = "pos", size: str | None = None, group_rows: int | None = None) -> DataFrame:
    """Place of each row among its group's by ``order``, from 0, and with ``size`` the group's rows."""
    if groups_fit(df, by, group_rows):
        w = Window.partitionBy(*by)
        placed = df.withColumn(out, (F.row_number().over(w.orderBy(*order)) - 1).cast("int"))
        return placed.withColumn(size, F.count("*").over(w)) if size else placed
    ranged = df.withColumn("_range", range_of(df, order[0]))
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    offsets = counts.withColumn("_before", F.sum("_n").over(w.orderBy("_range")) - F.col("_n"))
    if size:
        offsets = offsets.withColumn(size, F.sum("_n").over(w))
    joined = ranged.join(offsets, [ranged[k].eqNullSafe(offsets[k]) for k in [*by, "_range"]]).select(ranged["*"], "_before", *([size] if size else []))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1
    return joined.withColumn(out, (inside + F.col("_before")).cast("int")).drop("_range", "_before")


def sums_before(df: DataFrame, by: list[str], order: list[str], amount: Column, out: str, group_rows: int | None = None) -> DataFrame:
    """Sum of the amounts of the group's earlier rows, 0 for the first."""
    if groups_fit(df, by, group_rows):
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(amount).over(w), F.lit(0)))
    ranged = df.withColumns({"_range": range_of(df, order[0]), "_amount": amount})
    totals = ranged.groupBy(*by, "_range").agg(F.sum("_amount").alias("_n"))
    offsets = totals.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n"))
    joined = ranged.join(offsets, [ranged[k].eqNullSafe(offsets[k]) for k in [*by, "_range"]]).select(ranged["*"], "_before")
    w = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.coalesce(F.sum("_amount").over(w), F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_range", "_amount", "_before")
