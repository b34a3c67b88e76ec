"""Dense and sparse matrices as coordinate rows (i, j, v); absent cells of sparse ones are zero.

Products are one equi-join on the inner dimension and one aggregation with partial
sums before the shuffle; which side is broadcast is the planner's choice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Semirings as (multiply, add).
SEMIRINGS: dict[str, tuple[Callable[[Column, Column], Column], Callable[[Column], Column]]] = {
    "plus_times": (lambda a, b: a * b, F.sum),
    "min_plus": (lambda a, b: a + b, F.min),
    "max_times": (lambda a, b: a * b, F.max),
    "or_and": (lambda a, b: a & b, F.bool_or),
}


def from_rows(df: DataFrame, row: str, array: str) -> DataFrame:
    """Rows of arrays to coordinates; columns count from 0."""
    return df.select(F.col(row).alias("i"), F.posexplode(array).alias("j", "v"))


def to_rows(m: DataFrame, n: int) -> DataFrame:
    """Coordinates to one dense array of ``n`` values a row."""
    cells = F.map_from_entries(F.collect_list(F.struct("j", "v")))
    return m.groupBy("i").agg(cells.alias("_m")).select("i", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.try_element_at("_m", j), F.lit(0))).alias("row"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "i bigint, j bigint, v double")


def apply(m: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return m.select("i", "j", fn(F.col("v")).alias("v"))


def apply_by_index(m: DataFrame, fn: Callable[[Column, Column, Column], Column]) -> DataFrame:
    return m.select("i", "j", fn(F.col("i"), F.col("j"), F.col("v")).alias("v"))


def fill(m: DataFrame, value: float) -> DataFrame:
    return apply(m, lambda _: F.lit(value))


def transpose(m: DataFrame) -> DataFrame:
    """A projection; two of them collapse into none."""
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def sub_matrix(m: DataFrame, i0: int, i1: int, j0: int, j1: int) -> DataFrame:
    """Rows [i0, i1) and columns [j0, j1), clamped to the matrix, with the origin moved there."""
    i, j = F.col("i"), F.col("j")
    return m.filter((i >= i0) & (i < i1) & (j >= j0) & (j < j1)).select((i - i0).alias("i"), (j - j0).alias("j"), "v")


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Whether half-open ranges that aren't empty meet."""
    return (a_lo < b_hi) & (b_lo < a_hi)


def with_tiles(m: DataFrame, tm: int, tn: int) -> DataFrame:
    return m.withColumns({"bi": F.floor(F.col("i") / tm), "bj": F.floor(F.col("j") / tn)})


def tiled_sub_matrix(m: DataFrame, tm: int, tn: int, i0: int, i1: int, j0: int, j1: int) -> DataFrame:
    """As ``sub_matrix``, with tile predicates first: they prune files partitioned by (bi, bj)."""
    bi, bj = F.col("bi"), F.col("bj")
    tiles = m.filter((bi >= i0 // tm) & (bi <= (i1 - 1) // tm) & (bj >= j0 // tn) & (bj <= (j1 - 1) // tn))
    return sub_matrix(tiles, i0, i1, j0, j1)


def tile(m: DataFrame, bi: int, bj: int) -> DataFrame:
    return m.filter((F.col("bi") == bi) & (F.col("bj") == bj))


def assign(m: DataFrame, new: DataFrame) -> DataFrame:
    """Cells of ``new`` replace those of ``m``: elements, rows or whole tiles alike."""
    return m.join(new.select("i", "j"), ["i", "j"], "left_anti").unionByName(new)


def assign_tile(m: DataFrame, new: DataFrame, bi: int, bj: int) -> DataFrame:
    """A tile's old cells go, also those that ``new`` lacks."""
    return m.filter(~((F.col("bi") == bi) & (F.col("bj") == bj))).unionByName(new)


def same_shape(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    if a != b:
        raise ValueError(f"shapes differ: {a} and {b}")
    return a


def ieee_divide(a: Column, b: Column) -> Column:
    """Quotient of doubles; by zero it is infinite, or not a number for 0 / 0."""
    a, b = a.cast("double"), b.cast("double")
    infinite = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b != 0, F.try_divide(a, b)).otherwise(infinite)


def binary(
    a: DataFrame,
    b: DataFrame,
    fn: Callable[[Column, Column], Column],
    how: str = "inner",
    shapes: tuple[tuple[int, int], tuple[int, int]] | None = None,
) -> DataFrame:
    """Cell by cell; ``how="full"`` for sparse matrices, whose absent cells count as 0.  Given ``shapes`` must be equal."""
    if shapes is not None:
        same_shape(*shapes)
    x = a.select("i", "j", F.col("v").alias("_a"))
    y = b.select("i", "j", F.col("v").alias("_b"))
    both = x.join(y, ["i", "j"], how)
    left, right = (F.coalesce(c, F.lit(0)) if how == "full" else F.col(c) for c in ("_a", "_b"))
    return both.select("i", "j", fn(left, right).alias("v"))


def add(*ms: DataFrame) -> DataFrame:
    """Sum of sparse matrices: union, then one aggregation (no join)."""
    out = ms[0].select("i", "j", "v")
    for m in ms[1:]:
        out = out.unionByName(m.select("i", "j", "v"))
    return out.groupBy("i", "j").agg(F.sum("v").alias("v"))


def shifted(m: DataFrame, di: int, dj: int) -> DataFrame:
    return m.select((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), "v")


Semiring = tuple[Callable[[Column, Column], Column], Callable[[Column], Column]]


def gemm(
    a: DataFrame,
    b: DataFrame,
    semiring: str | Semiring = "plus_times",
    c: DataFrame | None = None,
    shapes: tuple[tuple[int, int], tuple[int, int]] | None = None,
) -> DataFrame:
    """A times B over a named semiring or one given as (multiply, add), added to C if given.

    ``add`` is an aggregate function.  Given ``shapes`` must have equal inner dimensions.
    """
    if shapes is not None:
        product_shape(*shapes)
    times, plus = SEMIRINGS[semiring] if isinstance(semiring, str) else semiring
    x = a.select("i", F.col("j").alias("k"), F.col("v").alias("_a"))
    y = b.select(F.col("i").alias("k"), "j", F.col("v").alias("_b"))
    cells = x.join(y, "k").select("i", "j", times(F.col("_a"), F.col("_b")).alias("v"))
    if c is not None:
        cells = cells.unionByName(c.select("i", "j", "v"))
    return cells.groupBy("i", "j").agg(plus(F.col("v")).alias("v"))


def split_gemm(a: DataFrame, b: DataFrame, parts: int) -> DataFrame:
    """A product for a few hot inner indices: A's rows are dealt over ``parts`` keys an index, and B's row goes to each of them."""
    x = a.select("i", F.col("j").alias("k"), F.col("v").alias("_a"), F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int").alias("part"))
    y = b.select(F.col("i").alias("k"), "j", F.col("v").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return x.join(y, ["k", "part"]).groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def append_columns(a: DataFrame, b: DataFrame, columns: int) -> DataFrame:
    """B's columns to the right of A's ``columns``, row by row."""
    return a.select("i", "j", "v").unionByName(shifted(b, 0, columns))


def product_shape(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    if a[1] != b[0]:
        raise ValueError(f"inner dimensions differ: {a} and {b}")
    return a[0], b[1]


def complementary_shape(a: tuple[int, int], product: tuple[int, int]) -> tuple[int, int]:
    """Shape of B for A (m x k) and A B (m x n)."""
    if a[0] != product[0]:
        raise ValueError(f"rows differ: {a} and {product}")
    return a[1], product[1]


def tile_row(m: DataFrame, tm: int, i: int) -> DataFrame:
    """Row ``i`` with the tile row that holds it as a predicate, which prunes files."""
    return m.filter((F.col("bi") == i // tm) & (F.col("i") == i))


def element(m: DataFrame, tm: int, tn: int, i: int, j: int) -> DataFrame:
    return m.filter((F.col("bi") == i // tm) & (F.col("bj") == j // tn) & (F.col("i") == i) & (F.col("j") == j))


def stats(m: DataFrame) -> DataFrame:
    return m.agg(F.count("*").alias("nnz"), F.sum("v").alias("sum_values"), F.sum("j").alias("sum_indices"))


def sorted_coo(m: DataFrame) -> DataFrame:
    return m.select("i", "j", "v").orderBy("i", "j")


def column_major(m: DataFrame) -> DataFrame:
    return m.select("j", "i", "v").orderBy("j", "i")


def row_counts(m: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells of each row of ``rows`` (i), empty rows too."""
    return rows.select("i").join(m.groupBy("i").agg(F.count("*").alias("cells")), "i", "left").withColumn("cells", F.coalesce("cells", F.lit(0)))


def row_pointers(m: DataFrame, rows: DataFrame) -> DataFrame:
    """Compressed-row starts: cells before each row.

    A running sum over ranges of rows first (each range in its own task), then the
    ranges' offsets, so no task sees all rows.
    """
    counts = row_counts(m, rows).withColumn("_range", F.floor(F.col("i") / 65_536))
    w = Window.partitionBy("_range").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("_range").agg(F.sum("cells").alias("_n"))
    before = totals.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return counts.join(before, "_range").select("i", "cells", (F.coalesce(F.sum("cells").over(w), F.lit(0)) + F.col("_before")).alias("row_start"))


def is_valid_csr(m: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """Cells out of range and repeated cells: both 0 for a well-formed matrix."""
    bad = F.sum(((F.col("i") < 0) | (F.col("i") >= n_rows) | (F.col("j") < 0) | (F.col("j") >= n_cols)).cast("int"))
    cells = m.groupBy("i", "j").agg(F.count("*").alias("n"))
    return cells.agg(F.coalesce(bad, F.lit(0)).alias("out_of_range"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


def equal(a: DataFrame, b: DataFrame) -> bool:
    x, y = a.select("i", "j", "v"), b.select("i", "j", "v")
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
