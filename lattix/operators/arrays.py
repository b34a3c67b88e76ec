"""Fixed-size arrays as rows (idx, val), orderings, and slices of rows over ranks."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.plans.lineage import durable


def _checked(index: Column, n: int) -> Column:
    """The index, or an error if it lies outside [0, n)."""
    return F.when((index >= 0) & (index < n), index).otherwise(F.raise_error(F.concat(F.lit("index out of bounds: "), index.cast("string"))))


def put(array: DataFrame, writes: DataFrame, n: int) -> DataFrame:
    """The array (idx, val) after ``writes`` (idx, val), one a place; a place outside the array is an error."""
    new = writes.select(_checked(F.col("idx"), n).alias("idx"), F.col("val").alias("_new"))
    return array.join(new, "idx", "left").select("idx", F.coalesce("_new", "val").alias("val"))


def get(array: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Values at the places of ``wanted`` (idx, and any other columns)."""
    return wanted.withColumn("idx", _checked(F.col("idx"), n)).join(array, "idx")


def get_range(array: DataFrame, start: int, stop: int, n: int) -> DataFrame:
    if not 0 <= start <= stop <= n:
        raise IndexError(f"[{start}, {stop}) is not within [0, {n})")
    return array.filter((F.col("idx") >= start) & (F.col("idx") < stop))


def at_work_item(df: DataFrame, item: str, n: int) -> DataFrame:
    """Rows of one work item."""
    return df.filter(F.col(item) == n)


def sort_per_host(df: DataFrame, host: str, order: list[str]) -> DataFrame:
    """Each host's rows together and in order: one shuffle, no global sort."""
    return df.repartition(host).sortWithinPartitions(host, *order)


def interleaved(*arrays: str) -> Column:
    """Sort key of structs that compare by element of each array in turn, shorter ones first."""
    sizes = [F.size(a).alias(f"n{k}") for k, a in enumerate(arrays)]
    return F.struct(*sizes, F.transform(F.arrays_zip(*arrays), lambda z: F.array(*[z[a] for a in arrays])).alias("elements"))


def shuffled(df: DataFrame, key: str, seed: int, by: list[str] | None = None) -> DataFrame:
    """A repeatable random order, as a rank: the order in which a thief visits victims."""
    w = Window.partitionBy(*(by or [])).orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string"))), key)
    return df.withColumn("visit", F.row_number().over(w) - 1)


def global_positions(df: DataFrame, key: Column, out: str = "pos") -> DataFrame:
    """Place of each row in the order of ``key``, which must tell rows apart: a sort by ranges, then each range's offset."""
    placed = durable(df.withColumn("_key", key).orderBy("_key").withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_key")) - 1
    return placed.join(F.broadcast(before), "_part").withColumn(out, (inside + F.col("_before")).cast("int")).drop("_key", "_part", "_before")


def preview(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in ``order``: each task keeps ``n``."""
    return df.orderBy(*order).limit(n)


def inversions(df: DataFrame, host: str, value: str) -> DataFrame:
    """Rows of each host, and how many stand after a larger one of the host in the frame's own order (nulls are not compared)."""

    def count(batches):
        held = None
        for x in batches:
            if not x.num_rows:
                continue
            t = pa.Table.from_batches([x]) if held is None else pa.concat_tables([held, pa.Table.from_batches([x])])
            h, v = t.column(0).combine_chunks(), t.column(1).combine_chunks()
            n = len(h) - 1
            same = pc.or_kleene(pc.equal(h.slice(0, n), h.slice(1)), pc.and_(pc.is_null(h.slice(0, n)), pc.is_null(h.slice(1))))
            worse = pc.fill_null(pc.and_kleene(same, pc.greater(v.slice(0, n), v.slice(1))), False).cast(pa.int64())
            if held is None:  # nothing stands before the first row
                worse = pa.concat_arrays([pa.array([0], pa.int64()), worse])
            held = t.slice(n).combine_chunks()
            yield pa.RecordBatch.from_arrays([x.column(0), worse], [host, "worse"])

    rows = df.select(host, value).mapInArrow(count, f"{host} {df.schema[host].dataType.simpleString()}, worse bigint")
    return rows.groupBy(host).agg(F.count("*").alias("n"), F.sum("worse").alias("inversions"))


def row_slices(df: DataFrame, row: str, n_rows: int, ranks: int, truncate: bool = False) -> DataFrame:
    """Rank of each row's slice; ``truncate`` drops the rows that do not fill equal slices."""
    size = n_rows // ranks if truncate else -(-n_rows // ranks)
    placed = df.withColumn("rank", F.floor(F.col(row) / size))
    return placed.filter(F.col(row) < size * ranks) if truncate else placed


def rehome(tiles: DataFrame, homes: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles with their new host; tiles that ``homes`` (keys, new_host) lacks keep theirs."""
    return tiles.join(homes, keys, "left").withColumn("host", F.coalesce("new_host", "host")).drop("new_host")


def gather_rows(df: DataFrame, order: str, values: str, by: str) -> DataFrame:
    """Rows of arrays as one flat array a group, in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, values)))
    return df.groupBy(by).agg(F.flatten(F.transform(rows, lambda s: s[values])).alias("flat"))
