"""One file of a sparse matrix in binary compressed rows, read and written by many tasks.

The layout: rows, columns and cells (64 bits each), then all values (double), all columns
(64 bits) and the row starts (rows + 1 of 64 bits).

The data source ``csr`` reads the 24 bytes of the header to plan its tasks, each a range of
cells; a task finds its first row by binary search in the row starts and reads its own parts
of the three sections, in Arrow batches.  Conditions on the row ``i`` become a range of cells
before tasks are planned (with ``spark.sql.python.filterPushdown.enabled``).

``write_csr`` commits in two phases.  First each task writes its sorted rows to a file of
its own and reports their number.  Then the places of all parts are known: the file is
made at its full size under another name, tasks copy the parts to their places (repeated
copies write the same bytes, so that a lost task does no harm), and a rename publishes it.
No cell passes through the driver.

Both need a file system that is mounted on all machines.  Repeated cells are kept; an empty
matrix has a header and row starts alone.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Cells of one task, and of one batch.
TASK_CELLS, BATCH_CELLS = 4_000_000, 100_000
_HEAD = 24


def mounted(path: str) -> str:
    """The path without its scheme, which must be that of mounted files."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"not a mounted file system: {path}")
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _numbers(path: str, at: int, n: int, kind=np.int64) -> np.ndarray:
    with open(path, "rb") as f:
        f.seek(at)
        return np.frombuffer(f.read(8 * n), kind)


def shape_of(path: str) -> tuple[int, int, int]:
    """Rows, columns, cells: the header alone is read."""
    return tuple(_numbers(mounted(path), 0, 3).tolist())


def _first_row(path: str, starts: int, rows: int, cell: int) -> int:
    """The row that holds a cell: the last one that begins at or before it."""
    lo, hi = 0, rows
    with open(path, "rb") as f:
        while hi - lo > 1:
            middle = (lo + hi) // 2
            f.seek(starts + 8 * middle)
            lo, hi = (middle, hi) if int.from_bytes(f.read(8), "little") <= cell else (lo, middle)
    return lo


class _CsrReader(DataSourceReader):
    def __init__(self, options):
        self.path = mounted(options["path"])
        self.task_cells = int(options.get("taskCells", TASK_CELLS))
        self.least, self.most = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            by_row = isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == ("i",) and isinstance(f.value, int)
            if by_row and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            if by_row and isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                end = f.value + (not isinstance(f, LessThan))
                self.most = end if self.most is None else min(self.most, end)
            if not by_row:
                yield f

    def partitions(self) -> list[InputPartition]:
        rows, _, cells = shape_of(self.path)
        starts = _HEAD + 16 * cells
        least, most = (min(max(0, x), rows) for x in (self.least, rows if self.most is None else self.most))
        if least >= most:
            return [InputPartition((0, 0))]
        lo, hi = (int(_numbers(self.path, starts + 8 * r, 1)[0]) for r in (least, most))
        return [InputPartition((a, min(a + self.task_cells, hi))) for a in range(lo, hi, self.task_cells)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        lo, hi = partition.value
        rows, _, cells = shape_of(self.path)
        starts = _HEAD + 16 * cells
        for at in range(lo, hi, BATCH_CELLS):
            end = min(at + BATCH_CELLS, hi)
            row = _first_row(self.path, starts, rows, at)
            first = row
            ends = []  # of the rows that the batch touches
            while not ends or ends[-1][-1] < end:
                ends.append(_numbers(self.path, starts + 8 * (row + 1), min(BATCH_CELLS, rows - row)))
                row += len(ends[-1])
            i = first + np.searchsorted(np.concatenate(ends), np.arange(at, end), side="right")
            v = _numbers(self.path, _HEAD + 8 * at, end - at, np.float64)
            j = _numbers(self.path, _HEAD + 8 * (cells + at), end - at)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v)], ["i", "j", "v"])


class CsrDataSource(DataSource):
    """``spark.read.format("csr").load(path)``, after ``spark.dataSource.register(CsrDataSource)``; option taskCells."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return "i bigint, j bigint, v double"

    def reader(self, schema) -> DataSourceReader:
        return _CsrReader(self.options)


def read_csr(spark: SparkSession, path: str, task_cells: int = TASK_CELLS) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CsrDataSource)
    return spark.read.format("csr").option("taskCells", task_cells).load(path)


def write_csr(m: DataFrame, path: str, shape: tuple[int, int]) -> None:
    """A matrix (i, j, v) of the given shape as one file; cells beyond the shape are an error."""
    spark, path = m.sparkSession, mounted(path)
    rows, columns = shape
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    os.makedirs(folder)
    typed = m.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase one: a part's columns in three files, named anew by each attempt."""
        name, n, first, last = f"{folder}/{uuid.uuid4().hex}", 0, None, None
        with open(f"{name}.i", "wb") as fi, open(f"{name}.j", "wb") as fj, open(f"{name}.v", "wb") as fv:
            for batch in batches:
                i, j = (batch.column(c).to_numpy() for c in ("i", "j"))
                if not len(i):
                    continue
                if i[0] < 0 or i[-1] >= rows or j.min() < 0 or j.max() >= columns:
                    raise ValueError(f"cells beyond the shape {rows} x {columns}")
                first, last = i[0].item() if first is None else first, i[-1].item()
                n += len(i)
                for f, x in ((fi, i), (fj, j), (fv, batch.column("v").to_numpy())):
                    f.write(np.ascontiguousarray(x).tobytes())
        if n:
            yield pa.RecordBatch.from_pylist([{"name": name, "n": n, "first": first, "last": last}])

    sorted_ = typed.repartitionByRange("i").sortWithinPartitions("i", "j")
    parts = sorted(sorted_.mapInArrow(put, "name string, n bigint, first bigint, last bigint").collect(), key=lambda r: r["first"])
    cells = sum(r["n"] for r in parts)
    made = f"{folder}/whole"
    with open(made, "wb") as f:
        f.truncate(_HEAD + 16 * cells + 8 * (rows + 1))
        f.write(np.array([rows, columns, cells], np.int64).tobytes())
    # a part also writes the starts of the rows from its first one to the next part's first one; the first part those before it too
    places, before = [], 0
    for k, r in enumerate(parts):
        places.append((r["name"], r["n"], before, r["first"] if k else 0, parts[k + 1]["first"] if k + 1 < len(parts) else rows + 1))
        before += r["n"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase two: a part's bytes to their places, a block at a time."""
        for batch in batches:
            for name, n, before, first, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(made, "r+b") as out:
                    for suffix, section in (("v", 0), ("j", 1)):
                        out.seek(_HEAD + 8 * (section * cells + before))
                        with open(f"{name}.{suffix}", "rb") as f:
                            while block := f.read(8 * BATCH_CELLS):
                                out.write(block)
                    out.seek(_HEAD + 16 * cells + 8 * first)
                    held = np.memmap(f"{name}.i", np.int64, "r", shape=(n,))
                    for row in range(first, after, BATCH_CELLS):
                        out.write((before + np.searchsorted(held, np.arange(row, min(row + BATCH_CELLS, after)))).astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    if places:
        jobs = spark.createDataFrame(places, "name string, n bigint, before bigint, first bigint, after bigint").repartition(len(places))
        jobs.mapInArrow(place, "n bigint").agg(F.sum("n")).collect()
    os.replace(made, path)
    for r in parts:
        for suffix in "ijv":
            os.remove(f"{r['name']}.{suffix}")
