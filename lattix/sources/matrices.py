"""Matrix files: MatrixMarket text (a data source named ``mtx``), binary compressed rows, and Parquet by tiles."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattix.operators.matrix import with_tiles

BANNER = "%%MatrixMarket"
#: Rows of a band of the binary sink.
BAND = 65_536
#: Tiles that get a folder each.  A file costs some milliseconds, so more tiles share files.
FOLDERS = 256


def detect_format(path: str) -> str:
    """By the last suffix."""
    kind = {"mtx": "mtx", "binary": "binary"}.get(path.rsplit(".", 1)[-1])
    if kind is None:
        raise ValueError(f"unknown matrix format: {path}")
    return kind


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no comments: value, file, at (place in the file), is_size.

    A file's size line is its first line that is no comment.  Of several files, those
    with a banner line have one (a folder that ``write_mtx`` wrote has one such file);
    without any banner, all have.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("at")).filter(F.trim("value") != "")
    comment = F.col("value").startswith("%")
    files = lines.groupBy("file").agg(F.min(F.when(~comment, F.col("at"))).alias("first"), F.bool_or(F.col("value").startswith(BANNER)).alias("banner"))
    any_banner = files.agg(F.bool_or("banner").alias("any_banner"))
    sizes = files.crossJoin(F.broadcast(any_banner)).filter("banner or not any_banner").select("file", "first")  # one row a file
    body = lines.filter(~comment).join(F.broadcast(sizes), "file", "left")  # keeps the lines' order in a split
    return body.withColumn("is_size", F.coalesce(F.col("at") == F.col("first"), F.lit(False))).drop("first")


def mtx_shape(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Rows, columns and cells; of several matrices the largest shape and all cells."""
    w = F.split(F.trim("value"), r"\s+")
    sizes = _numbered(spark, path).filter("is_size")
    got = sizes.agg(*[f(w[k].cast("bigint")).alias(str(k)) for k, f in enumerate((F.max, F.max, F.sum))]).first()
    return got[0], got[1], got[2]


def read_mtx(spark: SparkSession, path: str, one_based: bool = True, require_sorted: bool = False) -> DataFrame:
    """(i, j, v), from 0, of one or several files, read in splits by Spark's text source.

    With ``require_sorted``, a file whose rows don't come in order is an error.
    """
    base = 1 if one_based else 0
    if require_sorted and not check_row_sorted(spark, path):
        raise ValueError(f"rows are not sorted: {path}")
    w = F.split(F.trim("value"), r"\s+")
    cells = _numbered(spark, path).filter("not is_size")
    return cells.select((w[0].cast("bigint") - base).alias("i"), (w[1].cast("bigint") - base).alias("j"), F.coalesce(F.get(w, F.lit(2)).cast("double"), F.lit(1.0)).alias("v"))


def check_row_sorted(spark: SparkSession, path: str) -> bool:
    """Whether each file's rows come in order: inside each split as it is read, then from split to split."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list] = {}  # one entry a split that the task reads
        for b in batches:
            for file, block, i in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                s = seen.setdefault((file, block), [i, i, True])
                s[2] &= i >= s[1]
                s[1] = max(s[1], i)
        if seen:
            keys = list(seen)
            columns = [[k[0] for k in keys], [k[1] for k in keys], *[[seen[k][n] for k in keys] for n in range(3)]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "block", "lo", "hi", "ok"])

    first = F.split(F.trim("value"), r"\s+")[0].cast("bigint")
    body = _numbered(spark, path).filter("not is_size").select("file", F.col("at.block").alias("block"), first.alias("i"))
    found = body.mapInArrow(scan, "file string, block bigint, lo bigint, hi bigint, ok boolean")
    after = F.coalesce(F.lag("hi").over(Window.partitionBy("file").orderBy("block")) <= F.col("lo"), F.lit(True))
    return found.select((F.col("ok") & after).alias("fine")).agg(F.coalesce(F.bool_and("fine"), F.lit(True))).first()[0]


def write_mtx(m: DataFrame, path: str, rows: int, columns: int) -> None:
    """One-based cells in row order after the header; sorted by ranges, so each task writes a part of the rows."""
    n = m.count()
    number = F.format_string("%f", F.col("v").cast("double"))
    body = m.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), number).alias("line"))
    head = m.sparkSession.createDataFrame([(-2, 0, f"{BANNER} matrix coordinate integer general"), (-1, 0, f"{rows} {columns} {n}")], "i bigint, j bigint, line string")
    both = head.unionByName(body)
    # both header lines sort by one key, so they can't be parted
    ordered = both.withColumn("_k", F.greatest("i", F.lit(-1))).repartitionByRange("_k").sortWithinPartitions("i", "j")
    ordered.select("line").write.mode("overwrite").text(path)


class _MtxReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.base = options["path"], 0 if options.get("oneBased", "true") == "false" else 1

    def partitions(self) -> list[InputPartition]:
        path = Path(self.path)
        files = sorted(str(p) for p in path.iterdir() if p.name[0] not in "._") if path.is_dir() else [self.path]
        # of several files, those with a banner have a size line
        return [InputPartition((f, len(files) == 1 or open(f).read(len(BANNER)) == BANNER)) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        file, has_size = partition.value
        with open(file) as lines:
            body = (x.split() for x in lines if x.strip() and not x.startswith("%"))
            if has_size:
                next(body, None)
            for w in body:
                yield int(w[0]) - self.base, int(w[1]) - self.base, float(w[2]) if len(w) > 2 else 1.0


class MtxDataSource(DataSource):
    """``spark.read.format("mtx").load(path)`` for a file or a folder of parts on a mounted file system; ``read_mtx`` reads any store, in splits."""

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return "i bigint, j bigint, v double"

    def reader(self, schema) -> DataSourceReader:
        return _MtxReader(self.options)


def csr_bytes(shape: tuple[int, int], cells: list[tuple[int, int, float]]) -> bytes:
    """A small matrix as binary compressed rows: sizes, values (double), columns and row starts (64 bits)."""
    cells = sorted(cells)
    starts = np.concatenate([[0], np.cumsum(np.bincount([c[0] for c in cells], minlength=shape[0]))]).astype(np.uint64)
    head = np.array([*shape, len(cells)], dtype=np.uint64)
    return head.tobytes() + np.array([c[2] for c in cells], np.float64).tobytes() + np.array([c[1] for c in cells], np.uint64).tobytes() + starts.tobytes()


def read_binary_csr(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of binary files (one file is one task's work, 2 GB at most), or of the bands that ``write_binary_csr`` wrote."""
    if spark.read.format("binaryFile").load(path).filter(F.col("path").endswith(".parquet")).limit(1).select("path").count():
        source = spark.read.parquet(path).select("first_row", "content")
    else:
        source = spark.read.format("binaryFile").load(path).select(F.lit(0).cast("bigint").alias("first_row"), "content")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = value.as_buffer()
                m, _, nnz = (int(x) for x in np.frombuffer(raw, np.uint64, 3))
                v = np.frombuffer(raw, np.float64, nnz, 24)
                j = np.frombuffer(raw, np.int64, nnz, 24 + 8 * nnz)
                starts = np.frombuffer(raw, np.int64, m + 1, 24 + 16 * nnz)
                i = np.repeat(np.arange(m), np.diff(starts)) + first
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v)], ["i", "j", "v"])

    return source.mapInArrow(cells, "i bigint, j bigint, v double")


def binary_shape(spark: SparkSession, path: str) -> tuple[int, int, int]:
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 24).alias("h")).first()["h"]
    return tuple(int(x) for x in np.frombuffer(bytes(head), np.uint64))


def write_binary_csr(m: DataFrame, path: str, shape: tuple[int, int], band: int = BAND) -> None:
    """Bands of rows as Parquet (first_row, content): each band is a matrix of its own rows in binary form, so no task holds the whole."""
    columns = shape[1]
    n_rows = shape[0]

    def pack(t: pa.Table) -> pa.Table:
        first = t.column("band")[0].as_py() * band
        cells = list(zip((x - first for x in t.column("i").to_pylist()), t.column("j").to_pylist(), t.column("v").to_pylist(), strict=True))
        content = csr_bytes((min(band, n_rows - first), columns), cells)
        return pa.table({"first_row": pa.array([first], pa.int64()), "content": pa.array([content], pa.binary())})

    rows = m.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"), F.floor(F.col("i") / band).alias("band"))
    rows.groupBy("band").applyInArrow(pack, "first_row bigint, content binary").write.mode("overwrite").parquet(path)


def write_tiles(m: DataFrame, path: str, tm: int, tn: int, folders: int | None = None) -> None:
    """Cells laid out by tile, so that predicates on tiles prune what is read.

    Up to ``folders`` (``FOLDERS``) tiles have a folder each (bi, bj).  More are written in order of tiles, with
    bi and bj as columns: a tile's cells lie together, and the files' statistics prune files,
    row groups and pages.  Ranges go on inside a tile, so a heavy one is cut over tasks.
    """
    cells = with_tiles(m, tm, tn)
    folders = FOLDERS if folders is None else folders
    if cells.select("bi", "bj").distinct().limit(folders + 1).count() <= folders:
        cells.repartition("bi", "bj").write.mode("overwrite").partitionBy("bi", "bj").parquet(path)
    else:
        order = ["bi", "bj", "i", "j"]
        cells.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v, bi, bj) of a matrix laid out by tile."""
    return spark.read.parquet(path)


def load_tiled(spark: SparkSession, source: str, path: str, tm: int, tn: int, one_based: bool = True) -> DataFrame:
    """Distributed load: the file is read in splits, and each cell goes to its tile's folder under ``path``."""
    write_tiles(read_mtx(spark, source, one_based), path, tm, tn)
    return read_tiles(spark, path)
