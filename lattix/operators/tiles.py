"""Products of dense matrices by binary tiles, on a grid of two dimensions or with layers over the inner one.

Cells are packed to square tiles (bi, bj, one binary value).  Each tile of A is sent to the
tasks of its row of C, each tile of B to those of its column; a task reads the pairs of a
tile of C in order of the inner index, multiplies them and adds up in place, so it holds
two tiles and one sum.  With ``layers`` above 1 the inner index is dealt over as many layers:
each layer has its own partial tile of C, and one more exchange adds the layers up.  That
serves products whose C has few tiles, which would else be few tasks.

Exchanged are (A's tiles) * (tile columns of B) + (B's tiles) * (tile rows of A) + layers *
(C's tiles): no row a cell and none a multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.operators.matrix import product_shape

#: Rows and columns of a tile.
TILE = 256


def _kind(m: DataFrame) -> str:
    return "double" if m.schema["v"].dataType.simpleString() in ("double", "float") else "bigint"


def pack(m: DataFrame, tile: int = TILE) -> DataFrame:
    """Cells (i, j, v) as tiles (bi, bj, cells); absent cells and tiles are zero.  A tile is one group of at most tile * tile cells."""
    kind = _kind(m)

    def one(t: pa.Table) -> pa.Table:
        out = np.zeros((tile, tile), np.float64 if kind == "double" else np.int64)
        i, j = (t.column(c).to_numpy() for c in "ij")
        out[i % tile, j % tile] = t.column("v").to_numpy()
        return pa.table({"bi": pa.array([int(i[0]) // tile]), "bj": pa.array([int(j[0]) // tile]), "cells": pa.array([out.tobytes()], pa.binary())})

    cells = m.select(F.col("i").cast("bigint"), F.col("j").cast("bigint"), F.col("v").cast(kind), F.floor(F.col("i") / tile).alias("_bi"), F.floor(F.col("j") / tile).alias("_bj"))
    return cells.groupBy("_bi", "_bj").applyInArrow(one, "bi bigint, bj bigint, cells binary")


def unpack(tiles: DataFrame, shape: tuple[int, int], kind: str, tile: int = TILE) -> DataFrame:
    """All cells of the tiles that lie inside ``shape``."""
    rows, columns = shape

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, raw in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "cells")), strict=True):
                block = np.frombuffer(raw, np.float64 if kind == "double" else np.int64).reshape(tile, tile)[: rows - bi * tile, : columns - bj * tile]
                i, j = np.indices(block.shape)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i.ravel() + bi * tile, j.ravel() + bj * tile, block.ravel())], ["i", "j", "v"])

    return tiles.mapInArrow(cells, f"i bigint, j bigint, v {kind}")


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two tiles; of integers exactly, or an error where 64 bits may not hold it."""
    if a.dtype == np.float64:
        return a @ b
    most = 1.000001 * float(np.abs(a).astype(np.float64).sum(axis=1).max()) * float(np.abs(b).max())
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if most >= 2**62:
        raise OverflowError("a product may leave 64 bits")
    return a @ b


def product(a: DataFrame, b: DataFrame, tile_rows: int, tile_columns: int, kind: str, layers: int = 1, tile: int = TILE) -> DataFrame:
    """Tiles of A times B.  ``tile_rows``, ``tile_columns``: how many tiles C has down and across."""
    dtype = np.float64 if kind == "double" else np.int64
    grid = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    x = a.select("bi", F.col("bj").alias("bk"), F.lit(0).alias("side"), "cells").withColumn("bj", grid(tile_columns))
    y = b.select("bj", F.col("bi").alias("bk"), F.lit(1).alias("side"), "cells").withColumn("bi", grid(tile_rows))
    met = x.unionByName(y).withColumn("layer", F.col("bk") % layers)
    met = met.repartition("bi", "bj", "layer").sortWithinPartitions("bi", "bj", "layer", "bk", "side")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, left = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([total.tobytes()], pa.binary())], ["bi", "bj", "cells"])
        for batch in batches:
            for bi, bj, layer, bk, side, raw in zip(*(batch.column(c) for c in ("bi", "bj", "layer", "bk", "side", "cells")), strict=True):
                key = bi.as_py(), bj.as_py(), layer.as_py()
                if key != at:
                    if total is not None:
                        yield done()
                    at, total, left = key, None, None
                cells = np.frombuffer(raw.as_buffer(), dtype).reshape(tile, tile)
                if side.as_py() == 0:
                    left = bk.as_py(), cells
                elif left is not None and left[0] == bk.as_py():
                    part = multiplied(left[1], cells)
                    total = part if total is None else total + part
        if total is not None:
            yield done()

    parts = met.select("bi", "bj", "layer", "bk", "side", "cells").mapInArrow(summed, "bi bigint, bj bigint, cells binary")
    if layers == 1:
        return parts

    def reduced(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_buffer(), dtype) for c in t.column("cells"))
        return pa.table({"bi": t.column("bi").slice(0, 1), "bj": t.column("bj").slice(0, 1), "cells": pa.array([total.tobytes()], pa.binary())})

    return parts.groupBy("bi", "bj").applyInArrow(reduced, "bi bigint, bj bigint, cells binary")


def gemm(a: DataFrame, b: DataFrame, shapes: tuple[tuple[int, int], tuple[int, int]], layers: int = 1, tile: int = TILE) -> DataFrame:
    """Cells of A times B, of the given shapes.  Integers stay integers, everything else is double."""
    rows, columns = product_shape(*shapes)
    kind = "bigint" if _kind(a) == _kind(b) == "bigint" else "double"
    typed = lambda m: m.select("i", "j", F.col("v").cast(kind).alias("v"))
    tiles = product(pack(typed(a), tile), pack(typed(b), tile), -(-rows // tile), -(-columns // tile), kind, layers, tile)
    return unpack(tiles, (rows, columns), kind, tile)
