"""Game of life: one step as an aggregation of live cells, many steps in blocks with halos.

A step on live cells alone adds one to each cell's eight neighbours: one explode and one
aggregation.  For many steps the board is cut into blocks, each held as a bitmap with a
border of ``halo`` cells of its neighbours; a task computes ``halo`` generations of a block
by itself, as the border's cells become wrong one by one from the outside.  Then the blocks
exchange their edges once for the next ``halo`` generations: at most one row a pair of
neighbours, whatever the number of live cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.plans.lineage import durable

_OFFSETS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def _neighbours(*axes: str) -> Column:
    return F.array(*[F.struct(F.lit(a).alias(f"d_{axes[0]}"), F.lit(b).alias(f"d_{axes[1]}")) for a, b in _OFFSETS])


def life2d_step(alive: DataFrame, rows: int, columns: int) -> DataFrame:
    """One generation on a board with a dead border: born with 3 neighbours, survives with 2 or 3."""
    near = alive.select("row", "col", F.inline(_neighbours("row", "col"))).select(
        (F.col("row") + F.col("d_row")).alias("row"), (F.col("col") + F.col("d_col")).alias("col"), F.lit(1).alias("near"), F.lit(0).alias("self")
    )
    own = alive.select("row", "col", F.lit(0).alias("near"), F.lit(1).alias("self"))
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, columns - 1)
    counts = near.filter(inside).unionByName(own).groupBy("row", "col").agg(F.sum("near").alias("near"), F.max("self").alias("self"))
    return counts.filter((F.col("near") == 3) | ((F.col("near") == 2) & (F.col("self") == 1))).select("row", "col")


def life2d(alive: DataFrame, rows: int, columns: int, generations: int, every: int = 5, block: int = 512) -> DataFrame:
    """``generations`` steps of a board with a dead border, with an exchange every few."""
    return life_blocks(alive, ("row", "col"), (rows, columns), (False, False), generations, every, block)


def life3d(alive: DataFrame, depth: int, height: int, generations: int, every: int = 5, block: int = 512) -> DataFrame:
    """``generations`` steps as in ``life3d_step``: planes apart, y with a dead border, z periodic."""
    return life_blocks(alive, ("y", "z"), (height, depth), (False, True), generations, every, block, plane="x")


def _spans(size: int, block: int) -> list[tuple[int, int]]:
    return [(a, min(a + block, size)) for a in range(0, size, block)]


def _generation(a: np.ndarray) -> np.ndarray:
    p = np.pad(a.astype(np.uint8), 1)
    h, w = a.shape
    near = sum(p[i : i + h, j : j + w] for i in range(3) for j in range(3)) - p[1:-1, 1:-1]
    return (near == 3) | ((near == 2) & a)


def life_blocks(
    alive: DataFrame, axes: tuple[str, str], sizes: tuple[int, int], periodic: tuple[bool, bool], generations: int, halo: int, block: int = 512, plane: str | None = None
) -> DataFrame:
    """Live cells (plane, axes) after ``generations``; each axis ends in a dead border or is periodic.

    Cells outside the board are left out, repeated ones count once.
    """
    planes = F.col(plane).cast("bigint") if plane else F.lit(0).cast("bigint")
    counts = [-(-s // block) for s in sizes]

    def images(axis: int, at: Column, reach: int) -> Column:
        """(block, place from the block's first cell, by -reach) of each block that sees the cell at ``at``, on a periodic axis also from beyond its ends."""
        size, turns = sizes[axis], -(-reach // sizes[axis]) if periodic[axis] else 0

        def seen(u: Column) -> Column:
            first, last = F.greatest(F.floor((u - reach) / block), F.lit(0)), F.least(F.floor((u + reach) / block), F.lit(counts[axis] - 1))
            blocks = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
            inside = F.filter(blocks, lambda b: (u >= b * block - reach) & (u < F.least((b + 1) * block, F.lit(size)) + reach))
            return F.transform(inside, lambda b: F.struct(b.alias("b"), (u - b * block).alias("at")))

        return F.concat(*[seen(at + turn * size) for turn in range(-turns, turns + 1)])

    def board(b: tuple[int, int], reach: int) -> np.ndarray:
        shape = [min((k + 1) * block, s) - k * block + 2 * reach for k, s in zip(b, sizes, strict=True)]
        return np.zeros(shape, bool)

    def run(a: np.ndarray, b: tuple[int, int], reach: int) -> np.ndarray:
        """The block itself after ``reach`` generations; what lies beyond a dead border stays dead."""
        inside = np.ones(a.shape, bool)
        for axis in (0, 1):
            if not periodic[axis]:
                place = np.arange(a.shape[axis]) + b[axis] * block - reach
                inside &= np.expand_dims((place >= 0) & (place < sizes[axis]), 1 - axis)
        for _ in range(reach):
            a = _generation(a) & inside
        return a[reach:-reach, reach:-reach]

    def packed(t: pa.Table, a: np.ndarray) -> pa.Table:
        one = {"plane": t.column("plane").slice(0, 1), "bi": t.column("bi").slice(0, 1), "bj": t.column("bj").slice(0, 1)}
        one["bits"] = pa.array([np.packbits(a).tobytes()], pa.binary())
        return pa.table(one).slice(0, int(a.any()))

    def key(t: pa.Table) -> tuple[int, int]:
        return t.column("bi")[0].as_py(), t.column("bj")[0].as_py()

    schema = "plane bigint, bi bigint, bj bigint, bits binary"
    steps = [halo] * (generations // halo) + [generations % halo] * (generations % halo > 0)

    def first(t: pa.Table) -> pa.Table:
        b, reach = key(t), steps[0]
        a = board(b, reach)
        a[t.column("i").to_numpy() + reach, t.column("j").to_numpy() + reach] = True
        return packed(t, run(a, b, reach))

    def edges(reach: int):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p, bi, bj, raw in zip(*(batch.column(c).to_pylist() for c in ("plane", "bi", "bj", "bits")), strict=True):
                    a = board((bi, bj), 0)
                    a = np.unpackbits(np.frombuffer(raw, np.uint8), count=a.size).reshape(a.shape).astype(bool)
                    rows = []
                    for ti, i0, i1, oi in _targets(bi, block, sizes[0], periodic[0], reach):
                        for tj, j0, j1, oj in _targets(bj, block, sizes[1], periodic[1], reach):
                            part = a[i0:i1, j0:j1]
                            if part.any():
                                rows.append((p, ti, tj, oi, oj, *part.shape, np.packbits(part).tobytes()))
                    if rows:
                        names = ["plane", "bi", "bj", "i", "j", "h", "w", "bits"]
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([(n, pa.int64()) for n in names[:-1]] + [("bits", pa.binary())]))

        return send

    def later(reach: int):
        def assemble(t: pa.Table) -> pa.Table:
            b = key(t)
            a = board(b, reach)
            for i, j, h, w, raw in zip(*(t.column(c).to_pylist() for c in ("i", "j", "h", "w", "bits")), strict=True):
                a[i : i + h, j : j + w] |= np.unpackbits(np.frombuffer(raw, np.uint8), count=h * w).reshape(h, w).astype(bool)
            return packed(t, run(a, b, reach))

        return assemble

    u, v = (F.col(c).cast("bigint") for c in axes)
    cells = alive.filter(u.between(0, sizes[0] - 1) & v.between(0, sizes[1] - 1))
    if not generations:
        return cells.select(*([plane] if plane else []), *axes).distinct()
    dealt = cells.select(planes.alias("plane"), F.inline(images(0, u, steps[0])).alias("bi", "i"), v.alias("_v"))
    dealt = dealt.select("plane", "bi", "i", F.inline(images(1, F.col("_v"), steps[0])).alias("bj", "j"))
    state = dealt.groupBy("plane", "bi", "bj").applyInArrow(first, schema)
    for reach in steps[1:]:
        sent = durable(state).mapInArrow(edges(reach), "plane bigint, bi bigint, bj bigint, i bigint, j bigint, h bigint, w bigint, bits binary")
        state = sent.groupBy("plane", "bi", "bj").applyInArrow(later(reach), schema)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, bi, bj, raw in zip(*(batch.column(c).to_pylist() for c in ("plane", "bi", "bj", "bits")), strict=True):
                a = board((bi, bj), 0)
                i, j = np.nonzero(np.unpackbits(np.frombuffer(raw, np.uint8), count=a.size).reshape(a.shape))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), p)), pa.array(i + bi * block), pa.array(j + bj * block)], ["plane", "i", "j"])

    out = state.mapInArrow(unpacked, "plane bigint, i bigint, j bigint")
    return out.select(*([F.col("plane").alias(plane)] if plane else []), F.col("i").alias(axes[0]), F.col("j").alias(axes[1]))


def _targets(b: int, block: int, size: int, periodic: bool, reach: int) -> list[tuple[int, int, int, int]]:
    """Along one axis: (block, first and last own cell that it sees, their place in its bitmap) of all blocks that see block ``b``."""
    lo, hi = b * block, min((b + 1) * block, size)
    turns = -(-reach // size) if periodic else 0
    out = []
    for turn in range(-turns, turns + 1):
        for k, (first, last) in enumerate(_spans(size, block)[max(0, (lo + turn * size - reach) // block) : (hi + turn * size + reach) // block + 1], max(0, (lo + turn * size - reach) // block)):
            a, z = max(lo + turn * size, first - reach), min(hi + turn * size, last + reach)
            if a < z:
                out.append((k, a - turn * size - lo, z - turn * size - lo, a - first + reach))
    return out


def life3d_step(alive: DataFrame, depth: int, height: int) -> DataFrame:
    """One generation of a grid whose cells see neighbours in their own y-z plane only; z is periodic, y has a dead border."""
    near = alive.select("x", "y", "z", F.inline(_neighbours("y", "z"))).select(
        "x", (F.col("y") + F.col("d_y")).alias("y"), F.pmod(F.col("z") + F.col("d_z"), F.lit(depth)).alias("z"), F.lit(1).alias("near"), F.lit(0).alias("self")
    )
    own = alive.select("x", "y", "z", F.lit(0).alias("near"), F.lit(1).alias("self"))
    counts = near.filter(F.col("y").between(0, height - 1)).unionByName(own).groupBy("x", "y", "z").agg(F.sum("near").alias("near"), F.max("self").alias("self"))
    return counts.filter((F.col("near") == 3) | ((F.col("near") == 2) & (F.col("self") == 1))).select("x", "y", "z")


def alive_per_block(alive: DataFrame, axis: str, size: int) -> DataFrame:
    """Live cells of each block of ``size`` planes along an axis (blocks without any are left out)."""
    return alive.groupBy(F.floor(F.col(axis) / size).alias("block")).agg(F.count("*").alias("alive"))


def board_text(alive: DataFrame, rows: int, columns: int, live: str = "1", dead: str = "0") -> DataFrame:
    """One line of text for each of the board's rows."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.when(F.array_contains("_on", c.cast("bigint")), live).otherwise(dead))
    found = alive.groupBy("row").agg(F.collect_set(F.col("col").cast("bigint")).alias("_on"))
    every = alive.sparkSession.range(rows).withColumnRenamed("id", "row").join(found, "row", "left")
    return every.withColumn("_on", F.coalesce("_on", F.array().cast("array<bigint>"))).select("row", F.array_join(cells, "").alias("line"))
