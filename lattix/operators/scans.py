"""Scans over any monoid and windows with halos, over rows dealt to contiguous ranges of an order.

``in_ranges`` sorts rows by range partitioning and writes them once, so that each task
holds one range and a group of any size is spread over as many ranges as it needs.  A
first pass leaves one row a range (the total of its last group, and which groups it begins
and ends with), those few rows are folded in order to what each range starts from, and a
second pass replays the rows inside their ranges, batch by batch.  Nothing but one row a
range reaches the driver, and a task holds one batch.

A monoid is a function of two dictionaries of NumPy arrays, earlier and later values, that
is associative row by row; it needn't commute.  Inside a batch it is applied in rounds of
doubled distance, so a group of n rows takes log2(n) calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from lattix.plans.lineage import durable

Values = dict[str, np.ndarray]
Monoid = Callable[[Values, Values], Values]


def each(fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Monoid:
    """The monoid that applies ``fn`` (np.minimum, np.bitwise_or, ..) to each value by itself."""
    return lambda a, b: {k: fn(a[k], b[k]) for k in a}


def clamps(a: Values, b: Values) -> Values:
    """Composition of the functions x -> min(max(x + add, lo), hi), first ``a``, then ``b``."""
    inside = lambda x: np.minimum(np.maximum(x + b["add"], b["lo"]), b["hi"])
    return {"add": a["add"] + b["add"], "lo": inside(a["lo"]), "hi": inside(a["hi"])}


def latest(a: Values, b: Values) -> Values:
    """The later values where ``set`` is 1, else the earlier ones."""
    return {k: np.where(b["set"] == 1, b[k], a[k]) for k in a}


def in_ranges(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Rows in partitions that are contiguous in ``keys`` and sorted; written, so that a range keeps its number."""
    return durable(df.repartitionByRange(*keys).sortWithinPartitions(*keys))


def _starts(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """Whether a row's group is another one than that of the row before (the first row's is)."""
    out = np.zeros(batch.num_rows, bool)
    for k in by:
        c = batch.column(k)
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    out[0] = True
    return out


def scanned(x: Values, starts: np.ndarray, combine: Monoid) -> Values:
    """Inclusive scan of each run that begins at ``starts``."""
    group, n = np.cumsum(starts), len(starts)
    longest = int(np.diff(np.append(np.flatnonzero(starts), n)).max(initial=1))
    d = 1
    while d < longest:
        same = group[d:] == group[:-d]
        both = combine({k: v[:-d] for k, v in x.items()}, {k: v[d:] for k, v in x.items()})
        x = {k: np.concatenate([v[:d], np.where(same, both[k], v[d:])]) for k, v in x.items()}
        d *= 2
    return x


def _key(batch: pa.RecordBatch, by: list[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in by)


def scan(ranged: DataFrame, by: list[str], state: dict[str, Column], combine: Monoid, identity: dict[str, int | float], inclusive: bool = False) -> DataFrame:
    """The combined values of the group's earlier rows, under the names of ``state``; ``identity`` where there are none.

    ``ranged`` comes from ``in_ranges`` by ``by`` and then the order.  The values are bigint
    or double; nulls count as the identity.  ``inclusive`` adds the row's own values.  The
    result keeps ranges and order, so that it can be scanned again.
    """
    names = list(state)
    if clash := set(names) & set(ranged.columns):
        raise ValueError(f"the rows have columns of these names: {sorted(clash)}")
    given = ranged.withColumns({f"_in_{n}": F.coalesce(c, F.lit(identity[n])) for n, c in state.items()})
    kinds = {n: given.schema[f"_in_{n}"].dataType for n in names}
    values_of = lambda batch: {n: batch.column(f"_in_{n}").to_numpy() for n in names}

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = total = None
        whole = True
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch, by)
            x = scanned(values_of(batch), starts, combine)
            begins, ends = _key(batch, by, 0), _key(batch, by, -1)
            end = {n: v[-1:] for n, v in x.items()}
            one = starts.sum() == 1
            first = begins if first is None else first
            whole &= bool(one) and begins == first
            total = combine(total, end) if total is not None and one and begins == last else end
            last = ends
        if total is not None:
            row = {"_part": TaskContext.get().partitionId(), "_whole": whole} | {f"_first_{k}": v for k, v in zip(by, first, strict=True)}
            row |= {f"_last_{k}": v for k, v in zip(by, last, strict=True)} | {f"_in_{n}": v[0].item() for n, v in total.items()}
            yield pa.RecordBatch.from_pylist([row], tail_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    fields = StructType().add("_part", IntegerType()).add("_whole", BooleanType())
    for side in ("_first_", "_last_"):
        for k in by:
            fields = fields.add(side + k, ranged.schema[k].dataType)
    for n in names:
        fields = fields.add(f"_in_{n}", kinds[n])
    tail_schema = to_arrow_schema(fields)
    needed = given.select(*by, *[f"_in_{n}" for n in names])
    tails = sorted(needed.mapInArrow(tail, fields).collect(), key=lambda r: r["_part"])

    carried: dict[int, Values] = {}
    key, carry = None, None
    for r in tails:
        begins, ends = (tuple(r[s + k] for k in by) for s in ("_first_", "_last_"))
        total = {n: np.array([r[f"_in_{n}"]]) for n in names}
        if carry is not None and begins == key:
            carried[r["_part"]] = carry
            total = combine(carry, total) if r["_whole"] else total
        key, carry = ends, total

    schema, own = StructType(list(ranged.schema.fields)), list(ranged.columns)
    for n in names:
        schema = schema.add(n, kinds[n])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = carried.get(TaskContext.get().partitionId())
        key = None
        fresh = True
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch, by)
            x = scanned(values_of(batch), starts, combine)
            goes_on = held is not None and (fresh or _key(batch, by, 0) == key)
            if goes_on:
                m = int(np.append(np.flatnonzero(starts)[1:], batch.num_rows)[0])
                more = combine({n: np.repeat(v, m) for n, v in held.items()}, {n: v[:m] for n, v in x.items()})
                x = {n: np.concatenate([more[n], v[m:]]) for n, v in x.items()}
            out = x
            if not inclusive:
                out = {n: np.where(starts, identity[n], np.concatenate([v[:1], v[:-1]])).astype(v.dtype) for n, v in x.items()}
                if goes_on:
                    for n in names:
                        out[n][0] = held[n][0]
            held, key, fresh = {n: v[-1:] for n, v in x.items()}, _key(batch, by, -1), False
            columns = [batch.column(c) for c in own] + [pa.array(out[n]) for n in names]
            yield pa.RecordBatch.from_arrays(columns, [*own, *names])

    return given.mapInArrow(replay, schema)


def with_halo(ranged: DataFrame, rows: int, fn: Callable[[pa.Table, int], pa.Table], schema: str) -> DataFrame:
    """``fn(table, halo)`` over the batches of one series, each with up to ``rows`` of the rows before it on top.

    ``halo`` is how many of them there are (fewer only at the series' beginning); ``fn``
    returns rows for the rest.  ``ranged`` comes from ``in_ranges`` by the order.  The last
    rows of each range, ``rows`` a range, come to the driver and go to the next one.
    """
    kept = [f.name for f in ranged.schema.fields]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            held = held.slice(max(0, held.num_rows - rows)).combine_chunks()
        if held is not None and held.num_rows:
            part = pa.array([TaskContext.get().partitionId()] * held.num_rows, pa.int32())
            yield from held.append_column("_part", part).append_column("_at", pa.array(range(held.num_rows), pa.int32())).to_batches()

    last = ranged.mapInArrow(ends, StructType(list(ranged.schema.fields)).add("_part", IntegerType()).add("_at", IntegerType())).toArrow().sort_by([("_part", "ascending"), ("_at", "ascending")])
    parts = last.column("_part").to_numpy()
    last = last.select(kept).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = int(np.searchsorted(parts, TaskContext.get().partitionId()))
        held = last.slice(max(0, n - rows), min(n, rows))
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.concat_tables([held.cast(batch.schema), pa.Table.from_batches([batch])]).combine_chunks()
            yield from fn(t, held.num_rows).to_batches()
            held = t.slice(max(0, t.num_rows - rows))

    return ranged.mapInArrow(run, schema)
