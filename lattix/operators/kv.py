"""Keyed state: upsert, lookup, read-modify-write, and set membership by Bloom filter."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.operators.ordered import groups_fit, sums_before
from lattix.operators.scans import in_ranges, latest, scan
from lattix.plans.lineage import durable


def upsert_last(writes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The table after all writes in ``order``: the last write of each key wins.

    One aggregation with map-side combining; the row travels as a struct, so a hot
    key sends one row a partition.
    """
    rest = [c for c in writes.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return writes.groupBy(key).agg(last.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*writes.columns)


def modify(writes: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """Read-modify-write with an associative function: one aggregation a key."""
    return writes.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()])


def modify_ordered(writes: DataFrame, key: str, order: str, value: str, zero: Column, fn: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """Read-modify-write with a function that isn't associative: a fold of each key's values in order."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    return writes.groupBy(key).agg(F.aggregate(values, zero, fn).alias(out))


def find(probe: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Lookup: the probe's rows with the store's values, and whether the key was found (absent values are null)."""
    return probe.join(store.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def present(probe: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return probe.join(store.select(key), key, "left_semi")


def absent(probe: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return probe.join(store.select(key), key, "left_anti")


def find_or_insert(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The store with the new rows whose key it lacks (an extension: a real insert)."""
    return store.unionByName(absent(new, store, key))


def fetch_add(df: DataFrame, cell: list[str], order: list[str], amount: Column, out: str = "before") -> DataFrame:
    """Value that each fetch-and-add sees: the sum of the cell's earlier amounts, 0 for the first."""
    return sums_before(df, cell, order, amount, out)


#: Operations of fetch-and-op: the function of two operands, and the operand that changes nothing.
FETCH_OPS = {
    "or": (np.bitwise_or, 0),
    "xor": (np.bitwise_xor, 0),
    "and": (np.bitwise_and, -1),
    "add": (np.add, 0),
    "min": (np.minimum, float("inf")),
    "max": (np.maximum, float("-inf")),
}


def fetch_before(df: DataFrame, cell: list[str], order: list[str], **operands: tuple[str, Column]) -> DataFrame:
    """Value that each fetch-and-op sees: (op, operand) of ``FETCH_OPS`` over the cell's earlier operands, null for the first.

    One scan serves all operations; a cell may hold any share of all rows, even all of them
    (``cell=[]``).  Operands of or, xor, and, add are bigint, those of min and max double.
    """
    ops = {n: FETCH_OPS[op] for n, (op, _) in operands.items()}
    state = {n: c.cast("double" if isinstance(ops[n][1], float) else "bigint") for n, (_, c) in operands.items()}
    combine = lambda a, b: {k: ops[k][0](a[k], b[k]) if k in ops else a[k] + b[k] for k in a}
    seen = scan(in_ranges(df, [*cell, *order]), cell, state | {"_n": F.lit(1).cast("bigint")}, combine, {n: i for n, (_, i) in ops.items()} | {"_n": 0})
    return seen.withColumns({n: F.when(F.col("_n") > 0, F.col(n)) for n in ops}).drop("_n")


def compare_and_swap(df: DataFrame, cell: str, order: str, expected: str, new: str, start: int = 0, group_rows: int | None = None) -> DataFrame:
    """Outcome of each attempt to swap a cell's value: (cell, order, seen, swapped), in ``order``.

    Equal places in the order are told apart by ``expected``, then ``new``.  A null
    ``expected`` fits no value; a null ``new`` leaves a null, which nothing fits.  Cells that
    a count proves to have at most ``group_rows`` attempts are played one group a task;
    otherwise a cell may have any share of all attempts (``_swaps_in_ranges``).
    """
    attempts = df.select(cell, order, F.col(expected).cast("bigint").alias("_old"), F.col(new).cast("bigint").alias("_new"))
    if not groups_fit(df, [cell], group_rows):
        return _swaps_in_ranges(attempts, cell, order, start)

    def play(t: pa.Table) -> pa.Table:
        t = t.sort_by([(order, "ascending"), ("_old", "ascending"), ("_new", "ascending")])
        value, seen, swapped = start, [], []
        for old, to in zip(t.column("_old").to_pylist(), t.column("_new").to_pylist(), strict=True):
            seen.append(value)
            swapped.append(old is not None and value == old)
            value = to if swapped[-1] else value
        return pa.table({cell: t.column(cell), order: t.column(order), "seen": pa.array(seen, pa.int64()), "swapped": pa.array(swapped, pa.bool_())})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return attempts.groupBy(cell).applyInArrow(play, f"{cell} {kinds[cell]}, {order} {kinds[order]}, seen bigint, swapped boolean")


def _swaps_in_ranges(attempts: DataFrame, cell: str, order: str, start: int) -> DataFrame:
    """``compare_and_swap`` for cells of any size, as a walk along pointers.

    After a successful attempt the next success is the cell's next attempt that expects the
    value just set, whatever lies between.  So each attempt points to the one that would
    follow it, found by a scan of attempts by value from the latest to the earliest, and the
    successes are the attempts on the path from the first that expects ``start``.  The path
    is marked by pointer doubling: log2 of its length rounds of joins on unique attempts
    (many may point to one; adaptive execution splits such a partition).  A last scan carries
    the value set by the latest success to the attempts that see it.
    """
    by_value, number = ["_cell", "_value"], lambda c: F.col(c).cast("bigint")
    add = lambda a, b: {k: a[k] + b[k] for k in a}
    ranged = in_ranges(attempts, [cell, order, F.col("_old").asc_nulls_last(), F.col("_new").asc_nulls_last()])
    placed = durable(scan(ranged, [], {"_id": F.lit(1).cast("bigint")}, add, {"_id": 0}))
    offers = placed.filter("_old IS NOT NULL").select(F.col(cell).alias("_cell"), F.col("_old").alias("_value"), "_id", F.lit(1).cast("bigint").alias("_offer"))
    seekers = placed.filter("_new IS NOT NULL").select(F.col(cell).alias("_cell"), F.col("_new").alias("_value"), "_id", F.lit(0).cast("bigint").alias("_offer"))
    roots = placed.select(F.col(cell).alias("_cell")).distinct().select("_cell", F.lit(start).cast("bigint").alias("_value"), F.lit(-1).cast("bigint").alias("_id"), F.lit(0).cast("bigint").alias("_offer"))
    # from the latest attempt to the earliest; an attempt looks for a later one before it offers itself
    back = in_ranges(offers.union(seekers).union(roots), [*by_value, F.col("_id").desc(), F.col("_offer")])
    linked = scan(back, by_value, {"set": number("_offer"), "_next": number("_id")}, latest, {"set": 0, "_next": -1})
    links = durable(linked.filter("_offer = 0 AND set = 1").select("_id", "_next"))
    marked = links.filter("_id = -1").select(F.col("_next").alias("_id"))
    links = links.filter("_id >= 0")
    while True:  # the first 2 ** k successes of each cell are marked, and links reach 2 ** k successes ahead
        further = durable(marked.join(links, "_id").select(F.col("_next").alias("_id")))
        if further.isEmpty():
            break
        marked = durable(marked.union(further))
        links = durable(links.join(links.select(F.col("_id").alias("_next"), F.col("_next").alias("_far")), "_next").select("_id", F.col("_far").alias("_next")))
    played = placed.join(marked.withColumn("swapped", F.lit(True)), "_id", "left").withColumn("swapped", F.coalesce("swapped", F.lit(False)))
    value = {"set": number("swapped"), "seen": F.col("_new"), "_nil": F.col("_new").isNull().cast("bigint")}
    seen = scan(in_ranges(played, ["_id"]), [cell], value, latest, {"set": 0, "seen": start, "_nil": 0})
    found = F.when(F.col("set") == 0, F.lit(start).cast("bigint")).when(F.col("_nil") == 0, F.col("seen"))  # a group without a success yet carries no value
    return seen.select(cell, order, found.alias("seen"), "swapped")


def insert_bounded(df: DataFrame, host: str, order: str, key: str, capacity: int) -> DataFrame:
    """Inserts into each host's table of ``capacity`` slots: (host, order, key, slot, accepted).

    A key probes the slots key + p * p, so an insert may fail before the table is full; a
    key that is there already keeps its slot.  A slot depends on all earlier inserts, so a
    host's table is one group, of which ``capacity`` entries are held.
    """

    def play(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        table: dict[int, int] = {}
        slots = []
        for k in t.column(key).to_pylist():
            found = next((s for p in range(capacity) if table.get(s := (k + p * p) % capacity, k) == k), None)
            if found is not None:
                table[found] = k
            slots.append(found)
        return pa.table({host: t.column(host), order: t.column(order), key: t.column(key), "slot": pa.array(slots, pa.int32()), "accepted": pa.array([s is not None for s in slots])})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(host, order, key).groupBy(host).applyInArrow(play, f"{host} {kinds[host]}, {order} {kinds[order]}, {key} {kinds[key]}, slot int, accepted boolean")


def segment(slot: Column, slots: int, hosts: int) -> Column:
    """Host that holds a slot when the table is cut into equal segments."""
    return F.floor(slot / -(-slots // hosts))


def insert_local(df: DataFrame, host: str, slot: Column, slots: int, hosts: int) -> DataFrame:
    """Inserts that a host may do in its own segment: ``accepted`` is false where the slot lies elsewhere."""
    return df.withColumn("accepted", segment(slot, slots, hosts) == F.col(host))


def iterate(df: DataFrame, key: str, host: Column) -> DataFrame:
    """Local iteration: entries, first and last key of each host's part."""
    return df.groupBy(host.alias("host")).agg(F.count("*").alias("entries"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def reference(probe: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """``m[k]``: the store's values, null where the key is absent."""
    return probe.join(store, key, "left")


def lookup_entries(args: DataFrame, entries: DataFrame, target: str) -> DataFrame:
    """Host entries of the targets that tasks name as arguments; a target without one is an error."""
    got = args.join(entries.withColumn("_there", F.lit(True)), target, "left")
    return got.filter(F.when(F.col("_there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no entry for "), F.col(target).cast("string"))).cast("boolean"))).drop("_there")


def fetch_bits(df: DataFrame, cell: list[str], value: Column) -> DataFrame:
    """Final values of fetch-and-or, -and and -xor."""
    return df.groupBy(*cell).agg(F.bit_or(value).alias("bits_or"), F.bit_and(value).alias("bits_and"), F.bit_xor(value).alias("bits_xor"))


def bloom_shape(n: int, p: float = 0.01, hosts: int = 1) -> tuple[int, int]:
    """(bits set an element, buckets of 64 bits) for ``n`` elements and false-positive rate ``p`` (below 1)."""
    k = max(1, round(math.log2(1 / p)))
    per_element = math.log2(1 / p) / math.log(2)
    # a block of one word holds fewer elements than a filter of independent bits: by a factor of -ln p
    per_bucket = 64 / per_element / math.log(1 / p)
    buckets = max(1, round(n / per_bucket))
    return k, -(-buckets // hosts) * hosts


def _slot(key: Column, k: int, buckets: int) -> tuple[Column, Column]:
    """Bucket and bit mask of a key: a blocked filter keeps all bits of an element in one word."""
    mask = F.lit(0).cast("bigint")
    for i in range(k):
        bit = F.pmod(F.xxhash64(key, F.lit(i + 1)), F.lit(64)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return F.pmod(F.xxhash64(key), F.lit(buckets)), mask


def bloom_build(df: DataFrame, key: str, k: int, buckets: int) -> DataFrame:
    """The filter as rows (bucket, word): words are combined by bit_or before and after the shuffle."""
    bucket, mask = _slot(F.col(key), k, buckets)
    return df.filter(F.col(key).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.bit_or(mask).alias("word"))


def bloom_probe(df: DataFrame, bloom: DataFrame, key: str, k: int, buckets: int) -> DataFrame:
    """Rows whose key may be in the filter: no false negatives."""
    bucket, mask = _slot(F.col(key), k, buckets)
    hit = df.withColumns({"bucket": bucket, "_mask": mask}).join(bloom, "bucket")
    return hit.filter(F.col("word").bitwiseAND(F.col("_mask")) == F.col("_mask")).drop("bucket", "_mask", "word")


def bloom_insert_flags(df: DataFrame, key: str, order: list[str], k: int, buckets: int) -> DataFrame:
    """Each insert's ``maybe_present``: whether all its bits were set by earlier inserts."""
    bucket, mask = _slot(F.col(key), k, buckets)
    w = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({"_bucket": bucket, "_mask": mask}).withColumn("_set", F.coalesce(F.bit_or("_mask").over(w), F.lit(0).cast("bigint")))
    return rows.withColumn("maybe_present", F.col("_set").bitwiseAND(F.col("_mask")) == F.col("_mask")).drop("_bucket", "_mask", "_set")


#: Words (8 bytes, and as much for their numbers) of a filter that may be broadcast.
MAX_BROADCAST_WORDS = 1_000_000


def bloom_semi_join(df: DataFrame, members: DataFrame, key: str, n: int, p: float = 0.01) -> DataFrame:
    """Exact semi join behind a Bloom filter that drops most non-members before the shuffle.

    The filter is broadcast, as its size follows from ``n``; where it would be too large, a
    plain semi join shuffles the probe side once.
    """
    k, buckets = bloom_shape(n, p)
    if buckets > MAX_BROADCAST_WORDS:
        return present(df, members, key)
    return present(bloom_probe(df, F.broadcast(bloom_build(members, key, k, buckets)), key, k, buckets), members, key)
