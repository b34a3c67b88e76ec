"""Near-duplicate detection with HyperMinHash registers.

A document's set holds its distinct word shingles (lower-cased A-Z, words are runs
of other characters than ASCII white space).  Documents are linked when the sets'
Jaccard similarity is at least ``threshold_percent`` / 100, decided on full sets;
components of links are the classes, and the smallest id of each stays.

1. *Sketch*: a shingle's 64-bit hash names one of 128 buckets by its first 7 bits;
   a bucket's register compresses the least remaining value to 6 bits of leading
   zeros and 10 bits of mantissa.  A bucket without shingle takes its value from a
   hash of its own over all shingles, so a register agrees with probability J
   whatever the set's size.
2. *Equal sets* become one class each before anything else, so groups of copies
   count as one document from here on.
3. *Banding*: four 16-bit registers fill a 64-bit band key; 32 bands find a pair of
   J = 0.8 with probability 1 - (1 - 0.8 ** 4) ** 32 > 1 - 1e-7.
4. *Hubs*: in each bucket every member is compared with the bucket's least id only.
   Candidates whose collision-corrected estimate is at least ``floor`` (five standard
   deviations below the threshold), and whose sizes allow the threshold, are verified
   on full sets.
5. *Rest*: members of one bucket that are still in different components are compared
   by registers, in blocks of bounded size; components with a pair above the floor form
   a family.  Within a family, the full sets are compared in blocks of bounded rows and
   bytes, all but those within its largest component; a block emits links as a forest.
   So every pair of a bucket is compared unless verified links join it already, while
   rows grow with the documents, not with the pairs.  (Asking for the sets of estimated
   pairs only would need one row a pair: near the threshold all pairs of a group pass.)
6. *Components* of the links.

Shingles are compared as 64-bit hashes: two different shingles of a pair are taken
for one with probability below 1e-9 for sets of 100,000.

Edge cases: a text with fewer words than a shingle gives its whole word sequence as
one; a null text or one without words has the empty set, is linked with nothing and
stays.  Whole texts are read, however long (a worker takes some 30 bytes a word of the
longest one).  A row with a null id is linked with nothing, has a null component and
stays.  Rows that repeat an id are one document with the links of all its texts,
whatever their order; each row has its own n_shingles.  Other columns are ignored,
whatever their names; ids must be integers.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, fresh_join, parts_for
from .components import connected_components
from .kernels import U, mix, shingle_sets

BUCKET_BITS, MANTISSA_BITS, ROWS = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // ROWS
#: Members of a block of step 5, by registers and by full sets, and bytes of sets in a block.
REGISTER_BLOCK, BLOCK, BLOCK_BYTES = 512, 256, 8 << 20
#: Ids (8 bytes each) that may be broadcast to pick rows out of the texts; beyond it the texts are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Rows of two or three numbers that may be broadcast.
MAX_BROADCAST_ROWS = 300_000

_OWN_SEED = mix(np.arange(1, BUCKETS + 1, dtype=U) * U(0xA24BAED4963EE407))


def compress(v: np.ndarray) -> np.ndarray:
    """64-bit values to 16-bit registers: leading zeros (6 bits), then the mantissa's first 10 bits."""
    zeros = 53 - np.frexp((v >> U(11)).astype(np.float64))[1]  # 53 significant bits are exact in a double
    zeros = np.minimum(zeros, 53).astype(U)
    mantissa = np.where(zeros < 53, (v << zeros << U(1)) >> U(64 - MANTISSA_BITS), U(0))
    return (zeros << U(MANTISSA_BITS) | mantissa).astype(np.uint16)


def bucket_minima(s: np.ndarray) -> np.ndarray:
    """The 128 values that registers are made of, for a sorted set of hashes that isn't empty."""
    bucket = (s >> U(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    out = np.empty(BUCKETS, dtype=U)
    out[bucket[first]] = s[first] << U(BUCKET_BITS)
    if len(first) < BUCKETS:
        none = np.ones(BUCKETS, dtype=bool)
        none[bucket[first]] = False
        at = np.flatnonzero(none)
        out[at] = mix(s[None, :] ^ _OWN_SEED[at][:, None]).min(axis=1)
    return out


def collision_rate(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Chance that registers of disjoint sets agree: same leading zeros, then the same mantissa."""
    k = np.arange(54)
    # beyond one shingle a bucket on average, minima lie lower in proportion
    la, lb = (np.maximum(n, 1)[..., None] / BUCKETS for n in (na, nb))
    pa_, pb = (np.exp(-x * 2.0 ** -(k + 1)) - np.exp(-x * 2.0**-k) for x in (la, lb))
    return np.minimum((pa_ * pb).sum(-1), 1) / (1 << MANTISSA_BITS)


def estimate(agree: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of agreeing registers, corrected for chance collisions."""
    p = collision_rate(na, nb)
    return (agree / BUCKETS - p) / (1 - p)


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, digest, values = np.zeros(n, dtype=np.int64), [b""] * n, np.zeros((n, BUCKETS), dtype=U)
            for i, s in shingle_sets(batch.column(1), shingle):
                size[i] = len(s)
                if len(s):
                    digest[i] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    values[i] = bucket_minima(s)
            regs = compress(values)
            columns = [batch.column(0), pa.array(size), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "digest", "regs"])

    return run


def sketch(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_sketches(shingle), "id bigint, n bigint, digest binary, regs binary")


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for _, s in shingle_sets(batch.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), BUCKETS)


def _plausible(floor: float, percent: int):
    """Filter for rows (a, b, na, nb, ra, rb) by the estimate, and by sizes that allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                agree = (_registers(x.column(4)) == _registers(x.column(5))).sum(1)
                na, nb = x.column(2).to_numpy(), x.column(3).to_numpy()
                ok = (estimate(agree, na, nb) >= floor) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
                yield x.select([0, 1]).filter(pa.array(ok))

    return run


class _Forest:
    """Union-find over labels: ``join`` tells whether two were still apart."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str], fn) -> Iterator[pa.RecordBatch]:
    """``fn`` over each run of rows with equal ``keys`` (rows come sorted by them); runs may span batches."""
    held: pa.Table | None = None

    def done(group: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = fn(group) if group.num_rows > 1 else ([], [])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        key = np.stack([held.column(c).to_numpy() for c in keys])
        begin = 0
        for c in np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1:
            yield from done(held.slice(begin, c - begin))
            begin = c
        held = held.slice(begin)
    if held is not None:
        yield from done(held)


def _bridges(floor: float):
    """Rows (key, i, j, block, id, component, n, regs): pairs of components with plausible members, a forest a block pair."""

    def pairs(group: pa.Table) -> tuple[list[int], list[int]]:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        block, comp = group.column("block").to_numpy(), group.column("component").to_numpy()
        n, regs = group.column("n").to_numpy(), _registers(group.column("regs").combine_chunks())
        tree = comp.copy()  # components joined so far share a number, and aren't compared any more
        right = block == j
        a, b = [], []
        for x in np.flatnonzero(block == i):
            others = np.flatnonzero(right & (tree != tree[x]))
            if not len(others):
                continue
            agree = (regs[others] == regs[x]).sum(1)
            good = others[estimate(agree, np.full(len(others), n[x]), n[others]) >= floor]
            found, at = np.unique(tree[good], return_index=True)
            a += [int(comp[x])] * len(found)
            b += comp[good[at]].tolist()
            tree[np.isin(tree, found)] = tree[x]
        return a, b

    return lambda batches: _by_group(batches, ["key", "i", "j"], pairs)


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each left with each right set: products of 0/1 matrices, ``width`` columns at a time."""
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    compact = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    row, column = row[shared], compact[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)  # exact for whole numbers below 2 ** 24
    for begin in range(0, int(compact[-1]) + 1 if len(compact) else 0, width):
        lo, hi = np.searchsorted(column, [begin, begin + width])
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[row[lo:hi], column[lo:hi] - begin] = 1
        out += m[left] @ m[right].T
    return out.astype(np.int64)


def _family_links(percent: int):
    """Rows (family, i, j, block, id, component, set): verified links between components, a forest a block pair."""

    def pairs(group: pa.Table) -> tuple[list[int], list[int]]:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        block, comp, ids = (group.column(c).to_numpy() for c in ("block", "component", "id"))
        if len(np.unique(comp)) < 2:
            return [], []
        sets = [np.frombuffer(x.as_buffer(), dtype=U) for x in group.column("set").combine_chunks()]
        size = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        both = common(sets, left, right)
        near = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
        near &= comp[left][:, None] != comp[right][None, :]
        forest, a, b = _Forest(), [], []
        for x, y in zip(*np.nonzero(near), strict=True):
            x, y = left[x], right[y]
            if forest.join(int(comp[x]), int(comp[y])):
                a.append(int(ids[x]))
                b.append(int(ids[y]))
        return a, b

    return lambda batches: _by_group(batches, ["family", "i", "j"], pairs)


def _lookup(left: DataFrame, labels: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join of ``left`` with narrow, checkpointed rows: broadcast if a count proves them few."""
    small, few = broadcast_if_small(labels, MAX_BROADCAST_ROWS)
    return left.join(small, on, how) if few else fresh_join(left, labels, [on], how)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold_percent: int = 80,
    floor: float | None = None,
) -> DataFrame:
    """One row a document: id, n_shingles, component_id, kept."""
    t = threshold_percent / 100
    floor = max(0.0, t - 5 * (t * (1 - t) / BUCKETS) ** 0.5) if floor is None else floor
    sketches = durable(sketch(docs, id_col, text_col, shingle))
    known = sketches.filter("id is not null and n > 0")
    rows = sketches.count()
    # of rows with equal digest any has the class's registers
    classes = durable(known.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs")), parts_for(rows, 320))
    marks = F.xxhash64("digest")
    repeated = sketches.filter("id is not null").groupBy("id").agg(F.count("*").alias("rows"), F.min(marks).alias("lo"), F.max(marks).alias("hi"))
    repeated = durable(repeated.filter("rows > 1"), parts_for(rows, 16))
    has_repeats = repeated.limit(1).count() > 0
    n = classes.count()

    def key(b):
        return F.xxhash64(b, F.substring("regs", b * (2 * ROWS) + 1, 2 * ROWS))

    bands = classes.select("id", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)).alias("key"))
    shared = durable(bands.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).filter("size > 1"), parts_for(n * BANDS, 24))
    buckets = durable(_lookup(bands, shared, "key", "inner").select("key", "id", "n", "hub", "size"), parts_for(n * BANDS, 40))

    def full_sets(ids: DataFrame) -> DataFrame:
        """(id, set) of some ids (a checkpointed frame), each text once."""
        wanted, _ = broadcast_if_small(ids, MAX_BROADCAST_IDS)
        texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).join(wanted, "id", "left_semi")
        sets = durable(texts.mapInArrow(_sets(shingle), "id bigint, set binary"))
        return sets.withColumn("_mark", F.xxhash64("set")).dropDuplicates(["id", "_mark"]).drop("_mark") if has_repeats else sets

    def linked(pairs: DataFrame) -> DataFrame:
        """Of plausible pairs (a, b), those that full sets confirm."""
        sets = full_sets(durable(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), parts_for(n, 16)))
        first = fresh_join(pairs.withColumnRenamed("a", "id"), sets, ["id"]).select(F.col("id").alias("a"), F.col("b").alias("id"), F.col("set").alias("sa"))
        full = fresh_join(first, sets, ["id"]).select("a", F.col("id").alias("b"), "sa", F.col("set").alias("sb"))
        return full.mapInArrow(_verified(threshold_percent), "a bigint, b bigint")

    hubs = buckets.filter("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    small = classes.select("id", "n", "regs")
    one = fresh_join(hubs.withColumnRenamed("b", "id"), small, ["id"]).select(F.col("a").alias("id"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    two = fresh_join(one, small, ["id"]).select(F.col("id").alias("a"), "b", F.col("n").alias("na"), "nb", F.col("regs").alias("ra"), "rb")
    links = linked(durable(two.mapInArrow(_plausible(floor, threshold_percent), "a bigint, b bigint"), parts_for(n * 4, 16)))
    if has_repeats:
        links = links.unionByName(_own_links(known, repeated, classes))
    links = durable(links, parts_for(n * 4, 16))
    labels = connected_components(links)

    # what hubs left open: buckets whose members are in several components
    placed = _lookup(buckets.filter("size > 2").select("key", "id", "n", "size"), labels, "id").withColumn("component", F.coalesce("component", "id"))
    mixed = durable(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key"), parts_for(n * 4, 16))
    if mixed.limit(1).count():
        open_ = durable(_lookup(placed, mixed, "key", "inner"), parts_for(n * 8, 40))  # of two members, one was the hub
        blocks = F.ceil(F.col("size") / REGISTER_BLOCK).cast("int")
        spread = fresh_join(open_.drop("n"), small, ["id"]).withColumn("block", F.pmod(F.hash("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        grouped = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "n", "regs")
        sorted_ = grouped.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        bridges = durable(sorted_.mapInArrow(_bridges(floor), "a bigint, b bigint").distinct(), parts_for(n * 4, 16))
        if bridges.limit(1).count():
            families = connected_components(bridges).select(F.col("id").alias("component"), F.col("component").alias("family"))
            members = durable(_lookup(open_.select("id", "n", "component").distinct(), families, "component", "inner"), parts_for(n, 32))
            extra = durable(_links_in_families(members, full_sets, threshold_percent), parts_for(n * 4, 16))
            if extra.limit(1).count():
                labels = connected_components(links.union(extra))

    found = _lookup(classes.select("digest", "id"), labels, "id").select("digest", F.coalesce("component", "id").alias("component"))
    out = fresh_join(sketches.select("id", "n", "digest"), found, ["digest"], "left")
    out = out.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    if has_repeats:
        least = durable(out.join(repeated.select("id"), "id", "left_semi").groupBy("id").agg(F.min("component_id").alias("least")))
        out = _lookup(out, least, "id").select("id", "n", F.coalesce("least", "component_id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _own_links(known: DataFrame, repeated: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of one id's different texts."""
    several = known.select("id", "digest").join(repeated.filter("lo != hi").select("id"), "id", "left_semi").distinct()
    classed = several.join(classes.select("digest", F.col("id").alias("rep")), "digest").select("id", "rep")
    firsts = classed.groupBy("id").agg(F.min("rep").alias("a"))
    return classed.join(firsts, "id").select("a", F.col("rep").alias("b")).filter("a != b")


def _links_in_families(members: DataFrame, full_sets, percent: int) -> DataFrame:
    """Verified links (a, b) between different components of each family; members: id, n, component, family."""
    sizes = members.groupBy("family", "component").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    whole = sizes.groupBy("family").agg(
        F.max_by("component", F.struct("m", "component")).alias("largest"),
        F.max(F.struct("m", "component", "s")).alias("top"),
        F.sum("m").alias("all"),
        F.sum("s").alias("all_s"),
    )
    blocks = lambda m, s: F.greatest(F.ceil(m / BLOCK), F.ceil(s * 8 / BLOCK_BYTES)).cast("int")
    outer, inner = blocks(F.col("all") - F.col("top.m"), F.col("all_s") - F.col("top.s")), blocks(F.col("top.m"), F.col("top.s"))
    whole = whole.select("family", "largest", F.greatest(outer, F.lit(1)).alias("outer_blocks"), inner.alias("inner_blocks"))
    placed = fresh_join(members, whole, ["family"]).withColumn("inner", F.col("component") == F.col("largest"))
    own = F.when(F.col("inner"), F.col("outer_blocks") + F.pmod(F.hash("id"), F.col("inner_blocks"))).otherwise(F.pmod(F.hash("id"), F.col("outer_blocks")))
    # members of the largest component meet the other ones only
    partners = F.when(F.col("inner"), F.col("outer_blocks")).otherwise(F.col("outer_blocks") + F.col("inner_blocks"))
    spread = placed.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), partners - 1)))
    with_sets = fresh_join(spread, full_sets(members.select("id")), ["id"])
    rows = with_sets.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "set")
    sorted_ = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return sorted_.mapInArrow(_family_links(percent), "a bigint, b bigint")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold_percent: int = 80) -> DataFrame:
    """``docs``, same columns, with one document of each class."""
    gone = durable(near_duplicates(docs, id_col, text_col, shingle, threshold_percent).filter("not kept").select(F.col(id_col).alias("__lx_id")).distinct())
    gone, _ = broadcast_if_small(gone, MAX_BROADCAST_IDS)
    return docs.join(gone, docs[id_col] == gone["__lx_id"], "left_anti")
