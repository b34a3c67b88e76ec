"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Two vectors of one label link if their cosine, in double precision, reaches the threshold.
Equal vectors of a label are one class first, so copies are compared once.  A label's
classes are dealt by hash over blocks of about ``TILE`` vectors, and each pair of blocks of
a label is one tile, so a label that holds most rows is spread over many tasks.

A unit vector u is stored as q = rint(u / s) in int8 with s = max|u| / 127, and with the
norm e of what is lost, r = u - s q.  For two of them

    u.v = s_u s_v (q_u.q_v) + s_u q_u.r_v + r_u.v,   so   |u.v - s_u s_v (q_u.q_v)| <= |s_u q_u| e_v + e_u

by Cauchy and Schwarz, with ``SLACK`` for rounding.  A tile's products of integers are exact.
A pair whose estimate is above the threshold by its bound is a link, one below it by its
bound is none; only the pairs between are recomputed from the full vectors, which travel
to the tiles that have such pairs and to no others.

A tile returns a row a linked vector: the number of its links and the smallest id of its
component inside the tile, never the pairs.  Undecided pairs are one packed value a tile.
Components over all tiles are solved by ``connected_components``.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null label or a null id, link with nothing: 0 links, their own component.
Vectors of different length don't link.  Copies link with each other.  Rows that repeat an
id are each a vector with its own links; groups of copies that share their smallest id are
one node of the components.  Ties can't occur: the smallest id stands for a component.  An
empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, fresh_join
from .components import connected_components, solve

#: Vectors of a block, about; a tile compares the square of it.
TILE = 1024
#: For rounding in double precision, far above it.
SLACK = 1e-9
#: Labels (with the number of their blocks, some 60 bytes) that may be broadcast.
MAX_BROADCAST_LABELS = 200_000
#: Pairs that are recomputed at once.
PAIRS = 1 << 16


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (nulls not a number), start of each row, and whether a row is a vector of finite values that aren't all zero."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    values = pc.fill_null(pc.cast(column.flatten(), pa.float64()), float("nan")).to_numpy()
    starts = np.concatenate([[0], np.cumsum(lengths)])
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[starts])
    return values, starts, (count(~np.isfinite(values)) == 0) & (count(values != 0) > 0)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of their own precision; null where a row takes no part."""
    for batch in batches:
        values, starts, good = vectors_of(batch.column("_vec"))
        kept = values.astype(np.float32) if pa.types.is_float32(batch.column("_vec").type.value_type) else values
        cells = [kept[a:b].tobytes() if ok else None for a, b, ok in zip(starts, starts[1:], good, strict=False)]
        dims = pa.array(np.diff(starts).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), dims, pa.array(cells, pa.binary())], ["id", "label", "dim", "vec"])


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and norms of what is lost, of unit vectors as rows."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - scale[:, None] * q, axis=1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1)[:, None]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 rows: single precision holds the sums of up to 1,024 products."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


def _array(table: pa.Table, name: str, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(table.column(name)[row].as_py(), kind)


def decide(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of two blocks (q, scale, lost) certainly link, and which may but needn't."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    estimate = products(qa, qb) * sa[:, None] * sb[None, :]
    norm = sa * np.sqrt((qa.astype(np.float64) ** 2).sum(axis=1))
    bound = norm[:, None] * eb[None, :] + ea[:, None] + SLACK
    certain = estimate - bound >= threshold
    return certain, (estimate + bound >= threshold) & ~certain


def _linked(keys: dict, ids: tuple, marks: tuple, copies: tuple, i: np.ndarray, j: np.ndarray, same: bool) -> dict:
    """A row for each vector of the links (i, j): the weighted number of its links and the root of its component."""
    n_a = np.bincount(i, copies[1][j], len(ids[0]))
    n_b = np.bincount(j, copies[0][i], len(ids[1]))
    nodes, roots = solve(ids[0][i], ids[1][j])
    sides = [(ids[0], marks[0], n_a + n_b)] if same else [(ids[0], marks[0], n_a), (ids[1], marks[1], n_b)]
    rep = np.concatenate([s[0][s[2] > 0] for s in sides])
    out = {
        "rep": rep,
        "mark": np.concatenate([s[1][s[2] > 0] for s in sides]),
        "n": np.concatenate([s[2][s[2] > 0] for s in sides]).astype(np.int64),
        "root": roots[np.searchsorted(nodes, rep)],
    }
    return {k: pa.array([v] * len(rep), t) for k, (v, t) in keys.items()} | {k: pa.array(v) for k, v in out.items()}


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", tile: int = TILE
) -> DataFrame:
    """One row a vector: id, n_links (other vectors linked directly), component_id, kept."""
    kind = vectors.schema[label_col].dataType.simpleString()
    picked = vectors.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).alias("_label"), F.col(vec_col).alias("_vec"))
    rows = picked.mapInArrow(_packed, f"id bigint, label {kind}, dim int, vec binary")
    part = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = rows.withColumn("digest", F.when(part, F.unhex(F.sha2("vec", 256))))

    grouped = rows.filter("digest IS NOT NULL").groupBy("label", "dim", "digest", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = durable(grouped.withColumn("mark", F.xxhash64("digest")))
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    sizes, fits = broadcast_if_small(sizes, MAX_BROADCAST_LABELS)
    sized = classes.join(sizes, ["label", "dim"]) if fits else fresh_join(classes, sizes, ["label", "dim"])
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        raw = b"".join(t.column("vec").to_pylist())
        x = np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * t.num_rows else np.float64).reshape(-1, dim)
        q, scale, lost = quantised(unit_rows(x.astype(np.float64)))
        binary = {"reps": t.column("rep").to_numpy(), "marks": t.column("mark").to_numpy(), "copies": t.column("copies").to_numpy(), "q": q, "scale": scale, "lost": lost, "full": x}
        out = {k: t.column(k).slice(0, 1) for k in ("label", "dim", "block", "blocks")}
        return pa.table(out | {k: pa.array([v.tobytes()], pa.binary()) for k, v in binary.items()})

    narrow = "reps binary, marks binary, copies binary"
    packed = durable(
        dealt.select("label", "dim", "block", "blocks", "rep", "mark", "copies", "vec")
        .groupBy("label", "dim", "block")
        .applyInArrow(pack, f"label {kind}, dim int, block int, blocks int, {narrow}, q binary, scale binary, lost binary, full binary")
    )

    label_type = {"dim": pa.int32(), "lo": pa.int32(), "hi": pa.int32()}
    result = f"label {kind}, dim int, lo int, hi int, rep bigint, mark bigint, n bigint, root bigint, pairs binary"

    def sides(t: pa.Table) -> tuple[int, int] | None:
        """Row numbers of a tile's two blocks; a block may be empty and so be missing."""
        at = {b: k for k, b in enumerate(t.column("block").to_pylist())}
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        return (at[lo], at[hi]) if lo in at and hi in at else None

    def result_of(t: pa.Table, found: dict | None, pairs: bytes | None) -> pa.Table:
        kinds = pa.schema([("label", t.column("label").type), *label_type.items(), ("rep", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("pairs", pa.binary())])
        tables = []
        if found is not None:
            tables.append(pa.table(found | {"pairs": pa.nulls(len(found["rep"]), pa.binary())}, schema=kinds))
        if pairs:
            one = {k: t.column(k).slice(0, 1).combine_chunks() for k in ("label", *label_type)}
            tables.append(pa.table(one | {k: pa.nulls(1, pa.int64()) for k in ("rep", "mark", "n", "root")} | {"pairs": pa.array([pairs], pa.binary())}, schema=kinds))
        return pa.concat_tables(tables) if tables else kinds.empty_table()

    def read(t: pa.Table, at: tuple[int, int]) -> tuple[dict, tuple, tuple, tuple]:
        keys = {k: (t.column(k)[0].as_py(), t.column(k).type) for k in ("label", *label_type)}
        return keys, *(tuple(_array(t, n, k, np.int64) for k in at) for n in ("reps", "marks", "copies"))

    def compare(t: pa.Table) -> pa.Table:
        at = sides(t)
        if at is None:
            return result_of(t, None, None)
        dim, same = t.column("dim")[0].as_py(), at[0] == at[1]
        a, b = ((_array(t, "q", k, np.int8).reshape(-1, dim), _array(t, "scale", k, np.float64), _array(t, "lost", k, np.float64)) for k in at)
        certain, unsure = decide(a, b, threshold)
        if same:
            certain, unsure = np.triu(certain, 1), np.triu(unsure, 1)
        i, j = np.nonzero(certain)
        return result_of(t, _linked(*read(t, at), i, j, same) if len(i) else None, np.flatnonzero(unsure).astype(np.int64).tobytes())

    def recompute(t: pa.Table) -> pa.Table:
        at = sides(t)
        dim, same = t.column("dim")[0].as_py(), at[0] == at[1]
        keys, ids, marks, copies = read(t, at)
        x, y = (np.frombuffer(raw := t.column("full")[k].as_py(), np.float32 if len(raw) == 4 * dim * len(n) else np.float64).reshape(-1, dim) for k, n in zip(at, ids, strict=True))
        pairs = _array(t, "pairs", at[0], np.int64)
        kept = []
        for k in range(0, len(pairs), PAIRS):
            i, j = np.divmod(pairs[k : k + PAIRS], len(y))
            kept.append(pairs[k : k + PAIRS][cosines(x[i], y[j]) >= threshold])
        i, j = np.divmod(np.concatenate(kept), len(y))
        return result_of(t, _linked(keys, ids, marks, copies, i, j, same) if len(i) else None, None)

    narrow_blocks = packed.drop("full").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = narrow_blocks.withColumns({"lo": F.least("block", "_other"), "hi": F.greatest("block", "_other")}).drop("_other", "blocks")
    tiles = durable(met.groupBy("label", "dim", "lo", "hi").applyInArrow(compare, result))

    open_tiles = tiles.filter("pairs IS NOT NULL").select("label", "dim", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"), "pairs")
    open_tiles = open_tiles.withColumn("pairs", F.when(F.col("block") == F.col("lo"), F.col("pairs")))
    whole = fresh_join(open_tiles, packed.select("label", "dim", "block", "reps", "marks", "copies", "full"), ["label", "dim", "block"])
    settled = whole.groupBy("label", "dim", "lo", "hi").applyInArrow(recompute, result)
    links = durable(tiles.filter("rep IS NOT NULL").union(settled).select("rep", "mark", "n", "root"))

    counts = links.groupBy("rep", "mark").agg(F.sum("n").alias("n"))
    components = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = classes.select("label", "digest", "rep", "mark", "copies").join(counts, ["rep", "mark"], "left")
    known = known.join(components.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("label", "digest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = fresh_join(rows.select("id", "label", "digest"), known, ["label", "digest"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    x, y = (v / 2.0 ** np.frexp(np.abs(v).max(axis=1))[1][:, None] for v in (x, y))  # powers of two: exact
    dots = np.einsum("ij,ij->i", x, y)
    return dots / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
