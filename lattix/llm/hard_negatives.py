"""Hard negatives by a two-dimensional block matrix product.

Each component x of a vector becomes the integer floor(256 x), and a row's score for an
anchor is their inner product.  Anchors are a stated query set: the rows whose id is
divisible by ``every``.  Rows are dealt by hash over row blocks, and their dimensions over
chunks.  A task holds one chunk of one anchor block and of one row block, and makes a tile
of partial scores in int64; the tiles of a pair of blocks are shuffled together and added
over the chunks, and the sum is reduced to the first rows of each window inside the tile.
The tiles' winners are then ranked once more a window.

This runs twice.  First among rows of the same label (rows are dealt by buckets of labels,
so few tiles hold other labels): an anchor's ``positives`` first rows.  Then over all rows:
for each anchor and positive the ``negatives`` first rows of other labels whose score lies
within the window ``low`` * positive <= 100 * score <= ``high`` * positive.  The windows
travel with the anchors, so a tile needs no other look-up, and no score leaves its tile
but those that may rank.

Edge cases: rows with a null label, a null vector, a null id, or any null or non-finite
component take no part; an empty vector scores 0 with all.  Of vectors of different length
the missing components count as 0.  Ties rank by the smaller id.  Of rows that repeat an
id one takes part, the smallest by (label, vector).  Labels are integers.  Without
positives an anchor has no row, and no rows give an empty result.  A component beyond
2 ** 31 / 256, or products that may leave int64, are an error and not a wrong score.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, fresh_join
from .vector_dedup import vectors_of

#: Rows of a block, anchors of a block, dimensions of a chunk.
ROWS, ANCHORS, DIMS = 4096, 256, 32
#: Buckets of labels (with the number of their blocks, some 60 bytes) that may be broadcast.
MAX_BROADCAST_BUCKETS = 200_000

_PACKED = "g bigint, block int, others int, k int, n int, ids binary, labels binary, chunk binary, windows binary"


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part, with their integers as bytes."""
    for batch in batches:
        values, starts, _ = vectors_of(batch.column("_vec"))
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])[starts]
        good = (np.diff(bad) == 0) & batch.column("_vec").is_valid().to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore"):
            q = np.floor(256 * values)
        if (np.abs(q[np.isfinite(q)]) >= 2**31).any() or (np.isinf(q) & np.isfinite(values)).any():
            raise OverflowError("a component is beyond 2 ** 31 / 256")
        q = np.where(np.isfinite(q), q, 0).astype(np.int32)
        cells = [q[a:b].tobytes() if ok else None for a, b, ok in zip(starts, starts[1:], good, strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(cells, pa.binary())], ["id", "label", "q"])


def partial_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows in int64; by floating point where doubles hold every sum."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**62:
        raise OverflowError("scores may leave int64")
    return a @ b.T


def first_of(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` places with the highest scores, highest first, ties by place."""
    if len(places) > k:
        least = np.partition(scores[places], len(places) - k)[len(places) - k]
        places = places[scores[places] >= least]
    return places[np.argsort(-scores[places], kind="stable")][:k]


def _pack(width: int, dims: int) -> Callable[[pa.Table], pa.Table]:
    """A block's chunks: ids, labels and windows travel with the first one."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")  # so that the first of equal scores has the smallest id
        q = np.zeros((t.num_rows, width), np.int32)
        for row, cell in enumerate(t.column("q").to_pylist()):
            values = np.frombuffer(cell, np.int32)
            q[row, : len(values)] = values
        chunks = [np.ascontiguousarray(q[:, at : at + dims]).tobytes() for at in range(0, width, dims)]
        first = lambda x: pa.array([x, *[None] * (len(chunks) - 1)], pa.binary())
        windows = [w or [] for w in t.column("windows").to_pylist()] if "windows" in t.column_names else []
        flat = [(row, w["positive_id"], w["score"]) for row, ws in enumerate(windows) for w in ws]
        same = {c: pa.array([t.column(c)[0].as_py()] * len(chunks), t.column(c).type) for c in ("g", "block", "others")}
        return pa.table(
            same
            | {
                "k": pa.array(range(len(chunks)), pa.int32()),
                "n": pa.array([t.num_rows] * len(chunks), pa.int32()),
                "ids": first(t.column("id").to_numpy().tobytes()),
                "labels": first(t.column("label").to_numpy().tobytes()),
                "chunk": pa.array(chunks, pa.binary()),
                "windows": first(np.array(flat, np.int64).tobytes()),
            }
        )

    return pack


def _multiply(t: pa.Table) -> pa.Table:
    """Partial scores of one chunk of an anchor block and of a row block, with what the first chunks carry."""
    side = t.column("side").to_pylist()
    kinds = [("g", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), *((c, pa.binary()) for c in ("scores", "a_ids", "a_labels", "windows", "ids", "labels"))]
    if len(side) < 2:  # a block without rows
        return pa.schema(kinds).empty_table()
    a, b = side.index(0), side.index(1)
    k = t.column("k")[0].as_py()
    sizes = [t.column("n")[x].as_py() for x in (a, b)]
    x, y = (np.frombuffer(t.column("chunk")[s].as_py(), np.int32).astype(np.int64).reshape(n, -1) for s, n in zip((a, b), sizes, strict=True))
    carried = {"a_ids": ("ids", a), "a_labels": ("labels", a), "windows": ("windows", a), "ids": ("ids", b), "labels": ("labels", b)}
    out = {"g": t.column("g")[a].as_py(), "i": t.column("i")[a].as_py(), "j": t.column("j")[a].as_py(), "scores": partial_scores(x, y).tobytes()}
    out |= {c: t.column(n)[s].as_py() if k == 0 else None for c, (n, s) in carried.items()}
    return pa.Table.from_pylist([out], pa.schema(kinds))


def _summed(t: pa.Table) -> tuple[np.ndarray, ...]:
    """The added tile, and the ids and labels of its anchors and rows."""
    first = next(k for k, x in enumerate(t.column("ids").to_pylist()) if x is not None)
    read = lambda c: np.frombuffer(t.column(c)[first].as_py(), np.int64)
    a_ids, ids = read("a_ids"), read("ids")
    scores = np.zeros((len(a_ids), len(ids)), np.int64)
    for cell in t.column("scores"):
        part = np.frombuffer(cell.as_buffer(), np.int64).reshape(scores.shape)
        if len(part) and np.abs(part).max(initial=0) >= 2**62 // max(1, t.num_rows):
            raise OverflowError("scores may leave int64")
        scores += part
    return scores, a_ids, read("a_labels"), ids, read("labels"), read("windows").reshape(-1, 3)


def _tiles(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Partial tiles of all pairs of an anchor block and a row block of the same ``g``: one row a chunk."""
    other = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    a = anchors.filter("others > 0").withColumns({"side": F.lit(0), "i": F.col("block")}).withColumn("j", other)
    b = rows.filter("others > 0").withColumns({"side": F.lit(1), "j": F.col("block")}).withColumn("i", other)
    both = a.drop("block", "others").unionByName(b.drop("block", "others"))
    return both.groupBy("g", "i", "j", "k").applyInArrow(
        _multiply, "g bigint, i int, j int, scores binary, a_ids binary, a_labels binary, windows binary, ids binary, labels binary"
    )


def _blocks(df: DataFrame, group: Column, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their group ``g`` and block, and the groups' numbers of blocks."""
    grouped = df.withColumn("g", group)
    sizes = grouped.groupBy("g").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    small, fits = broadcast_if_small(sizes, MAX_BROADCAST_BUCKETS)
    joined = grouped.join(small, "g") if fits else fresh_join(grouped, small, ["g"])
    return joined.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")), sizes


def mine_hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label: Column | str = "label",
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    rows_a_block: int = ROWS,
    anchors_a_block: int = ANCHORS,
    dims: int = DIMS,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    picked = vectors.select(F.col(id_col).cast("bigint").alias("_id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("_label"), F.col(vec_col).alias("_vec"))
    valid = picked.filter("_id IS NOT NULL AND _label IS NOT NULL AND _vec IS NOT NULL").mapInArrow(_integers, "id bigint, label bigint, q binary").filter("q IS NOT NULL")
    rows = durable(valid.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q"))
    n, most = rows.agg(F.count("*"), F.max(F.octet_length("q"))).first()
    width = max(1, (most or 0) // 4)
    pack = _pack(width, dims)

    def packed(df: DataFrame, others: DataFrame | int) -> DataFrame:
        """``others``: how many blocks of the other side a group's blocks meet."""
        if isinstance(others, int):
            df = df.withColumn("others", F.lit(others))
        else:
            small, fits = broadcast_if_small(others.withColumnRenamed("blocks", "others"), MAX_BROADCAST_BUCKETS)
            df = df.join(small, "g") if fits else fresh_join(df, small, ["g"])
        keep = [c for c in ("g", "block", "others", "id", "label", "q", "windows") if c in df.columns]
        return df.select(*keep).groupBy("g", "block").applyInArrow(pack, _PACKED)

    # rows of the same label, by buckets of labels of about a block's rows at least
    bucket = F.pmod(F.xxhash64("label"), F.lit(max(1, -(-n // rows_a_block))))
    anchors = rows.filter(F.col("id") % every == 0)
    a, a_sizes = _blocks(anchors, bucket, anchors_a_block)
    b, b_sizes = _blocks(rows, bucket, rows_a_block)

    def first_positives(t: pa.Table) -> pa.Table:
        scores, a_ids, a_labels, ids, labels, _ = _summed(t)
        got = []
        for row, (own, label_) in enumerate(zip(a_ids, a_labels, strict=True)):
            best = first_of(scores[row], np.flatnonzero((labels == label_) & (ids != own)), positives)
            got.append((np.full(len(best), own), ids[best], scores[row, best]))
        return pa.table([np.concatenate(x) for x in zip(*got, strict=True)], ["anchor_id", "positive_id", "score"])

    near = _tiles(packed(a, b_sizes), packed(b, a_sizes)).groupBy("g", "i", "j").applyInArrow(first_positives, "anchor_id bigint, positive_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    chosen = near.withColumn("place", place).filter(F.col("place") <= positives)
    windows = durable(chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("windows")))

    # all rows against the anchors' windows
    asked = anchors.join(windows, anchors["id"] == windows["anchor_id"]).drop("anchor_id")
    n_anchors = windows.count()
    a_blocks, b_blocks = -(-n_anchors // anchors_a_block), -(-n // rows_a_block)
    dealt = lambda df, blocks: df.withColumns({"g": F.lit(0).cast("bigint"), "block": F.pmod(F.xxhash64("id", F.lit(5)), F.lit(max(1, blocks))).cast("int")})

    def first_negatives(t: pa.Table) -> pa.Table:
        scores, a_ids, a_labels, ids, labels, asked_for = _summed(t)
        got = [(np.empty(0, np.int64),) * 5]
        for row, positive, score in asked_for.tolist():
            mine = scores[row]
            inside = (labels != a_labels[row]) & (mine >= -(-low * score // 100)) & (mine <= high * score // 100)
            best = first_of(mine, np.flatnonzero(inside), negatives)
            got.append((np.full(len(best), a_ids[row]), np.full(len(best), positive), np.full(len(best), score), ids[best], mine[best]))
        return pa.table([np.concatenate(x) for x in zip(*got, strict=True)], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    tiles = _tiles(packed(dealt(asked, a_blocks), b_blocks), packed(dealt(rows, b_blocks), a_blocks))
    found = tiles.groupBy("g", "i", "j").applyInArrow(first_negatives, "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
