"""Benchmark decontamination by spaced-seed hashing.

Texts and benchmark items become lower-cased words (runs of letters and digits;
every non-ASCII byte counts as a letter).  Each of four fixed masks takes six of ten
consecutive words and ignores the others, so a masked hash survives substitutions at
ignored places.  Items of under ``SHORT`` words have two masks of their own, over all
their words at even and at odd places, so any one substitution leaves one of them
whole.  Items of under ``LEAST`` words name no passage and are not sought.  Hits are
(text place, item place) with equal masked hash.  A hit names a diagonal; along it the
item's and the text's words are compared one by one, and the best run (a match counts
1, a substitution -4, so at least four fifths agree) is an overlap if it has
``min_words`` matching words, or four fifths of a shorter item's.

Test and training hashes meet in a broadcast join: the items' hashes are a sorted
table that every task searches, as long as it has at most ``MAX_TABLE_ROWS`` rows,
which a count bounds; a larger benchmark is processed in that many slices of its
items, one pass over the texts each.

Edge cases: null and empty texts or items match nothing.  A null item id counts as
item -1.  Rows with a null id are reported with a null id.  ``drop_contaminated``
judges every row by its own text, whatever its id.  Rows that repeat an id give their
overlaps once.  Of runs of equal score the first is taken, of diagonals with equally
many matches the one of the first place.  Whole texts are read, however long, their
words some 262,000 at a time.  Other columns are ignored, whatever their names; ids must
be integers.  An empty benchmark or table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .kernels import NOT_WORD, U, mix, pieces, words

SPAN = 10
#: Word offsets that each mask compares, out of ten.
MASKS = ((0, 1, 2, 4, 7, 8), (0, 1, 3, 5, 6, 9), (0, 2, 3, 6, 7, 8), (0, 4, 5, 6, 8, 9))
MATCH, SUBSTITUTION = 1, -4
MAX_TABLE_ROWS = 4_000_000

#: Words of an item that is sought at all, and from which on the fixed masks alone find it.
LEAST, SHORT = 5, 15

_SCALE = mix(np.arange(1, SHORT + 1, dtype=U)) | U(1)
SCHEMA = "id bigint, item_id bigint, first_word int, end_word int, item_first int, n_matched int, n_overlap int, item_words int"


def whole_masks(n: int) -> list[tuple[tuple[int, ...], int, int]]:
    """Masks of items of ``n`` words: (offsets, span, number)."""
    return [(tuple(range(k, n, 2)), n, 2 * n + k) for k in (0, 1)]


def masked(h: np.ndarray, mask: tuple[int, ...], span: int, number: int) -> np.ndarray:
    """Hash of the mask's words at each place of ``h`` where the whole span fits."""
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    s = np.zeros(n, dtype=U)
    for k in mask:
        s += h[k : k + n] * _SCALE[k]
    return mix(s + U(number))


def _word_hashes(texts: pa.Array) -> list[np.ndarray]:
    out = []
    for p in pieces(texts, lower=True):
        w = words(p, NOT_WORD)
        out += [w.hash[w.of_text[k] : w.of_text[k + 1]] for k in range(len(p))]
    return out


class SeedTable:
    """Masked hashes of some items, sorted, with (item, place) of each, and a bitmap that rejects most probes."""

    BITMAP_BITS = 24

    def __init__(self, ids: list[int], item_words: list[np.ndarray]):
        self.ids, self.words = np.array(ids, dtype=np.int64), item_words
        fixed = [(m, SPAN, k) for k, m in enumerate(MASKS)]
        lengths = {len(h) for h in item_words if LEAST <= len(h) < SHORT}
        self.masks = fixed + [m for n in sorted(lengths) for m in whole_masks(n)]
        keys, items, places = [], [], []
        for i, h in enumerate(item_words):
            for m in [*fixed, *(whole_masks(len(h)) if len(h) in lengths else [])]:
                x = masked(h, *m)
                keys.append(x)
                items.append(np.full(len(x), i))
                places.append(np.arange(len(x)))
        key = np.concatenate(keys) if keys else np.zeros(0, dtype=U)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.item = np.concatenate(items)[order].astype(np.int32) if keys else np.zeros(0, np.int32)
        self.place = np.concatenate(places)[order].astype(np.int32) if keys else np.zeros(0, np.int32)
        self.bitmap = np.zeros(1 << self.BITMAP_BITS, dtype=bool)
        self.bitmap[(self.key >> U(64 - self.BITMAP_BITS)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, stretch: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``h``, items and item places of all hits, found over ``stretch`` words at a time."""
        found = [self._hits(h[k : k + stretch + SHORT], k, stretch) for k in range(0, max(len(h), 1), stretch)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _hits(self, h: np.ndarray, first: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, item, place = [], [], []
        for m in self.masks:
            x = masked(h, *m)[:n]
            near = np.flatnonzero(self.bitmap[(x >> U(64 - self.BITMAP_BITS)).astype(np.int64)])
            lo, hi = (np.searchsorted(self.key, x[near], side=s) for s in ("left", "right"))
            count = hi - lo
            found = np.flatnonzero(count)
            lo, count, near = lo[found], count[found], near[found]
            rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(lo) else np.zeros(0, np.int64)
            at.append(np.repeat(near, count) + first)
            item.append(self.item[rows])
            place.append(self.place[rows])
        return np.concatenate(at), np.concatenate(item), np.concatenate(place)


def best_run(same: np.ndarray) -> tuple[int, int]:
    """[begin, end) of the highest-scoring run of a match vector; the first of equal ones."""
    score = np.concatenate([[0], np.cumsum(np.where(same, MATCH, SUBSTITUTION))])
    least = np.minimum.accumulate(score)
    end = int(np.argmax(score - least))
    begin = int(np.flatnonzero(score[: end + 1] == least[end])[-1])
    return begin, end


def _overlaps(table: SeedTable, h: np.ndarray, first: int, last: int, at: np.ndarray, item: np.ndarray, place: np.ndarray, min_words: int):
    """Verified overlaps of the text whose words are h[first:last], from its hits."""
    best: dict[int, tuple] = {}
    for i, d in sorted({(int(i), int(a - p)) for a, i, p in zip(at, item, place, strict=True)}):
        b = table.words[i]
        lo, hi = max(d, first), min(d + len(b), last)
        same = h[lo:hi] == b[lo - d : hi - d]
        x, y = best_run(same)
        matched = int(same[x:y].sum())
        need = min(min_words, -(-4 * len(b) // 5))
        if matched >= need and (i not in best or matched > best[i][4]):
            best[i] = (i, lo + x - first, lo + y - first, lo - d + x, matched, y - x)
    return best.values()


def _found(t: SeedTable, texts: pa.Array, min_words: int) -> Iterator[tuple]:
    """(row, item number, first_word, end_word, item_first, n_matched, n_overlap) of all overlaps."""
    for p in pieces(texts, lower=True):
        w = words(p, NOT_WORD)
        at, item, place = t.hits(w.hash)
        if not len(at):
            continue
        text = np.searchsorted(w.of_text, at, side="right") - 1
        order = np.argsort(text, kind="stable")
        at, item, place, text = at[order], item[order], place[order], text[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1, [len(text)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = int(text[a])
            for r in _overlaps(t, w.hash, int(w.of_text[k]), int(w.of_text[k + 1]), at[a:b], item[a:b], place[a:b], min_words):
                yield p.first + k, *r


def _scan(table, min_words: int):
    """table: a broadcast of SeedTable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[r[0]], int(t.ids[r[1]]), *r[2:], len(t.words[r[1]])) for r in _found(t, batch.column(1), min_words)]
            if rows:
                c = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def _tables(benchmark: DataFrame, item_id_col: str, item_text_col: str) -> Iterator:
    """Broadcast seed tables of the benchmark's slices."""
    items = benchmark.select(
        F.coalesce(F.col(item_id_col).cast("bigint"), F.lit(-1)).alias("id"), F.col(item_text_col).cast("string").alias("text")
    ).filter("text != ''").distinct()
    # runs of ASCII characters that aren't letters or digits cut the words, so this bounds the table's rows
    rows = items.agg(F.sum(F.size(F.split("text", r"[\x00-/:-@\[-`{-\x7f]+", -1)))).first()[0] or 0
    slices = max(1, -(-rows * len(MASKS) // MAX_TABLE_ROWS))
    for k in range(slices):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(slices)) == k).orderBy("id", "text").toArrow()
        hashes = _word_hashes(part.column("text").combine_chunks()) if part.num_rows else []
        yield benchmark.sparkSession.sparkContext.broadcast(SeedTable(part.column("id").to_pylist(), hashes))


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_words: int = 12,
) -> DataFrame:
    """One row a (document, item): id, item_id, first_word, end_word (in the document, end exclusive), item_first, n_matched, n_overlap, item_words."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text != ''")
    parts, table = [], None
    for following in _tables(benchmark, item_id_col, item_text_col):
        if table is not None:  # one slice's table at a time
            parts[-1] = durable(parts[-1])
            table.destroy()
        table = following
        parts.append(texts.mapInArrow(_scan(table, min_words), SCHEMA))
    found = functools.reduce(DataFrame.unionByName, parts)
    return found.withColumnRenamed("id", id_col).withColumnRenamed("item_id", item_id_col).distinct()


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_words: int = 12,
) -> DataFrame:
    """``docs``, same columns, without the rows whose text overlaps a benchmark item; rows are judged in place, without a join."""
    table = None
    for following in _tables(benchmark, item_id_col, item_text_col):
        if table is not None:  # one slice's table at a time
            docs = durable(docs)
            table.destroy()
        table = following
        docs = docs.filter(~_contaminated(table, min_words)(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return docs


def _contaminated(table, min_words: int):
    @F.arrow_udf("boolean")
    def judge(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), dtype=bool)
        out[[r[0] for r in _found(table.value, texts, min_words)]] = True
        return pa.array(out)

    return judge
