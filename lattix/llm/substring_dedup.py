"""Substring deduplication by hashing normalised units (lines, paragraphs, or sentences of lines).

A text is cut at line breaks (``unit="line"``), at blank lines (``unit="paragraph"``) or
at line breaks and after sentence ends inside a line (``unit="sentence"``), so that a
repeated passage is found wherever its line begins.
Units are normalised to their words (runs of letters and digits, in lower case
letter by letter), digested to 128 bits and grouped globally.  The
occurrence in the smallest ``doc_id`` (there, the first) stays; all others are
repeats.

Passages that begin or end inside a unit are found by spans of ``span_words`` words
(none if it is null: then lines or paragraphs alone, with ``min_words=1`` every repeat).
A span is chosen where its hash is the smallest of a window of spans that covers
``PASSAGE_WORDS`` words, so every passage of that many words or more has chosen
spans, the same ones wherever it stands.  Spans are repeats if a smaller id has
them too; inside one document only units repeat, as spans overlap each other.

Repeats that touch or overlap form a run; runs of ``min_words`` words or more are
removed, with their offsets in the original text retained.  Of a passage that
begins or ends inside a unit, fewer than ``PASSAGE_WORDS - span_words + 1`` words
outside whole units may stay at each end.

Grouping takes (digest, id) rows only; hot units are combined before the shuffle
and a hot digest's rows are split by adaptive execution in the join that brings
the keeper back.

Edge cases: null and empty texts have no units.  Rows with a null id neither lose
nor justify a removal.  Rows that repeat an id are one document when occurrences are
ranked, so the second of two equal rows keeps its text, but passages are only removed
from the very text that they were found in.  Units without a letter or digit join no
group, but do not break a run.  Whole texts are read, however long (up to 2 ** 30
words and 2 ** 31 characters).  Other columns are kept as they are, whatever their names;
ids must be integers.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

_UNITS = {"line": re.compile(r"[^\n]+"), "paragraph": re.compile(r"\S[^\n]*(?:\n[^\S\n]*+\S[^\n]*)*"), "sentence": re.compile(r"[^\n.!?]+[.!?]*[^\S\n]*|[.!?]+[^\S\n]*")}
_GAPS = re.compile(r"[\W_]+")
#: Rows are packed, because all of them are shuffled: characters are start << 31 | end; words have, above
#: start << 31 | end, a bit that tells units from spans and one for the first of equal units of a text.
_SCHEMA = "id bigint, mark bigint, chars bigint, words bigint, high bigint, low bigint"
_BITS, _UNIT, _FIRST = 31, 1 << 61, 1 << 62
_BATCH = 50_000
#: Words from which on a repeated passage is found wherever it begins; characters hashed at a time.
PASSAGE_WORDS, _PIECE = 50, 1 << 18
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@functools.lru_cache(16)
def _table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to n - 1, modulo 2 ** 64."""
    return _table(base, 1 << max(16, (n - 1).bit_length()))[:n]


def _extremes(a: np.ndarray, n: int, least: bool) -> np.ndarray:
    """The least (or largest) of each window of ``n`` values."""
    pick, have = np.minimum if least else np.maximum, 1
    while have < n:
        step = min(have, n - have)
        a, have = pick(a[:-step], a[step:]), have + step
    return a


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it belongs to a word, and a hash of its lower case."""
    points = np.arange(0x110000, dtype=np.uint64)
    text = "".join(map(chr, range(0x110000)))
    is_word = np.ones(len(text), bool)
    for m in _GAPS.finditer(text):
        is_word[m.start() : m.end()] = False
    for k, c in enumerate(text[:0x20000]):  # no cased letters beyond
        points[k] = ord(c.lower()[0])
    points[ord("ς")] = ord("σ")
    return is_word, _mixed(points + np.uint64(_ODD[0]))


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First character, end and hash of each word."""
    is_word, mix = _letters()
    found, at = [], 0
    while at < len(text):
        gap = _GAPS.search(text, at + _PIECE)
        end = gap.start() if gap else len(text)
        piece = text[at:end]
        points = np.frombuffer(piece.encode(), np.uint8) if piece.isascii() else np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.flatnonzero(np.diff(is_word[points], prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix[points] * _powers(_ODD[1], len(points)), dtype=np.uint64)])
            back = _powers(pow(_ODD[1], -1, 1 << 64), len(points))
            found.append((starts + at, ends + at, _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _sums(hashes: np.ndarray) -> list[np.ndarray]:
    """Running sums of the words' hashes, by which any words in a row get their digest."""
    return [np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(odd, len(hashes)), dtype=np.uint64)]) for odd in _ODD[1:]]


def _digests(sums: list[np.ndarray], first: np.ndarray, end: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
    """Both halves of the digest of words ``first`` to ``end`` (exclusive)."""
    return [_mixed((s[end] - s[first]) * _powers(pow(odd, -1, 1 << 64), len(s))[first] + salt) for s, odd in zip(sums, _ODD[1:], strict=True)]


def _spans(sums: list[np.ndarray], n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """First word and digest of the chosen spans of ``n`` words."""
    window, n_words = PASSAGE_WORDS - n + 1, len(sums[0]) - 1
    if window < 1 or n_words < PASSAGE_WORDS:
        return np.zeros(0, np.int64), [np.zeros(0, np.uint64)] * 2
    every = np.arange(n_words - n + 1)
    both = _digests(sums, every, every + n, np.uint64(0))
    edge = np.zeros(window - 1, np.uint64)
    chosen = np.flatnonzero(both[0] == _extremes(np.concatenate([edge, _extremes(both[0], window, True), edge]), window, False))
    return chosen, [h[chosen] for h in both]


def _rows_of(text: str, pattern: re.Pattern, span_words: int | None) -> list[np.ndarray]:
    """Columns of ``_SCHEMA`` but for the id: first the units that have words, then the chosen spans."""
    pack = lambda a, b: a.astype(np.int64) << _BITS | b
    starts, ends, hashes = _words(text)
    bounds = np.array([m.span() for m in pattern.finditer(text)], np.int64).reshape(-1, 2)
    places = np.searchsorted(starts, bounds)
    filled = places[:, 1] > places[:, 0]
    bounds, (first, end) = bounds[filled], places[filled].T
    sums = _sums(hashes)
    digest = _digests(sums, first, end, (end - first).astype(np.uint64))
    here = np.zeros(len(first), bool)
    here[np.unique(digest[0], return_index=True)[1]] = True
    n_span = span_words or PASSAGE_WORDS + 1  # none is chosen then
    at, of_span = _spans(sums, n_span)
    units = pack(first, end) | _UNIT | here * np.int64(_FIRST)
    return [
        np.concatenate([pack(bounds[:, 0], bounds[:, 1]), pack(starts[at], ends[at + n_span - 1])]),
        np.concatenate([units, pack(at, at + n_span) | _FIRST]),
        *(np.concatenate([u.view(np.int64), v.view(np.int64)]) for u, v in zip(digest, of_span, strict=True)),
    ]


def _unit_rows(unit: str, span_words: int | None):
    pattern = _UNITS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "mark", "chars", "words", "high", "low"]
        out: list[list[np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            done = pa.RecordBatch.from_arrays(columns, names)
            out.clear()
            for k in range(0, done.num_rows, _BATCH):
                yield done.slice(k, _BATCH)

        for batch in batches:
            for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                columns = _rows_of(text.as_py(), pattern, span_words)
                n = len(columns[0])
                out.append([np.full(n, doc_id, np.int64), np.full(n, mark, np.int64), *columns])
                held += n
                if held >= _BATCH:
                    yield from flush()
                    held = 0
        if out:
            yield from flush()

    return run


def text_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", span_words: int | None = 30) -> DataFrame:
    """Packed rows of units and chosen spans."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text != ''")
    # tells apart different texts of one id; a constant where there are none, which takes no space in a shuffle
    repeats = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0
    rows = rows.select("id", (F.xxhash64("text") if repeats else F.lit(0).cast("bigint")).alias("mark"), "text")
    return rows.mapInArrow(_unit_rows(unit, span_words), _SCHEMA)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = 30, span_words: int | None = 30
) -> DataFrame:
    """One row a removed run: id, start_char, end_char, n_units, n_words, first_<id> (smallest keeper of its units and spans).

    Offsets count characters of the original text, the end is exclusive.  A run of spans alone has no units.
    """
    return _marked_runs(docs, id_col, text_col, unit, min_words, span_words).drop("mark")


def _marked_runs(docs: DataFrame, id_col: str, text_col: str, unit: str, min_words: int, span_words: int | None) -> DataFrame:
    """The runs with ``mark``: 0, or the hash of the text if some id has several rows."""
    units = text_units(docs, id_col, text_col, unit, span_words)
    # the other key makes both sides of the join shuffle anew, so that adaptive execution can split hot digests
    other = F.col("high").bitwiseXOR(F.lit(_ODD[0] >> 1)).alias("other")
    keepers = units.groupBy("high", "low").agg(F.min("id").alias("keeper"), F.count("*").alias("n"))
    keepers = keepers.filter("n > 1").select(other, "low", "keeper")
    found = units.select("id", "mark", "chars", "words", other, "low").join(keepers, ["other", "low"])
    mask = F.lit((1 << _BITS) - 1)
    has = lambda bit: F.col("words").bitwiseAND(F.lit(bit)) != 0
    start = lambda c: F.shiftright(c, _BITS).bitwiseAND(F.lit((1 << 30) - 1)).cast("int")
    end = lambda c: F.col(c).bitwiseAND(mask).cast("int")
    found = found.filter((F.col("id") != F.col("keeper")) | ~has(_FIRST))
    place = ["start_word", "end_word", "is_unit", "start_char", "end_char", "keeper"]
    repeats = found.select(
        "id",
        "mark",
        start("words").alias("start_word"),
        end("words").alias("end_word"),
        has(_UNIT).alias("is_unit"),
        F.shiftright("chars", _BITS).cast("int").alias("start_char"),
        end("chars").alias("end_char"),
        "keeper",
    )
    by_place = Window.partitionBy("id", "mark").orderBy(*place)
    # rows that repeat an id give a place twice
    is_new = ~F.coalesce(F.lag(F.struct(*place)).over(by_place) == F.struct(*place), F.lit(False))
    reached = F.max("end_word").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start_word") > reached, F.lit(True)).cast("int")
    runs = (
        repeats.withColumns({"begins": begins, "new_unit": F.col("is_unit") & is_new})
        .withColumn("run", F.sum("begins").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "mark", "run")
        .agg(
            F.min("start_char").alias("start_char"),
            F.max("end_char").alias("end_char"),
            F.count_if("new_unit").alias("n_units"),
            (F.max("end_word") - F.min("start_word")).cast("bigint").alias("n_words"),
            F.min("keeper").alias("keeper"),
        )
    )
    return runs.filter(F.col("n_words") >= min_words).select(
        F.col("id").alias(id_col), "mark", "start_char", "end_char", "n_units", "n_words", F.col("keeper").alias(f"first_{id_col}")
    )


def _without(text: Column, spans: Column) -> Column:
    def part(s: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get(s, k - 1)["end_char"])
        stop = F.when(k < F.size(s), F.get(s, k)["start_char"]).otherwise(F.length(text))
        return F.substring(text, start + 1, stop - start)

    return let(F.array_sort(spans), lambda s: F.array_join(F.transform(F.sequence(F.lit(0), F.size(s)), lambda k: part(s, k)), ""))


def drop_repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = 30, span_words: int | None = 30
) -> DataFrame:
    """``docs``, same columns and rows, without the repeated runs."""
    runs = _marked_runs(docs, id_col, text_col, unit, min_words, span_words)
    spans = runs.groupBy(F.col(id_col).alias("__lx_id"), F.col("mark").alias("__lx_mark")).agg(F.collect_set(F.struct("start_char", "end_char")).alias("__lx_spans"))
    same_text = (spans["__lx_mark"] == 0) | (spans["__lx_mark"] == F.xxhash64(docs[text_col].cast("string")))
    joined = docs.join(spans, (docs[id_col] == spans["__lx_id"]) & same_text, "left")
    text = F.when(F.col("__lx_spans").isNull(), docs[text_col]).otherwise(_without(docs[text_col], F.col("__lx_spans")))
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
