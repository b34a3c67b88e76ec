"""Line deduplication by content-defined line chunks, in DataFrame functions only.

Each line is hashed; a polynomial rolling hash over the last ``window`` line hashes
ends a chunk where it is 0 modulo ``divisor``.  A boundary depends on nearby lines
only, so an inserted or deleted line shifts no distant boundary.  Chunks of two
lines or more that occur again anywhere are found by digest, then confirmed by
comparing their full bytes; the occurrence with the smallest (doc_id, first line)
stays and the others are removed.

Chunks miss short blocks, whose boundaries depend on the lines around them.  So the
removal also takes blocks: adjacent pairs of lines that a smaller id has too, joined
to runs; runs of ``min_block_words`` words or more go whole.  Lines are compared by
their MD5 there.  Inside one document only chunks repeat, as pairs overlap.

Texts move once: digests are counted in narrow rows first, and only chunks of a
repeated digest go on to the comparison.

Edge cases: null and empty texts have no chunk of two lines.  Rows with a null id
neither lose nor justify a removal.  Rows that repeat an id are one document when
occurrences are ranked, but lines are only removed from the very text that they were
found in.  A chunk has no largest size, and whole texts are read, however long (a text
and its lines are held as one row).  Other columns are kept as they are, whatever their
names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh_join, let

#: Multiplier of the rolling hash, and hex digits of MD5 taken for a line's hash (28 bits; all sums stay in 64).
MULTIPLIER, HEX_DIGITS = 31, 7


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, HEX_DIGITS), 16, 10).cast("bigint")


def _chunks(lines: Column, window: int, divisor: int) -> Column:
    """array<struct<start_line, end_line, chunk>> of the chunks of two lines or more."""

    def rolling(h: Column, i: Column) -> Column:
        return sum(
            (F.when(i >= k, F.get(h, i - k)).otherwise(F.lit(0)) * F.lit(MULTIPLIER**k) for k in range(1, window)),
            F.get(h, i),
        )

    def ends(h: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(h) - 1),
            lambda i: (rolling(h, i) % divisor == 0) | (i == F.size(h) - 1),
        )

    def spans(e: Column, ls: Column) -> Column:
        each = F.transform(e, lambda end, k: F.struct(F.when(k == 0, F.lit(0)).otherwise(F.get(e, k - 1) + 1).alias("start_line"), end.alias("end_line")))
        return F.transform(
            F.filter(each, lambda c: c["end_line"] > c["start_line"]),
            lambda c: F.struct(
                c["start_line"].alias("start_line"),
                c["end_line"].alias("end_line"),
                F.array_join(F.slice(ls, c["start_line"] + 1, c["end_line"] - c["start_line"] + 1), "\n").alias("chunk"),
            ),
        )

    return let(lines, lambda ls: let(F.transform(ls, _line_hash), lambda h: let(ends(h), lambda e: spans(e, ls))))


def line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, divisor: int = 4) -> DataFrame:
    """One row a chunk of two lines or more: id, start_line, end_line (both inclusive, from 0), chunk, digest."""
    return _marked_chunks(docs, id_col, text_col, window, divisor).drop("text_mark")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_mark (tells apart different texts of one id), text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    return rows.select("id", F.xxhash64("text").alias("text_mark"), "text")


def _marked_chunks(docs: DataFrame, id_col: str, text_col: str, window: int, divisor: int) -> DataFrame:
    # outer, for no filter on the array's size is then derived, which would compute it twice
    chunks = _texts(docs, id_col, text_col).select("id", "text_mark", F.inline_outer(_chunks(F.split("text", "\n", -1), window, divisor)))
    return chunks.filter("start_line is not null").withColumn("digest", F.unhex(F.sha2("chunk", 256)))


def repeated_line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, divisor: int = 4) -> DataFrame:
    """One row a removed chunk: id, start_line, end_line, first_<id>, first_start_line."""
    return _marked_repeats(docs, id_col, text_col, window, divisor).drop("text_mark")


def _marked_repeats(docs: DataFrame, id_col: str, text_col: str, window: int, divisor: int) -> DataFrame:
    chunks = _marked_chunks(docs, id_col, text_col, window, divisor)
    counts = chunks.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    # written once: only repeated chunks, so that the whole texts' chunks aren't shuffled for each of two uses
    candidates = durable(fresh_join(chunks, counts, ["digest"]).select("id", "text_mark", "start_line", "end_line", "chunk", F.xxhash64("chunk").alias("mark")))
    firsts = (
        candidates.groupBy("mark", "chunk")
        .agg(F.min(F.struct("id", "start_line")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    removed = fresh_join(candidates, firsts, ["mark", "chunk"]).filter(F.struct("id", "start_line") != F.col("first"))
    return removed.select(
        F.col("id").alias(id_col),
        "text_mark",
        "start_line",
        "end_line",
        F.col("first.id").alias(f"first_{id_col}"),
        F.col("first.start_line").alias("first_start_line"),
    )


def repeated_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 51) -> DataFrame:
    """One row a run of two lines or more whose adjacent pairs a smaller id has too: id, start_line, end_line, n_words."""
    return _marked_blocks(docs, id_col, text_col, min_words).drop("text_mark")


def _pairs_of_lines(docs: DataFrame, id_col: str, text_col: str, with_words: bool) -> DataFrame:
    """One row a pair of adjacent lines: id, text_mark, line, digest, and the words of both lines if asked for."""

    def pairs(h: Column, n: Column | None) -> Column:
        def one(i: Column) -> Column:
            fields = [i.alias("line"), F.unhex(F.concat(F.get(h, i), F.get(h, i + 1))).alias("digest")]
            return F.struct(*fields, *([] if n is None else [F.get(n, i).alias("words"), F.get(n, i + 1).alias("next_words")]))

        return F.when(F.size(h) > 1, F.transform(F.sequence(F.lit(0), F.size(h) - 2), one))

    def of_lines(ls: Column) -> Column:
        hashes = F.transform(ls, F.md5)
        if not with_words:
            return let(hashes, lambda h: pairs(h, None))
        return let(hashes, lambda h: let(F.transform(ls, lambda x: F.regexp_count(x, F.lit("\\S+"))), lambda n: pairs(h, n)))

    # outer, for the same reason as above
    rows = _texts(docs, id_col, text_col).select("id", "text_mark", F.inline_outer(let(F.split("text", "\n", -1), of_lines)))
    return rows.filter("line is not null")


def _marked_blocks(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    keys = _pairs_of_lines(docs, id_col, text_col, False)
    firsts = keys.groupBy("digest").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).filter("keeper < last").drop("last")
    each = _pairs_of_lines(docs, id_col, text_col, True)
    repeats = fresh_join(each, firsts, ["digest"]).filter("id > keeper").groupBy("id", "text_mark", "line").agg(F.max("words").alias("words"), F.max("next_words").alias("next_words"))
    by_line = Window.partitionBy("id", "text_mark").orderBy("line")
    begins = F.coalesce(F.col("line") - F.lag("line").over(by_line) > 1, F.lit(True)).cast("int")
    runs = (
        repeats.withColumn("begins", begins)
        .withColumn("run", F.sum("begins").over(by_line))
        .groupBy("id", "text_mark", "run")
        .agg(
            F.min("line").alias("start_line"),
            (F.max("line") + 1).alias("end_line"),
            (F.sum("words") + F.max_by("next_words", "line")).alias("n_words"),
        )
    )
    return runs.filter(F.col("n_words") >= min_words).select(F.col("id").alias(id_col), "text_mark", "start_line", "end_line", "n_words")


def _merged(ranges: DataFrame) -> DataFrame:
    """Ranges (id, text_mark, start_line, end_line) that overlap become one."""
    by_start = Window.partitionBy("id", "text_mark").orderBy("start_line", "end_line")
    reached = F.max("end_line").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start_line") > reached, F.lit(True)).cast("int")
    runs = ranges.withColumn("begins", begins).withColumn("run", F.sum("begins").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("id", "text_mark", "run").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("run")


def _without(text: Column, ranges: Column) -> Column:
    """``text`` without the lines of ``ranges`` (sorted, disjoint)."""

    def kept(ls: Column, rs: Column) -> Column:
        def part(k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(rs, k - 1)["end_line"] + 1)
            stop = F.when(k < F.size(rs), F.get(rs, k)["start_line"]).otherwise(F.size(ls))
            return F.slice(ls, start + 1, F.greatest(stop - start, F.lit(0)))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(rs)), part)), "\n")

    return let(F.split(text, "\n", -1), lambda ls: let(F.array_sort(ranges), lambda rs: kept(ls, rs)))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, divisor: int = 4, min_block_words: int = 51) -> DataFrame:
    """``docs``, same columns, without the repeated chunks and blocks; a document of which nothing but white space is left goes."""
    found = [_marked_repeats(docs, id_col, text_col, window, divisor), _marked_blocks(docs, id_col, text_col, min_block_words)]
    chunks, blocks = (r.select(F.col(id_col).alias("id"), "text_mark", "start_line", "end_line") for r in found)
    merged = _merged(chunks.unionByName(blocks)).groupBy("id", "text_mark").agg(F.collect_set(F.struct("start_line", "end_line")).alias("__lx_ranges"))
    ranges = merged.select(F.col("id").alias("__lx_id"), F.col("text_mark").alias("__lx_mark"), "__lx_ranges")
    joined = docs.join(ranges, (docs[id_col] == ranges["__lx_id"]) & (F.xxhash64(docs[text_col].cast("string")) == ranges["__lx_mark"]), "left")
    text = F.when(F.col("__lx_ranges").isNull(), docs[text_col]).otherwise(_without(docs[text_col], F.col("__lx_ranges")))
    left = joined.withColumn("__lx_text", text).filter(F.col("__lx_ranges").isNull() | (F.trim(F.regexp_replace("__lx_text", "\\s+", " ")) != ""))
    return left.select(*[F.col("__lx_text").alias(c) if c == text_col else docs[c] for c in docs.columns])
