"""Alignment of two tokenizers' tokens over the same bytes, by elementary intervals.

Tokenizer A (byte-level byte pairs) reads a space and the text, tokenizer B (pieces with
byte fallback, which adds the space itself) reads the text; special tokens' strings are
plain text.  Both cover the same bytes, so the union of their token ends cuts them into
elementary intervals, each of which lies in one token of A and one of B (its owners, found
by binary search).  An interval's owners overlap; where both owners end with the interval,
both tokenizers end, and a group of tokens closes.  A link is a pair of token occurrences,
by the rule chosen in ``links``:

* ``"ends"``: both end at the same byte;
* ``"overlaps"``: both share a byte (one link an interval);
* ``"groups"``: both lie in the same group (the product of its A and B tokens).

Neither tokenizer joins what stands on both sides of a single space between two other
characters: A's pattern begins a word there, and no piece of B has a space inside (looked
up in its vocabulary; else texts are not cut).  So each such cut ends a group, and a text
is a sequence of words that are tokenized and aligned by themselves, many at once.  A
worker keeps the alignment of the words that it met, up to ``MAX_WORDS`` and ``MAX_CHARS``,
then starts afresh.

A first pass writes one row a document: its counts, the hash of its groups and its
distinct linked id pairs with their numbers, as a table in the shared folder.  The pairs'
corpus-wide counts, and the highest of each B id, are aggregations of that table.  They
come back to the documents in a join: broadcast if a count proves that there are
``MAX_BROADCAST_PAIRS`` pairs at most, else shuffled, with hot pairs split.

Edge cases: null and empty texts, and texts whose joined token bytes of A or B are not the
space and the text, have no tokens: zeros, and an empty ``groups_sha256``.  A null id gives
a row with a null id.  Rows that repeat an id each give a row, and each counts.  Long texts
are read in pieces of ``PIECE`` characters (cut at such spaces; a longer word is one
piece).  An empty table gives an empty result.  Other columns are ignored, whatever their
names.  The pairs' counts are sums of integers, so no order of rows changes a result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh_join, written

#: Words whose alignment a worker keeps (some 0.3 KB each), and their characters.
MAX_WORDS, MAX_CHARS = 400_000, 1 << 24
#: Characters of texts that are cut into words at once.
PIECE = 1 << 20
#: Distinct id pairs (some 50 bytes each) that may be broadcast.
MAX_BROADCAST_PAIRS = 1_000_000

#: A space between characters that are white space to neither tokenizer.
_EDGE = r"[^\s\u180e\u200b\u2581\ufeff]"
_CUT = re.compile(rf"(?<={_EDGE}) (?={_EDGE})")
_WHOLE = re.compile(rf"{_EDGE}(?s:.*{_EDGE})?")

SCHEMA = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def elementary(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners in A and in B of each elementary interval, and whether both owners end with it.

    ``ends_*``: byte offsets where the tokens end, rising, with the same last one.
    """
    cuts = np.union1d(ends_a, ends_b)
    own_a, own_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return own_a, own_b, (ends_a[own_a] == cuts) & (ends_b[own_b] == cuts)


def link_pairs(own_a: np.ndarray, own_b: np.ndarray, shared: np.ndarray, links: str) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of the links by the rule ``links``."""
    if links == "ends":
        return own_a[shared], own_b[shared]
    if links == "overlaps":
        return own_a, own_b
    # groups: products of the runs of A and B tokens between two shared ends
    last_a, last_b = own_a[shared] + 1, own_b[shared] + 1
    n_a, n_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
    first_a, first_b, sizes = last_a - n_a, last_b - n_b, n_a * n_b
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    width = np.repeat(n_b, sizes)
    return np.repeat(first_a, sizes) + place // width, np.repeat(first_b, sizes) + place % width


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


def grouped_text(ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, ends: np.ndarray) -> list[str]:
    """Groups ``a1,a2|b1;a3|b2,b3`` of each word.  ``last_*``: the last token of each group; ``ends``: whether a group ends its word."""
    group_a = np.searchsorted(last_a, np.arange(len(ids_a)))
    group_b = np.searchsorted(last_b, np.arange(len(ids_b)))
    after_a, after_b = np.zeros(len(ids_a), np.int8), np.zeros(len(ids_b), np.int8)
    after_a[last_a] = 1
    after_b[last_b] = np.where(ends, 3, 2)
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    ids, after = np.concatenate([ids_a, ids_b])[order].tolist(), np.concatenate([after_a, after_b])[order].tolist()
    return "".join([f"{i}{',|;~'[k]}" for i, k in zip(ids, after, strict=True)]).split("~")[:-1]


class _Numbers(dict):
    """Words' numbers; a word that is new gets the next one."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Aligner:
    """Both tokenizers, and the alignment of the words met so far: its tables grow by doubling.

    The first ``max_words`` words are kept; later ones are aligned anew for each batch of
    texts, which costs time and no memory.
    """

    def __init__(self, path_a: str, path_b: str, links: str = "ends", max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        chars, special = byte_of_char(), {t.content for t in self.a.get_added_tokens_decoder().values()}
        vocabulary = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.bytes_a = [t.encode() if t in special else bytes(chars[c] for c in t) for t, _ in vocabulary]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.links, self.max_words = links, max_words
        self.number = _Numbers()
        self.chars = 0
        self.groups: list[str] = []
        self.counts = np.zeros((1024, 5), np.int64)  # tokens of A and B, groups, links, whether the bytes agree
        self.starts = np.zeros(1025, np.int64)  # of each word's links in ``pairs``
        self.pairs = np.zeros(4096, np.int64)  # id of A << 32 | id of B

    def _encoded(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both tokenizers, if their bytes are the space and the text."""
        ids_a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        ids_b = self.b.encode(text, num_threads=1)
        raw = b" " + text.encode()
        same = b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b))
        return (ids_a, ids_b) if same else None

    def learn(self, words: list[str]) -> np.ndarray:
        """Align new words all at once, as one text, where each may stand between two spaces; their numbers."""
        whole = [k for k, w in enumerate(words) if self.cuts and _WHOLE.fullmatch(w)]
        got = self._encoded(" ".join([words[k] for k in whole])) if whole else None
        if got is None:
            whole = []
        alone = sorted(set(range(len(words))) - set(whole))
        numbers = np.empty(len(words), np.int64)
        numbers[[*whole, *alone]] = len(self.groups) + np.arange(len(words))
        if whole:
            self._append([words[k] for k in whole], got)
        for k in alone:
            self._append([words[k]], self._encoded(words[k]))
        for k in alone and range(len(words)):
            self.number[words[k]] = int(numbers[k])
        return numbers

    def _append(self, words: list[str], ids: tuple[list[int], list[int]] | None) -> None:
        counts = np.zeros((len(words), 5), np.int64)
        groups, links = [""] * len(words), np.empty(0, np.int64)
        if ids is not None:
            ids_a, ids_b = (np.array(x, np.int64) for x in ids)
            ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
            ends = np.cumsum([1 + len(w.encode()) for w in words])  # a word's end is an end of both
            own_a, own_b, shared = elementary(ends_a, ends_b)
            x, y = link_pairs(own_a, own_b, shared, self.links)
            links = ids_a[x] << 32 | ids_b[y]
            last_a, last_b = own_a[shared], own_b[shared]
            word_a, word_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
            count = lambda word: np.bincount(word, minlength=len(words))
            counts = np.stack([count(word_a), count(word_b), count(word_a[last_a]), count(word_a[x]), np.ones(len(words), np.int64)], axis=1)
            groups = grouped_text(ids_a, ids_b, last_a, last_b, ends[word_a[last_a]] == ends_a[last_a])
        n, m = len(self.groups), self.starts[len(self.groups)]
        self.counts, self.starts, self.pairs = (_room(t, size) for t, size in ((self.counts, n + len(words)), (self.starts, n + len(words) + 1), (self.pairs, m + len(links))))
        self.counts[n : n + len(words)] = counts
        self.starts[n + 1 : n + len(words) + 1] = m + np.cumsum(counts[:, 3])
        self.pairs[m : m + len(links)] = links
        self.groups += groups

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while self.cuts and len(text) - at > PIECE and (m := _CUT.search(text, at + PIECE)):
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def aligned(self, pieces: list[str]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray] | None]:
        """Counts, groups, and distinct id pairs with their numbers, of each piece; None where the bytes differ."""
        known = len(self.groups)
        cut = [_CUT.split(p) if self.cuts else [p] for p in pieces]
        places = [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)) for words in cut]
        new, self.number.new = self.number.new, []
        numbers = self.learn(new) if new else np.empty(0, np.int64)
        for at in places:
            late = at >= known
            at[late] = numbers[at[late] - known]
            mine = self.counts[at]
            if not mine[:, 4].all():
                yield None
                continue
            sizes = mine[:, 3]
            place = np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            yield mine[:, :4].sum(axis=0), ";".join(map(self.groups.__getitem__, at.tolist())), *np.unique(self.pairs[place], return_counts=True)
        self.chars += sum(map(len, new))
        if len(self.groups) > self.max_words or self.chars > MAX_CHARS:
            self.chars -= sum(map(len, new))
            for w in new:
                del self.number[w]
            del self.groups[known:]

    def documents(self, texts: list[str | None]) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
        """Counts, hash of the groups, distinct id pairs and their numbers, of each text."""
        batch: list[tuple[int, str]] = []
        held: dict[int, list] = {}
        done = chars = 0

        def flush(upto: int) -> Iterator:
            nonlocal done, chars
            for (k, _), got in zip(batch, list(self.aligned([p for _, p in batch])) if batch else [], strict=True):
                sums, digest, found = held.setdefault(k, [np.zeros(4, np.int64), hashlib.sha256(), []])
                if got is None or found is None:
                    held[k][2] = None
                    continue
                sums += got[0]
                digest.update(((";" if found else "") + got[1]).encode())
                found.append(got[2:])
            batch.clear()
            chars = 0
            while done < upto:
                yield _document(held.pop(done, None))
                done += 1

        for k, text in enumerate(texts):
            for piece in self.pieces(text) if text else ():
                batch.append((k, piece))
                chars += len(piece)
                if chars > PIECE:
                    yield from flush(k)
        yield from flush(len(texts))


def _document(held: list | None) -> tuple[list[int], str, np.ndarray, np.ndarray]:
    if held is None or held[2] is None:
        return [0, 0, 0, 0], "", np.empty(0, np.int64), np.empty(0, np.int64)
    sums, digest, found = held
    ids, times = found[0]
    if len(found) > 1:
        ids, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        times = np.bincount(back, np.concatenate([f[1] for f in found]), len(ids)).astype(np.int64)
    return sums.tolist(), digest.hexdigest(), ids, times


def _room(table: np.ndarray, size: int) -> np.ndarray:
    """The table, or a larger copy of it that has room for ``size`` rows."""
    if size <= len(table):
        return table
    out = np.zeros((max(size, 2 * len(table)), *table.shape[1:]), table.dtype)
    out[: len(table)] = table
    return out


@cache
def aligner(path_a: str, path_b: str, links: str) -> Aligner:
    """One for each Python worker, which runs many tasks."""
    return Aligner(path_a, path_b, links)


def _listed(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))


def aligned_rows(docs: DataFrame, path_a: str, path_b: str, links: str = "ends", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document, with a number of its own (``row``), as ``SCHEMA`` has it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b, links)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds the lists that are held at once
                some = batch.slice(at, 512)
                counts, sha, pairs, times = zip(*tool.documents(some.column(2).to_pylist()), strict=True)
                n = np.array(counts, np.int64)
                columns = [some.column(0), some.column(1), *(pa.array(n[:, k]) for k in range(4)), pa.array(sha, pa.string()), _listed(pairs), _listed(times)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(read, SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Corpus-wide number of links of each id pair, and whether it is the highest of its B id: (pair, count, best)."""
    counts = _links(rows).groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return fresh_join(counts, most, ["b"]).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _links(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")


def align(
    docs: DataFrame, path_a: str, path_b: str, links: str = "ends", id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST_PAIRS
) -> DataFrame:
    """One row a document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = written(aligned_rows(docs, path_a, path_b, links, id_col, text_col))
    counts = written(pair_counts(rows))
    small, fits = broadcast_if_small(counts, max_broadcast)
    met = _links(rows).join(small, "pair") if fits else fresh_join(_links(rows), small, ["pair"])
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)))
    sums = met.groupBy("row").agg(best.alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return rows.join(sums, "row", "left").select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
