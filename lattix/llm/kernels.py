"""Vectorised byte-level text kernels for Arrow batches.

A batch of texts is one UTF-8 buffer with offsets.  Words are runs of
non-separator bytes; each gets a 64-bit hash from differences of a running
polynomial sum, so no Python loop runs over words.  A-Z hash like a-z.  Buffers are cut into pieces
of a bounded size; a single longer text is a piece of its own, whose words are found
in chunks of ``CHUNK_BYTES``.  So a worker's memory is bounded whatever the batch size,
but for some 30 bytes a word and 2 bytes a byte of the longest single text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = CHUNK_BYTES = 512 << 10
#: A chunk ends behind a separator if one is among so many last bytes; a longer word is hashed across chunks.
LOOK_BACK = 4096
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _table(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * _BASE + U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A-Z count as a-z; other bytes as they are.
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE_VALUE = _table(11, 256)[_FOLD]
#: Separators: ASCII white space only, or every ASCII byte that isn't a letter or digit.
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_alnum = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
NOT_WORD = ~_alnum


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for one chunk."""
    out = []
    for base in (_BASE, _BASE_INVERSE):
        a = np.full(CHUNK_BYTES + 1, base, dtype=U)
        a[0] = U(1)
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


@dataclass
class Piece:
    """Some consecutive texts of a batch: bytes, and where each text begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Chunk:
    """Words that begin in one chunk of a piece; a word that goes on beyond it ends with it here, but ``whole`` is the hash of all of it."""

    start: np.ndarray
    end: np.ndarray
    sums: np.ndarray
    whole: np.ndarray

    def prefix(self, k: int) -> np.ndarray:
        """Hash of each word's first ``k`` bytes (of the whole word if it is shorter); ``k`` is ``LOOK_BACK`` at most."""
        end = np.minimum(self.start + k, self.end)
        return mix((self.sums[end] - self.sums[self.start]) * _powers()[1][self.start] + U(k))


@dataclass
class Words:
    """Words of a piece: byte ranges, hashes, and each text's first word (n + 1 entries); ``extra``: rows of the caller's own."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    of_text: np.ndarray
    extra: np.ndarray | None = None


def pieces(texts: pa.Array, max_bytes: int = PIECE_BYTES, lower: bool = False) -> Iterator[Piece]:
    """Consecutive texts of at most ``max_bytes`` together; with ``lower``, in Unicode lower case (made piece by piece)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return
    # a null text may have bytes beneath it, so ends are summed from the lengths
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < n:
        before = int(ends[i - 1]) if i else 0
        j = min(n, max(i + 1, int(np.searchsorted(ends, before + max_bytes, side="right"))))
        part = pc.fill_null(texts.slice(i, j - i).cast(pa.large_string()), "")
        if lower:
            part = pc.utf8_lower(part)
        bufs = part.buffers()
        offsets = np.frombuffer(bufs[1], dtype=np.int64)[part.offset : part.offset + j - i + 1]
        data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
        yield Piece(i, data[offsets[0] : offsets[-1]], offsets - offsets[0])
        i = j
    pa.default_memory_pool().release_unused()


def _cut(d: np.ndarray, at: int, separators: np.ndarray) -> int:
    """End of the chunk that begins at ``at``: behind a separator, if there is one among the last bytes."""
    stop = at + CHUNK_BYTES
    if stop >= len(d):
        return len(d)
    found = np.flatnonzero(separators[d[stop - LOOK_BACK : stop]])
    return stop - LOOK_BACK + int(found[-1]) + 1 if len(found) else stop


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    """The parts in one array; the list is emptied, so they aren't held any longer."""
    out = np.concatenate(parts) if parts else np.zeros(0, kind)
    parts.clear()
    return out


def _hash_from(d: np.ndarray, start: int, limit: int, separators: np.ndarray) -> np.ndarray:
    """Hash of the word that begins at ``start`` and ends before ``limit`` at the latest, read chunk by chunk."""
    total, length = np.zeros(1, dtype=U), 0
    while start + length < limit:
        x = d[start + length : min(limit, start + length + CHUNK_BYTES)]
        stops = np.flatnonzero(separators[x])
        x = x[: stops[0]] if len(stops) else x
        total += np.sum(_BYTE_VALUE[x] * _powers()[0][: len(x)], dtype=U, keepdims=True) * U(pow(int(_BASE), length, 1 << 64))
        length += len(x)
        if len(stops):
            break
    return mix(total + U(length))


def words(p: Piece, separators: np.ndarray = WHITE, each: Callable[[Chunk], np.ndarray] | None = None) -> Words:
    """Words of a piece, found chunk by chunk, so that only what is kept for each word grows with a long text.

    ``each`` makes one row a word from a chunk's words; word hashes are left out then.
    """
    d, n = p.data, len(p.data)
    power, inverse = _powers()
    texts = p.offsets[1:-1]
    place = np.int32 if n < 1 << 31 else np.int64
    starts, ends, hashes, extra = [], [], [], []
    at, open_sum, open_len = 0, U(0), 0  # of a word that began in an earlier chunk
    while at < n:
        stop = _cut(d, at, separators)
        x = d[at:stop]
        m = len(x)
        inside = ~separators[x]
        begins = np.zeros(m + 1, dtype=bool)
        lo, hi = np.searchsorted(texts, [at, stop + 1])
        begins[texts[lo:hi] - at] = True
        goes_on = stop < n and not begins[m] and inside[m - 1] and not separators[d[stop]]
        edge = inside.copy()
        edge[1:] &= ~inside[:-1] | begins[1:m]
        if open_len and not begins[0]:
            edge[0] = False
        last = inside.copy()
        last[:-1] &= ~inside[1:] | begins[1:m]
        last[m - 1] &= not goes_on
        start, end = np.flatnonzero(edge), np.flatnonzero(last) + 1
        sums = np.zeros(m + 1, dtype=U)
        np.cumsum(_BYTE_VALUE[x] * power[:m], out=sums[1:])
        if open_len:  # the first end, or the whole chunk, belongs to the open word
            upto = int(end[0]) if len(end) else m
            with np.errstate(over="ignore"):
                open_sum += U(pow(int(_BASE), open_len, 1 << 64)) * sums[upto]
            open_len += upto
            if len(end):
                hashes.append(mix(np.array([open_sum], dtype=U) + U(open_len)))
                ends.append((end[:1] + at).astype(place))
                end, open_sum, open_len = end[1:], U(0), 0
        starts.append((start + at).astype(place))
        ends.append((end + at).astype(place))
        whole = start[: len(end)]
        hashes.append(mix((sums[end] - sums[whole]) * inverse[whole] + (end - whole).astype(U)))
        if each is not None:
            hash_, upto = hashes[-1], end
            if len(start) > len(end):
                begun = at + int(start[-1])
                after = int(np.searchsorted(texts, begun, side="right"))
                limit = int(texts[after]) if after < len(texts) else n
                hash_, upto = np.append(hash_, _hash_from(d, begun, limit, separators)), np.append(end, m)
            extra.append(each(Chunk(start, upto, sums, hash_)))
        if len(start) > len(end):
            s = int(start[-1])
            open_sum, open_len = ((sums[m:] - sums[s : s + 1]) * inverse[s : s + 1])[0], m - s
        if each is not None:
            hashes.clear()
        at = stop
    start = _joined(starts, place)
    return Words(start, _joined(ends, place), _joined(hashes, U), np.searchsorted(start, p.offsets), _joined(extra, U) if extra else None)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hash of each run of ``n`` hashes (``len(h) - n + 1`` of them)."""
    m = len(h) - n + 1
    out = np.zeros(max(m, 0), dtype=U)
    for at in range(0, m, CHUNK_BYTES):
        to = min(m, at + CHUNK_BYTES)
        x = mix(h[at:to] + U(n))
        for k in range(1, n):
            x = mix(x * U(0xD6E8FEB86659FD93) + h[at + k : to + k])
        out[at:to] = x
    return out


def distinct(s: np.ndarray) -> np.ndarray:
    """Sorted distinct values; ``s`` is sorted in place."""
    s.sort()
    new = np.ones(len(s), dtype=bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's sorted distinct hashes of ``n``-word shingles.

    A text of fewer words gives its whole word sequence as one shingle, and a text
    without words the empty set.
    """
    for p in pieces(texts):
        w = words(p)
        h, of_text = w.hash, w.of_text
        del w
        s = shingles(h, n)
        for k in range(len(p)):
            a, b = of_text[k], of_text[k + 1]
            if b - a >= n:
                yield p.first + k, distinct(s[a : b - n + 1])
            elif b > a:
                yield p.first + k, shingles(h[a:b], b - a)
            else:
                yield p.first + k, np.zeros(0, dtype=U)
