"""Bulk text primitives over Arrow string columns.

A *word* is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  Texts
are handled as one byte buffer per chunk, so no Python object is made per word.
Word and shingle identities are 64-bit hashes; two different words of the same
corpus collide with probability of about ``n**2 / 2**65``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one chunk holds at most (a single longer text is a chunk of its own).
CHUNK_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_CONT = np.zeros(256, bool)
_CONT[0x80:0xC0] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.random.default_rng(0x5EED).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_pow_cache: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _pow_cache.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:  # doubling: the second half is the first times base**done
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        if size <= 4 * CHUNK_BYTES:
            _pow_cache[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes at most."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offs = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, ob, db = arr.buffers()
    offs = np.frombuffer(ob, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(db, np.uint8) if db is not None and db.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def code_points(buf: np.ndarray) -> np.ndarray:
    """1 where a code point starts."""
    return ~_CONT[buf]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and n+1 offsets of the texts' words."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~_WS[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True  # a text's first byte starts a word whatever stands before it
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(s, offs)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every disjoint span [start, end), spans in order."""
    if not len(start):
        return np.zeros(0, np.uint64)
    val = _MIX[buf] * _powers(_R, len(buf))
    cum = np.empty(len(buf) + 1, np.uint64)
    cum[0] = 0
    np.cumsum(val, out=cum[1:])
    return mix64((cum[end] - cum[start]) * _powers(_R_INV, len(buf))[start] + (end - start).astype(np.uint64))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(buf, start, end)


def shingle_sets(arr: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of every text (A-Z lower-cased) as sorted
    64-bit hashes, with n+1 offsets.  A text of fewer words gives its whole
    sequence as one shingle, a text without words none."""
    buf, offs = buffers(arr)
    buf = lower_ascii(buf)
    s, e, w = words(buf, offs)
    h = word_hashes(buf, s, e)
    n_words = np.diff(w)
    n_doc = len(n_words)
    doc = np.repeat(np.arange(n_doc), n_words)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(n_doc + 1, np.int64)
    acc = np.zeros(len(h), np.uint64)
    left = w[1:][doc] - np.arange(len(h))  # words from here to the text's end
    for j in range(width):
        step = np.zeros(len(h), np.uint64)
        step[: len(h) - j] = h[j:]
        inside = left > j
        acc = np.where(inside, mix64(acc * np.uint64(0xD6E8FEB86659FD93) + step + np.uint64(j + 1)), acc)
    keep = (left >= width) | ((n_words[doc] < width) & (np.arange(len(h)) == w[doc]))
    acc, doc = acc[keep], doc[keep]
    edges = np.searchsorted(doc, np.arange(n_doc + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        acc[a:b].sort()
    first = np.ones(len(acc), bool)
    first[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    acc, doc = acc[first], doc[first]
    return acc, np.searchsorted(doc, np.arange(n_doc + 1))
