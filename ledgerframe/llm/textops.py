"""Vectorised helpers over UTF-8 text inside Arrow batches.

All helpers work on a flat byte buffer holding several documents, so a task
never loops over words in Python. Words are the runs of `[^\\x20\\x09-\\x0D]+`;
all separators are ASCII, so byte positions are safe in UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once (a single longer document is still taken whole).
CHUNK_BYTES = 1 << 20

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = {"byte": U64(0x9E3779B97F4A7C15), "word": U64(0xD6E8FEB86659FD93)}
_POWERS: dict[tuple[str, bool], np.ndarray] = {}


def powers(kind: str, n: int, inverse: bool = False) -> np.ndarray:
    """First n powers of the odd base of `kind` (or of its inverse) modulo 2**64."""
    have = _POWERS.get((kind, inverse))
    if have is None or len(have) < n:
        base = int(_BASE[kind])
        step = pow(base, -1, 1 << 64) if inverse else base
        have = np.full(max(n, CHUNK_BYTES // 4), U64(step))
        have[0] = U64(1)
        have = np.cumprod(have, dtype=U64)
        _POWERS[(kind, inverse)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def documents(column: pa.Array, limit: int = CHUNK_BYTES):
    """Yield (first row, one past the last row, bytes, offsets) for runs of rows.

    offsets has one entry more than there are rows; null texts are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and each document's first word (one entry more)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, the same wherever the span stands."""
    n = len(buf)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(_BYTE_VALUE[buf] * powers("byte", n, inverse=True), out=total[1:])
    h = (total[ends] - total[starts]) * powers("byte", n + 1)[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def window_hashes(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive entries (len - size + 1 of them)."""
    n = len(word_hash)
    if n < size:
        return np.zeros(0, U64)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(word_hash * powers("word", n, inverse=True), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers("word", n - size + 1))


def window_starts(first_word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of `size` words stays inside its document, and that document."""
    counts = np.diff(first_word)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(doc))
    ok = at + size <= first_word[1:][doc] if len(doc) else np.zeros(0, bool)
    return at[ok], doc[ok]


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a byte- or word-level array between consecutive offsets."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])
