"""Splitting text into the words that byte-pair tokenizers merge, for whole chunks at once.

Both public tokenizers used here split at changes between letters, digits,
white space and other characters. The splits are computed on arrays of code
points, and equal words are encoded once per chunk.
"""

from __future__ import annotations

import numpy as np

from . import textops as T

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
#: White space in the Unicode sense (fixed values).
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of each code point (made once per worker)."""
    if not _CLASSES:
        import regex

        kind = np.full(0x110000, OTHER, dtype=np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for value, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}")):
            found = "".join(regex.findall(pattern, every))
            kind[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = value
        kind[WHITE_SPACE] = SPACE
        _CLASSES.append(kind)
    return _CLASSES[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def byte_starts(codes: np.ndarray) -> np.ndarray:
    """Place of each code point in the UTF-8 bytes, and the length of these as last entry."""
    out = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), out=out[1:])
    return out


def _contractions(codes, kind, run_start, opens, skip_after_space: bool):
    """Apostrophes that open 's 't 're 've 'm 'll 'd, and how many letters follow in each."""
    n = len(codes)
    at = np.flatnonzero((codes == 39) & run_start)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~opens[at + 1]]
    if skip_after_space and len(at):
        at = at[(at == 0) | opens[at] | (codes[at - 1] != 32)]
    one = codes[at + 1]
    end = np.minimum(at + 2, n - 1)
    two = np.where((end == at + 2) & ~opens[end], codes[end], 0)
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l")))
    letters = np.where(single, 1, np.where(double, 2, 0))
    return at[letters > 0], letters[letters > 0]


def _runs(codes: np.ndarray, doc_starts: np.ndarray):
    """Class of each code point, whether a run of one class starts there, whether a document does."""
    kind = classes()[codes]
    opens = np.zeros(len(codes), dtype=bool)
    opens[doc_starts[doc_starts < len(codes)]] = True
    run_start = opens.copy()
    run_start[1:] |= kind[1:] != kind[:-1]
    return kind, run_start, opens


def _open_after(starts, at, letters):
    """A contraction is one word; letters that follow it open another."""
    starts[at + 1] = False
    after = at + 1 + letters
    starts[after[after < len(starts)]] = True


def split_bytelevel(codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """First code points of all words; words cover the text, a space belongs to the word after it."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind, run_start, opens = _runs(codes, doc_starts)
    starts = run_start.copy()
    # the last white space before a word: alone, or (a plain space) part of that word
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~opens[1:])
    starts[last] = True
    starts[last[codes[last] == 32] + 1] = False
    at, letters = _contractions(codes, kind, run_start, opens, True)
    _open_after(starts, at, letters)
    return np.flatnonzero(starts)


def split_words(codes: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last code points of all words; white space is dropped, digits stand alone."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind, run_start, opens = _runs(codes, doc_starts)
    starts = run_start | (kind == DIGIT)
    at, letters = _contractions(codes, kind, run_start, opens, False)
    _open_after(starts, at, letters)
    first = np.flatnonzero(starts)
    end = np.append(first[1:], n)
    keep = kind[first] != SPACE
    return first[keep], end[keep]


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place for each distinct span of bytes, and for every span which of these it equals."""
    _, place, inverse = np.unique(T.span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    return place, inverse


def spread(ids: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the id runs of `which` (runs of `lengths` entries in ids); also each run's end."""
    first = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=first[1:])
    n = lengths[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    source = np.repeat(first[which] - (ends - n), n) + np.arange(total)
    return ids[source], ends
