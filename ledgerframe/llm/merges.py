"""Byte-pair merges for many words at once.

In every round each unfinished word merges its pair of lowest rank wherever it
stands (left to right, without overlap). A pair made by a merge has a higher
rank than that merge, so this gives the same symbols as merging one at a time.
Very long words go through a heap, so their cost stays near linear.
"""

from __future__ import annotations

import heapq
import json

import numpy as np

#: Words of more bytes than this are merged one by one with a heap.
LONG_WORD = 64
_NONE = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """The merge table of a tokenizer file, with lookups by hashing."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], dtype=np.int64)
        self.tokens = [""] * (1 + max(*vocab.values(), *[t["id"] for t in spec["added_tokens"]]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.bits = max(10, int(4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.full(1 << self.bits, _NONE, dtype=np.int32)
        self.made = np.zeros(1 << self.bits, dtype=np.int64)
        keys = (left << 32) | right
        for key, slot, r, m in zip(keys.tolist(), self._slot(keys).tolist(), range(len(pairs)), made.tolist()):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & ((1 << self.bits) - 1)
            if self.keys[slot] == -1:
                self.keys[slot], self.rank[slot], self.made[slot] = key, r, m

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair in the table (its rank there is _NONE if there is no such merge)."""
        keys = (left << 32) | right
        slot = self._slot(keys)
        have = self.keys[slot]
        todo = np.flatnonzero((have != keys) & (have != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            have = self.keys[slot[todo]]
            todo = todo[(have != keys[todo]) & (have != -1)]
        return slot

    def encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (spans of raw, none empty), one after another, and how many each has."""
        size = ends - starts
        short = np.flatnonzero(size <= LONG_WORD)
        n = size[short]
        word = np.repeat(short, n)
        first = np.cumsum(n) - n
        at = np.repeat(starts[short] - first, n) + np.arange(len(word))
        symbol = self.inner[raw[at]]
        if len(n):
            symbol[first + n - 1] = self.final[raw[ends[short] - 1]]
        done_word, done_symbol = [], []
        while len(word):
            pair = np.empty(len(word), dtype=np.int64)
            pair[:-1] = self.find(symbol[:-1], symbol[1:])
            pair[-1] = 0
            rank = self.rank[pair]
            rank[:-1][word[1:] != word[:-1]] = _NONE
            rank[-1] = _NONE
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(word)))
            active = np.repeat(least != _NONE, length)
            if not active.all():
                done_word.append(word[~active])
                done_symbol.append(symbol[~active])
                word, symbol, rank, pair = word[active], symbol[active], rank[active], pair[active]
                if not len(word):
                    break
                length, least = length[least != _NONE], least[least != _NONE]
            chosen = rank == np.repeat(least, length)
            run = chosen.copy()
            run[1:] &= ~chosen[:-1]
            index = np.arange(len(word))
            chosen &= ((index - np.maximum.accumulate(np.where(run, index, 0))) & 1) == 0
            hit = np.flatnonzero(chosen)
            symbol[hit] = self.made[pair[hit]]
            keep = np.ones(len(word), dtype=bool)
            keep[hit + 1] = False
            word, symbol = word[keep], symbol[keep]
        for w in np.flatnonzero(size > LONG_WORD).tolist():
            ids = self.encode_long(raw[starts[w] : ends[w]])
            done_word.append(np.full(len(ids), w))
            done_symbol.append(np.array(ids, dtype=np.int64))
        if not done_word:
            return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
        words, symbols = np.concatenate(done_word), np.concatenate(done_symbol)
        return symbols[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(starts))

    def encode_long(self, raw: np.ndarray) -> list[int]:
        """One word, with a heap of (rank, place) over a linked list of symbols."""
        symbol = self.inner[raw].tolist()
        symbol[-1] = int(self.final[raw[-1]])
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], int] = {}

        def slot(a: int, b: int) -> int:
            got = known.get((a, b))
            if got is None:
                got = known[(a, b)] = int(self.find(np.array([a]), np.array([b]))[0])
            return got

        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if 0 <= i < n and after[i] < n:
                a, b = symbol[i], symbol[after[i]]
                rank = int(self.rank[slot(a, b)])
                if rank != _NONE:
                    heapq.heappush(heap, (rank, i, a, b))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if symbol[i] == a else n
            if j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = int(self.made[slot(a, b)]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbol if s >= 0]
