"""BPE encoding and decoding over a minimal acyclic transducer (operator 2).

The corpus' most frequent words (`LEXICON_WORDS` at most, counted over all
documents) and their ids form a lexicon: an acyclic automaton that shares
prefixes and suffixes, whose transitions add up to a word's number and so to its
ids. The automaton is one flat array of bounded size that Spark broadcasts and
each worker memory-maps from a file. Words that it does not accept are merged exactly,
so the lexicon changes the speed and never the result.

Defined results: a null text counts as empty (no ids, hash of nothing). Repeated
rows give repeated results, an empty table an empty one; other columns of the
input are ignored. The strings of special tokens in a text become those tokens,
as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import pieces, textops as T
from .merges import Merges
from .workspace import most_frequent, store

#: Bound of the lexicon, and so of its file.
LEXICON_WORDS = 1 << 15
#: Bytes of text whose words are made distinct together.
CHUNK = 4 << 20

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def normalize(text: str) -> str:
    """NFC and lower case, each character by itself (no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Transducer:
    """Minimal acyclic automaton of sorted words with additive outputs, as one int32 array."""

    @staticmethod
    def build(words: list[bytes], ids: list[list[int]]) -> np.ndarray:
        """words: sorted and distinct; ids: theirs."""
        registry: dict[tuple, int] = {}
        frozen: list[tuple[bool, tuple]] = []  # final, ((label, state), ...)

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in registry:
                registry[key] = len(frozen)
                frozen.append(key)
            return registry[key]

        path: list[list] = [[False, []]]  # nodes of the last word: final, finished transitions
        last = b""

        def shorten(to: int) -> None:
            while len(path) > to + 1:
                state = freeze(path.pop())
                path[-1][1].append((last[len(path) - 1], state))

        for word in words:
            common = len(os.path.commonprefix([last, word]))
            shorten(common)
            path.extend([False, []] for _ in word[common:])
            path[-1][0] = True
            last = word
        shorten(0)
        root = freeze(path[0])
        below = []  # words accepted from each state; targets are always frozen before
        keys, targets, skips = [], [], []
        for state, (final, moves) in enumerate(frozen):
            total = int(final)
            for label, target in moves:
                keys.append(state * 256 + label)
                targets.append(target)
                skips.append(total)
                total += below[target]
            below.append(total)
        firsts = np.cumsum([0, *map(len, ids)])
        head = [len(frozen), len(keys), len(words), int(firsts[-1]), root]
        flat = [x for run in ids for x in run]
        return np.array([*head, *keys, *targets, *skips, *[int(f) for f, _ in frozen], *firsts, *flat], dtype=np.int32)

    def __init__(self, data: np.ndarray):
        states, moves, words, n_ids, self.root = map(int, data[:5])
        sizes = [moves, moves, moves, states, words + 1, n_ids]
        cuts = np.cumsum([5, *sizes])
        self.keys, self.targets, self.skips, self.final, self.firsts, self.ids = (data[a:b] for a, b in zip(cuts, cuts[1:]))

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word (span of raw), -1 for words that are not accepted."""
        number = np.full(len(starts), -1, dtype=np.int64)
        if not len(self.keys):
            return number
        live = np.arange(len(starts))
        state, total = np.full(len(starts), self.root, np.int64), np.zeros(len(starts), np.int64)
        at = starts.copy()
        while len(live):
            over = at == ends[live]
            if over.any():
                accepted = over & (self.final[state] == 1)
                number[live[accepted]] = total[accepted]
                live, state, total, at = live[~over], state[~over], total[~over], at[~over]
            key = state * 256 + raw[at]
            move = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[move] == key
            live, state, total, at = live[ok], self.targets[move[ok]].astype(np.int64), total[ok] + self.skips[move[ok]], at[ok] + 1
        return number


class Coder:
    """Encodes and decodes whole chunks of texts."""

    def __init__(self, path: str, transducer: Transducer | None = None):
        self.merges = Merges(path)
        self.transducer = transducer
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) + ")")

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and how many each has."""
        if self.transducer is None:
            return self.merges.encode(raw, starts, ends)
        number = self.transducer.find(raw, starts, ends)
        known = number >= 0
        merged, merged_n = self.merges.encode(raw, starts[~known], ends[~known])
        firsts = np.asarray(self.transducer.firsts, dtype=np.int64)
        pool = np.concatenate([np.asarray(self.transducer.ids, dtype=np.int64), merged])
        n = np.empty(len(starts), dtype=np.int64)
        begin = np.empty(len(starts), dtype=np.int64)
        n[known] = np.diff(firsts)[number[known]]
        begin[known] = firsts[number[known]]
        n[~known] = merged_n
        begin[~known] = len(self.transducer.ids) + np.cumsum(merged_n) - merged_n
        ends_of = np.cumsum(n)
        return pool[np.repeat(begin - (ends_of - n), n) + np.arange(int(n.sum()))], n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (little-endian unsigned 32-bit) and each text's place in them (one entry more)."""
        if any("<|" in t and self.special.search(t) for t in texts):
            return self._encode_special(texts)
        texts = [normalize(t) for t in texts]
        joined = "".join(texts)
        codes = pieces.code_points(joined)
        doc_starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=doc_starts[1:])
        starts, ends = pieces.split_words(codes, doc_starts[:-1])
        at, raw = pieces.byte_starts(codes), np.frombuffer(joined.encode(), dtype=np.uint8)
        place, which = pieces.distinct(raw, at[starts], at[ends])
        flat, lengths = self.words(raw, at[starts[place]], at[ends[place]])
        ids, run_ends = pieces.spread(flat.astype("<u4"), lengths, which)
        return ids, np.append(0, run_ends)[np.searchsorted(starts, doc_starts)]

    def _encode_special(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), for texts that hold strings of special tokens."""
        parts, n = [], []
        for text in texts:
            own = []
            for part in self.special.split(text):
                own.append(np.array([self.merges.special[part]], dtype="<u4") if part in self.merges.special else self.encode([part])[0])
            parts += own
            n.append(sum(map(len, own)))
        return np.concatenate(parts).astype("<u4"), np.append(0, np.cumsum(n))

    def decode(self, ids: list[int]) -> str:
        """The tokenizer has no decoder: its tokens, one space between them."""
        return " ".join(map(self.merges.tokens.__getitem__, ids))


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The words of letters that occur most often in all texts (twice at least), at most `most`."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    return most_frequent(store(counted, "words"), most).select("word").toArrow()["word"].to_pylist()


def compile_lexicon(words: list[str], path: str) -> np.ndarray:
    """The transducer of these words (normalised, made distinct and sorted) under a tokenizer file."""
    spans = sorted({normalize(w).encode() for w in words} - {b""})
    ends = np.cumsum([len(s) for s in spans], dtype=np.int64) if spans else np.zeros(0, np.int64)
    starts = ends - np.array([len(s) for s in spans], dtype=np.int64)
    flat, n = Merges(path).encode(np.frombuffer(b"".join(spans), dtype=np.uint8), starts, ends)
    cuts = np.cumsum(n)[:-1] if len(n) else []
    return Transducer.build(spans, [x.tolist() for x in np.split(flat, cuts)] if spans else [])


def memory_map(data: np.ndarray) -> np.ndarray:
    """Put the automaton in a nameless scratch file of this worker and map it, so its pages stay reclaimable."""
    with tempfile.TemporaryFile() as file:
        file.write(data.tobytes())
        file.flush()
        return np.memmap(file, dtype=data.dtype, mode="r")


def encode_corpus(docs: DataFrame, path: str | None = None, most: int = LEXICON_WORDS) -> DataFrame:
    """Ids (array of int) and decoded text of every document."""
    return _apply(docs, path or tokenizer_path(), most, "doc_id long, ids array<int>, decoded string", _rows)


def _rows(ids: np.ndarray, coder: Coder):
    numbers = ids.tolist()
    return numbers, coder.decode(numbers)


def _digest(ids: np.ndarray, coder: Coder):
    decoded = coder.decode(ids.tolist())
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _apply(docs: DataFrame, path: str, most: int, schema: str, make) -> DataFrame:
    lexicon = docs.sparkSession.sparkContext.broadcast(compile_lexicon(frequent_words(docs, most), path))
    arrow = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[f.split()[1]]) for f in schema.split(", ")])

    def run(batches):
        coder = Coder(path, Transducer(memory_map(lexicon.value)))
        for batch in batches:
            for lo, hi, buf, offs in T.documents(batch.column(1), CHUNK):
                raw = buf.tobytes()
                ids, bounds = coder.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(offs, offs[1:])])
                out = [make(ids[a:b], coder) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *(pa.array(c, t.type) for c, t in zip(zip(*out), list(arrow)[1:]))], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op2_bpe_lexicon(spark, sf_dir: str) -> DataFrame:
    return _apply(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), LEXICON_WORDS, SCHEMA, _digest)
