"""Best-fit packing by exact-complement hashing (operator 9).

1. Each document is encoded and closed with an end token; longer documents are
   cut into full pieces (the remainder comes first).
2. Only the histogram of piece lengths (at most `capacity` entries) reaches the
   driver. There, the sums of single, pair and triple lengths are looked up for
   the gap each length leaves; combinations are consumed as often as the counts
   allow. What is left goes best-fit, also by counts.
3. The plan is a table of intervals (length, first rank, how often, sequence,
   offset). Pieces get their rank among equal lengths from prefix counts over
   hash shards, so no length, however frequent, meets in one task.

Defined results: null and empty texts are documents of one end token. Repeated
rows and equal doc_ids are packed as separate documents. An empty table gives
an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import pieces as pieces_of, textops as T
from .merges import Merges
from .workspace import store

CAPACITY = 1024
END_ID = 2
ROWS_PER_SHARD = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteEncoder:
    """Ids of the byte-level tokenizer for whole chunks of documents.

    The tokenizer encodes the words that its pattern splits off one by one, so
    equal words have equal ids and are encoded once per chunk, with the merges
    of the tokenizer's file. Texts that hold a special string go through the
    tokenizers library itself.
    """

    SPECIAL = b"<|endoftext|>"
    #: Bytes of text whose words are made distinct together; a longer document is cut between words.
    CHUNK = 2 << 20

    def __init__(self, path: str):
        self.path = path
        self.merges = Merges(path)
        self._library = None

    def library(self, text: str) -> np.ndarray:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_padding()
            self._library.no_truncation()
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (little-endian unsigned 32-bit) and each document's place in them (one entry more)."""
        if len(offsets) == 2 and len(buf) > self.CHUNK and self.SPECIAL not in buf.tobytes():
            cuts = safe_cuts(buf, self.CHUNK)
            ids = np.concatenate([self._encode(buf[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:])])
            return ids, np.array([0, len(ids)])
        return self._encode(buf, offsets)

    def _encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])]
        codes = pieces_of.code_points("".join(texts))
        doc_starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=doc_starts[1:])
        starts = pieces_of.split_bytelevel(codes, doc_starts[:-1])
        at = pieces_of.byte_starts(codes)
        clean = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
        ends = np.append(starts[1:], len(codes))
        place, which = pieces_of.distinct(clean, at[starts], at[ends])
        flat, lengths = self.merges.encode(clean, at[starts[place]], at[ends[place]])
        ids, run_ends = pieces_of.spread(flat.astype("<u4"), lengths, which)
        bounds = np.append(0, run_ends)[np.searchsorted(starts, doc_starts)]
        if self.SPECIAL in raw:
            parts = [self.library(t) if self.SPECIAL.decode() in t else ids[a:b] for t, a, b in zip(texts, bounds, bounds[1:])]
            return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))
        return ids, bounds


def safe_cuts(buf: np.ndarray, limit: int) -> list[int]:
    """Places that cut one text into parts of about `limit` bytes: before a space between two ASCII letters, where a word always ends."""
    letter = (buf | 32 >= 97) & (buf | 32 <= 122)
    ok = np.flatnonzero((buf[1:-1] == 32) & letter[:-2] & letter[2:]) + 1
    cuts = [0]
    while cuts[-1] + limit < len(buf):
        at = np.searchsorted(ok, cuts[-1] + limit, side="right") - 1
        if at < 0 or ok[at] <= cuts[-1]:
            at += 1  # no such place within the limit: the next one
        if at >= len(ok):
            break
        cuts.append(int(ok[at]))
    return [*cuts, len(buf)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of at most `capacity` tokens."""

    def cut(batches):
        coder = ByteEncoder(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for lo, hi, buf, offs in T.documents(batch.column(1), coder.CHUNK):
                tokens, bounds = coder.encode(buf, offs)
                data, out = tokens.tobytes(), []
                for doc, a, b in zip(batch.column(0)[lo:hi].to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                    own, n = data[4 * a : 4 * b] + end, b - a + 1
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    out += [(doc, i, s, e - s, zlib.crc32(own[4 * s : 4 * e])) for i, (s, e) in enumerate(zip(edges, edges[1:]))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence, number of such sequences) that use every piece once."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        have[length] = n
    done: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> None:
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(have[x]) // k for x, k in need.items())
        if times:
            done.append((lengths, times))
            for x, k in need.items():
                have[x] -= k * times

    if have[capacity]:
        use((capacity,))
    for longest in range(capacity - 1, 0, -1):
        gap = capacity - longest
        if not have[longest]:
            continue
        use((longest, gap))
        for exact in (pairs, triples):
            for rest in exact(have, gap, longest):
                use((longest, *rest))
                if not have[longest]:
                    break
            if not have[longest]:
                break
    return done + best_fit(have, capacity)


def pairs(have: np.ndarray, gap: int, longest: int):
    """(a, b) with a >= b and a + b = gap that are available when they come up; what is used up meanwhile is left out."""
    a = np.arange((gap + 1) // 2, min(gap - 1, longest) + 1)
    for x in a[(have[a] > 0) & (have[gap - a] > 0)][::-1].tolist():
        if have[x] and have[gap - x]:
            yield x, gap - x


def triples(have: np.ndarray, gap: int, longest: int):
    """(a, b, c) with a >= b >= c and a + b + c = gap, in the same way: all b for every a."""
    for a in range(min(longest, gap - 2), (gap - 1) // 3, -1):
        if have[a]:
            for b, c in pairs(have, gap - a, a):
                yield a, b, c
                if not have[a]:
                    break


def best_fit(have: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: open sequences are kept by gap, with how many share a pattern."""
    open_by_gap: dict[int, list[list]] = defaultdict(list)  # gap -> [pattern, how many]
    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            gap = next((g for g in range(length, capacity) if open_by_gap.get(g)), None)
            if gap is None:
                fit = capacity // length  # as many of this length as one sequence holds
                if left >= fit:
                    open_by_gap[capacity - fit * length].append([(length,) * fit, left // fit])
                    left %= fit
                else:
                    open_by_gap[capacity - left * length].append([(length,) * left, 1])
                    left = 0
                continue
            pattern, n = open_by_gap[gap][-1]
            take = min(n, left)
            if take == n:
                open_by_gap[gap].pop()
            else:
                open_by_gap[gap][-1][1] -= take
            open_by_gap[gap - length].append([(*pattern, length), take])
            left -= take
    have[:] = 0
    return [(tuple(p), n) for group in open_by_gap.values() for p, n in group]


def intervals(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, sequence of that rank, offset), ranks ascending."""
    used: dict[int, int] = defaultdict(int)
    rows: dict[int, list] = defaultdict(list)
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows[x].append((used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return {x: np.array(r, dtype=np.int64) for x, r in rows.items()}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = docs.sparkSession
    cut = store(pieces(docs, path or tokenizer_path(), capacity).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1 << 16)).cast("int")), "pieces")
    per_shard = cut.groupBy("length", F.pmod("shard", F.lit(64)).alias("coarse")).agg(F.count("*").alias("n"))
    found = per_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()
    table = intervals(plan({int(r["length"]): int(r["n"]) for r in found}, capacity))
    # rank of a piece among those of its length: pieces in earlier shards, then its row number in its own shard
    most = max([r["n"] for r in found], default=0)
    shards = int(min(1 << 16, max(64, -(-most // ROWS_PER_SHARD))))
    by = F.pmod("shard", F.lit(shards)).alias("shard")
    rows = cut.select("doc_id", "piece", "start", "length", "ids_crc32", by)
    counts = rows.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = rows.withColumn("nr", F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before.select("length", "shard", F.coalesce("before", F.lit(0)).alias("before")), ["length", "shard"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nr") - 1).alias("rank"))
    shared = spark.sparkContext.broadcast(table)

    def place(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                t = shared.value[int(x)]
                k = np.searchsorted(t[:, 0], rank[at], side="right") - 1
                sequence[at] = t[k, 1] + rank[at] - t[k, 0]
                offset[at] = t[k, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
