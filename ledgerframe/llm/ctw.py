"""LM scoring by context-tree weighting (operator 8).

Text is a sequence of bytes (A-Z lower-cased), closed by a byte that UTF-8 never
uses. A byte is eight binary decisions; each decision has a tree of contexts made
of the bytes before it, with a Krichevsky-Trofimov estimate at every node.
Weighting mixes the estimates of all depths: P_w = (P_kt + prod P_w(children)) / 2,
and the share of each depth on a path follows from these. The training text is
fixed, so the mixed probability of every byte after every context is a table.

The counts of all (context, byte) pairs are summed by Spark over all training
documents. The tree keeps every context of up to MAX_DEPTH = 3 bytes that occurs; one
that does not is a leaf of the one below it. Contexts of up to two bytes (at most
65,793) and the `CONTEXTS` most frequent of three have their rows of 256 floats in a
broadcast table of fixed size; bytes after other contexts of three are joined with
their probabilities, which come of the same mixture.

Base: add-one unigram over words, with counts keyed by 64-bit word hashes. The
`HEAD` most frequent words are broadcast; the others are joined.

Defined results: null and empty texts are one end token. Rows with a null doc_id
are not learned from. With no training documents every byte is uniform, and
counts are 0. Repeated rows give repeated results; an empty table an empty one;
other columns of the input are ignored.
"""

from __future__ import annotations

from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .workspace import most_frequent, store

MAX_DEPTH = 3
#: Contexts of three bytes whose rows are broadcast (numbered with 16 bits, at most 65,534); the rest are joined.
CONTEXTS = 49_152
#: Number of a context of three bytes that is joined.
JOINED = 0xFFFF
#: Groups that contexts of two bytes are dealt over, and contexts of three bytes taken together in a group.
GROUPS = 1024
SLICE = 1024
#: Words whose counts are broadcast (16 bytes each); the rest are joined.
HEAD = 1 << 20
END_BYTE = 0xFF
#: Key of the end token; no word hash is given this value.
END_TOKEN = -1
PAD = b"\x00\x00\x00"
CHUNK = 2 << 20


def stream(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the last three bytes before each scored byte, these bytes, and each document's first one.

    Every document is preceded by MAX_DEPTH zero bytes and followed by the end byte.
    """
    sizes = np.diff(offsets)
    wide = np.zeros(len(buf) + (MAX_DEPTH + 1) * len(sizes), dtype=np.uint8)
    shift = (MAX_DEPTH + 1) * np.arange(len(sizes)) + MAX_DEPTH
    wide[np.arange(len(buf)) + np.repeat(shift, sizes)] = T.LOWER[buf]
    wide[offsets[1:] + shift] = END_BYTE
    scored = np.ones(len(wide), dtype=bool)
    for k in range(MAX_DEPTH):
        scored[offsets[:-1] + shift - 1 - k] = False
    at = np.flatnonzero(scored)
    context = (wide[at - 3].astype(np.uint32) << 16) | (wide[at - 2].astype(np.uint32) << 8) | wide[at - 1]
    return context, wide[at], np.append(offsets[:-1] + np.arange(len(sizes)), len(at))


def word_keys(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (signed) of the lower-cased words, and each document's first word."""
    low = T.LOWER[buf]
    starts, ends, first = T.words(low, offsets)
    keys = T.span_hashes(low, starts, ends).view(np.int64)
    return np.where(keys == END_TOKEN, 0, keys), first


class Totals:
    """Counts by key, merged chunk by chunk."""

    def __init__(self, dtype):
        self.keys, self.n, self.waiting, self.size = np.zeros(0, dtype), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        found = np.unique(keys, return_counts=True)
        self.waiting.append(found)
        self.size += len(found[0])
        if self.size > max(1 << 20, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        n = np.concatenate([self.n, *[c for _, c in self.waiting]])
        self.keys, inverse = np.unique(keys, return_inverse=True)
        self.n = np.bincount(inverse, weights=n, minlength=len(self.keys)).astype(np.int64)
        self.waiting, self.size = [], 0


def counts(docs: DataFrame) -> DataFrame:
    """kind (0 word, 1 byte after context), key, n over all texts."""

    def count(batches):
        words, grams = Totals(np.int64), Totals(np.uint32)
        n_docs = 0
        for batch in batches:
            n_docs += batch.num_rows
            for _, _, buf, offs in T.documents(batch.column(0), CHUNK):
                words.add(word_keys(buf, offs)[0])
                context, byte, _ = stream(buf, offs)
                grams.add((context << np.uint32(8)) | byte)
        for kind, total in ((0, words), (1, grams)):
            total.merge()
            for lo in range(0, len(total.keys), 1 << 18):
                keys = total.keys[lo : lo + (1 << 18)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(total.n[lo : lo + (1 << 18)])], names=["kind", "key", "n"])
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([END_TOKEN], pa.int64()), pa.array([n_docs], pa.int64())], names=["kind", "key", "n"])

    partial = docs.select(F.col("text").cast("string")).mapInArrow(count, "kind int, key long, n long")
    return partial.groupBy("kind", "key").agg(F.sum("n").alias("n"))


_LGAMMA_HALF = lgamma(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument above 8."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift = np.where(small, shift + np.log(np.where(small, y, 1.0)), shift)
        y = np.where(small, y + 1, y)
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - 2 * _LGAMMA_HALF


def kt_of_decisions(counts: np.ndarray) -> np.ndarray:
    """log KT of all 255 decisions of each row of byte counts, decision (1 << bit) + prefix in column one less."""
    out = np.zeros((len(counts), 255))
    for bit in range(8):
        halves = counts.reshape(len(counts), 1 << bit, 2, -1).sum(axis=3)
        a, b = halves[:, :, 0], halves[:, :, 1]
        met = (a + b) > 0
        level = np.zeros(met.shape)
        level[met] = log_kt(a[met], b[met])
        out[:, (1 << bit) - 1 : (2 << bit) - 1] = level
    return out


def upper_sums(grams: DataFrame) -> DataFrame:
    """For every context of two bytes: counts of the bytes after it, log KT summed over all contexts of three bytes above it
    for each decision, and which bytes stand before it (bits). All contexts of three bytes count; none leaves its group.
    """

    def add_up(table: pa.Table) -> pa.Table:
        key, n = table["key"].to_numpy(), table["n"].to_numpy()
        # in the order of the two nearest bytes, then the third
        context = key >> 8
        order = np.argsort(((context & 0xFFFF) << 8) | (context >> 16), kind="stable")
        context, byte, n = context[order], (key & 255)[order], n[order]
        begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        cuts = np.append(begin, len(context))
        pair = context[begin] & 0xFFFF
        pairs, at = np.unique(pair, return_inverse=True)
        counts, kt, seen = np.zeros((len(pairs), 256)), np.zeros((len(pairs), 255)), np.zeros((len(pairs), 256), bool)
        seen[at, context[begin] >> 16] = True
        for lo in range(0, len(begin), SLICE):
            hi = min(lo + SLICE, len(begin))
            rows = np.zeros((hi - lo, 256))
            part = slice(cuts[lo], cuts[hi])
            rows[np.repeat(np.arange(hi - lo), np.diff(cuts[lo : hi + 1])), byte[part]] = n[part]
            np.add.at(counts, at[lo:hi], rows)
            np.add.at(kt, at[lo:hi], kt_of_decisions(rows))
        blob = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
        return pa.table({"pair": pairs, "counts": blob(counts), "kt": blob(kt), "seen": blob(np.packbits(seen, axis=1))})

    pair = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
    return grams.select(F.pmod(F.xxhash64(pair), F.lit(GROUPS)).alias("group"), "key", "n").groupBy("group").applyInArrow(add_up, "pair long, counts binary, kt binary, seen binary")


def _matrix(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), dtype=kind).reshape(-1, width)


def lower_tree(grams: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of up to two bytes (depth, bytes; ascending), the counts of the bytes after them, and for those of two bytes
    what upper_sums gives: log KT of what is above, and the bytes before. At most 65,793 contexts however large the corpus is.
    """
    rows = upper_sums(grams).toArrow()
    order = np.argsort(rows["pair"].to_numpy())
    pairs, counts, kt, seen = (x[order] for x in (rows["pair"].to_numpy(), _matrix(rows["counts"], np.float64, 256), _matrix(rows["kt"], np.float64, 255), _matrix(rows["seen"], np.uint8, 32)))
    last, at = np.unique(pairs & 255, return_inverse=True)
    single = np.zeros((len(last), 256))
    np.add.at(single, at, counts)
    depth_of = np.repeat([0, 1, 2], [1, len(last), len(pairs)])
    return depth_of, np.concatenate([[0], last, pairs]).astype(np.int64), np.concatenate([counts.sum(axis=0)[None], single, counts]), kt, np.unpackbits(seen, axis=1).astype(bool)


def head_counts(grams: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent contexts of three bytes (ascending), and the counts of the bytes after them."""
    context = F.shiftright("key", 8).alias("context")
    top = most_frequent(grams.groupBy(context).agg(F.sum("n").alias("n")), most).select("context").toArrow()["context"].to_numpy()
    top = np.sort(top)
    chosen = grams.sparkSession.createDataFrame(pa.table({"context": top}))
    found = grams.select(context, F.col("key").bitwiseAND(F.lit(255)).alias("byte"), "n").join(F.broadcast(chosen), "context", "left_semi").toArrow()
    counts = np.zeros((len(top), 256))
    counts[np.searchsorted(top, found["context"].to_numpy()), found["byte"].to_numpy()] = found["n"].to_numpy()
    return top, counts


def decisions(depth_of: np.ndarray, value: np.ndarray, table: np.ndarray, above: np.ndarray | None = None):
    """For every decision: its number from 0, the bytes that go to one and to zero, P(one) at every node, and what the nodes' estimates
    leave to the mixture above them: the probability mixed so far and the share that is left.

    above: log KT summed over all contexts above each node of the last depth, if the tree goes on there.
    """
    nodes, last = len(value), int(depth_of.max())
    place = {(int(d), int(v)): i for i, (d, v) in enumerate(zip(depth_of, value))}
    parent = np.array([0] + [place[(int(d) - 1, int(v) & ((1 << (8 * (int(d) - 1))) - 1))] for d, v in zip(depth_of[1:], value[1:])], dtype=np.int64)
    bytes_ = np.arange(256)
    for bit in range(8):
        for prefix in range(1 << bit):
            number = (1 << bit) + prefix - 1
            inside = (bytes_ >> (8 - bit)) == prefix
            one = inside & (((bytes_ >> (7 - bit)) & 1) == 1)
            zero = inside & ~one
            a, b = table[:, zero].sum(axis=1), table[:, one].sum(axis=1)
            kt = log_kt(a, b)
            # bottom up: what the children of a node say; counts that fall to no child stay with the node's own estimate
            log_w, share = kt.copy(), np.ones(nodes)

            def weighted(own, below):
                log_w[own] = np.logaddexp(kt[own], below) - log(2)
                share[own] = np.exp(kt[own] - log(2) - log_w[own])

            if above is not None:
                weighted(np.flatnonzero(depth_of == last), above[:, number])
            for d in range(last - 1, -1, -1):
                kids = np.flatnonzero(depth_of == d + 1)
                own = np.flatnonzero(depth_of == d)
                sums = [np.bincount(parent[kids], weights=x[kids], minlength=nodes)[own] for x in (log_w, a, b)]
                weighted(own, sums[0] + log_kt(a[own] - sums[1], b[own] - sums[2]))
            p = (b + 0.5) / (a + b + 1)
            mixed = p.copy()
            # top down: below a node its child's mixture takes what the node's own estimate leaves
            reach = np.ones(nodes)
            total = np.zeros(nodes)
            for d in range(last + 1):
                own = np.flatnonzero(depth_of == d)
                if d:
                    reach[own] = reach[parent[own]] * (1 - share[parent[own]])
                    total[own] = total[parent[own]] + reach[parent[own]] * share[parent[own]] * p[parent[own]]
                mixed[own] = total[own] + reach[own] * p[own]
            yield number, one, zero, mixed, total + reach * share * p, reach * (1 - share)


def weigh(depth_of: np.ndarray, value: np.ndarray, table: np.ndarray) -> np.ndarray:
    """log10 P(byte | context) for every node of the tree and every byte, as float32."""
    return weigh_lower(depth_of, value, table, None)[0]


def weigh_lower(depth_of: np.ndarray, value: np.ndarray, table: np.ndarray, above: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, and for the nodes of the last depth what `decisions` leaves to contexts above them: mixed so far, share left."""
    out, top = np.zeros((len(value), 256)), np.flatnonzero(depth_of == (MAX_DEPTH - 1))
    spent, left = np.zeros((len(top), 255)), np.zeros((len(top), 255))
    for number, one, zero, mixed, so_far, rest in decisions(depth_of, value, table, above):
        out[:, one] += np.log10(mixed)[:, None]
        out[:, zero] += np.log10(1 - mixed)[:, None]
        spent[:, number], left[:, number] = so_far[top], rest[top]
    return out.astype(np.float32), spent, left


def weigh_upper(counts: np.ndarray, spent: np.ndarray, left: np.ndarray, row: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """log10 P(byte | context) of contexts of three bytes, as float32. row: the context's row in counts, and in spent and left."""
    sums = np.zeros((len(counts), 257))
    np.cumsum(counts, axis=1, out=sums[:, 1:])
    out = np.zeros(len(byte))
    for bit in range(8):
        prefix = byte >> (8 - bit)
        lo, half = prefix << (8 - bit), 1 << (7 - bit)
        a, b = sums[row, lo + half] - sums[row, lo], sums[row, lo + 2 * half] - sums[row, lo + half]
        number = (1 << bit) + prefix - 1
        p = spent[row, number] + left[row, number] * ((b + 0.5) / (a + b + 1))
        out += np.log10(np.where((byte >> (7 - bit)) & 1, p, 1 - p))
    return out.astype(np.float32)


def joined_logs(grams: DataFrame, wanted: DataFrame, mixture: DataFrame) -> DataFrame:
    """key, log (log10 P) of the wanted keys (context of three bytes, byte). mixture: pair, spent, left of the contexts of two bytes."""
    context, byte = F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(F.lit(255)).cast("int")
    asked = wanted.groupBy(context).agg(F.collect_list(byte).alias("asked"))
    counted = grams.groupBy(context).agg(F.collect_list(byte).alias("bytes"), F.collect_list("n").alias("ns"))
    rows = asked.join(counted, "context").withColumn("pair", F.col("context").bitwiseAND(F.lit(0xFFFF))).join(mixture, "pair")

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                n = batch.num_rows
                flat = lambda i: batch.column(i).flatten().to_numpy()  # noqa: B023, E731
                at = lambda i: np.repeat(np.arange(n), batch.column(i).value_lengths().to_numpy())  # noqa: B023, E731
                counts = np.zeros((n, 256))
                counts[at(2), flat(2)] = flat(3)
                row, byte = at(1), flat(1).astype(np.int64)
                logs = weigh_upper(counts, _matrix(batch.column(4), np.float64, 255), _matrix(batch.column(5), np.float64, 255), row, byte)
                yield pa.RecordBatch.from_arrays([pa.array((batch.column(0).to_numpy()[row] << 8) | byte), pa.array(logs.astype(np.float64))], names=["key", "log"])

    return rows.select("context", "asked", "bytes", "ns", "spent", "left").mapInArrow(run, "key long, log double")


class Model:
    """Table of log10 probabilities (contexts of up to two bytes, then the head of those of three) and each context's row in it."""

    def __init__(self, depth_of: np.ndarray, value: np.ndarray, table: np.ndarray, head: np.ndarray, others: np.ndarray):
        """others: the contexts of three bytes that are joined, as 2 ** 24 bits, or none."""
        self.table, self.lower = table.reshape(-1), len(value)
        self.row = np.zeros(1 << 16, dtype=np.int64)
        for depth in range(1, MAX_DEPTH):
            at = np.flatnonzero(depth_of == depth)
            self.row.reshape(-1, 1 << (8 * depth))[:, value[at]] = at
        self.number = np.zeros(1 << 24, dtype=np.uint16)
        self.number[head] = np.arange(1, len(head) + 1)
        if len(others):
            self.number[np.unpackbits(others).view(bool)] = JOINED

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each document's sum over the bytes that are not joined, and the keys of the others with each document's first one."""
        context, byte, first = stream(buf, offsets)
        number = self.number[context]
        later = number == JOINED
        logs = self.table[(np.where((number > 0) & ~later, number + np.int64(self.lower - 1), self.row[context & 0xFFFF]) << 8) | byte]
        logs[later] = 0
        total, rest = np.zeros(len(logs) + 1), np.zeros(len(logs) + 1, np.int64)
        np.cumsum(logs, out=total[1:], dtype=np.float64)
        np.cumsum(later, out=rest[1:])
        return np.diff(total[first]), (context[later].astype(np.int64) << 8) | byte[later], rest[first]


def model_of(grams: DataFrame, most: int) -> tuple[tuple, DataFrame | None]:
    """What Model takes, of fixed size, and the mixture for joined_logs; None if all contexts of three bytes are in the head."""
    depth_of, value, table, kt, seen = lower_tree(grams)
    logs, spent, left = weigh_lower(depth_of, value, table, kt if len(kt) else None)
    head, counts = head_counts(grams, min(most, JOINED - 1))
    pairs = value[depth_of == MAX_DEPTH - 1]
    below = np.searchsorted(pairs, head & 0xFFFF)
    rows = [weigh_upper(counts[lo : lo + SLICE], spent[below[lo : lo + SLICE]], left[below[lo : lo + SLICE]], np.repeat(np.arange(len(counts[lo : lo + SLICE])), 256), np.tile(np.arange(256), len(counts[lo : lo + SLICE]))).reshape(-1, 256) for lo in range(0, len(head), SLICE)]
    others = seen.copy()
    others[below, head >> 16] = False
    if not others.any():
        return (depth_of, value, np.concatenate([logs, *rows]), head, np.zeros(0, np.uint8)), None
    bits = np.zeros((256, 1 << 16), bool)
    bits[:, pairs] = others.T
    open_ = np.flatnonzero(others.any(axis=1))
    blob = lambda x: pa.array([r.tobytes() for r in x[open_]], pa.binary())
    mixture = grams.sparkSession.createDataFrame(pa.table({"pair": pairs[open_], "spent": blob(spent), "left": blob(left)}))
    return (depth_of, value, np.concatenate([logs, *rows]), head, np.packbits(bits.reshape(-1))), mixture


def held_out():
    """crc32 of the id as text, modulo 7, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def with_tail(rows: DataFrame, keys: str, values: DataFrame, *sums) -> DataFrame:
    """The rows with sums (0 where there is nothing) over their `keys`, joined with `values` by key; `times` is how often a key stands in a row."""
    # equal rows have equal keys, so a row is named by its id and its keys
    named = rows.withColumn("name", F.xxhash64(keys))
    tail = named.where(F.size(keys) > 0).select("doc_id", "name", keys).distinct()
    tail = tail.select("doc_id", "name", F.explode(keys).alias("key")).groupBy("key", "doc_id", "name").agg(F.count("*").alias("times"))
    tail = tail.join(values, "key", "left").groupBy("doc_id", "name").agg(*sums)
    added = [c for c in tail.columns if c not in ("doc_id", "name")]
    both = named.alias("r").join(tail.alias("t"), F.expr("r.doc_id <=> t.doc_id and r.name = t.name"), "left")
    return both.select(*[f"r.{c}" for c in rows.columns], *[F.coalesce(f"t.{c}", F.lit(0)).alias(c) for c in added])


def score(docs: DataFrame, head: int = HEAD, contexts: int = CONTEXTS) -> DataFrame:
    """Unigram and context-tree scores (log10), and the code length per byte in bits. head and contexts say how much is broadcast; they do not change the result."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = store(counts(docs.where(F.col("doc_id").isNotNull() & ~held_out())), "lm-counts")
    words, grams = counted.where("kind = 0").select("key", "n"), counted.where("kind = 1").select("key", "n")
    n_tokens, n_types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tree, mixture = model_of(grams, contexts)
    # the end token stands in every document, so its count does not depend on the head
    end_n = words.where(F.col("key") == END_TOKEN).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = most_frequent(words.where(F.col("key") != END_TOKEN), head).toArrow()
    order = np.argsort(top["key"].to_numpy())
    head_key, head_n = top["key"].to_numpy()[order], top["n"].to_numpy()[order]
    whole_head = len(head_key) + int(end_n > 0) == n_types
    shared = spark.sparkContext.broadcast((tree, head_key, head_n, end_n))
    scale = n_tokens + n_types + 1

    def run(batches):
        tree, keys, n, end_n = shared.value
        model = Model(*tree)
        for batch in batches:
            for lo, hi, buf, offs in T.documents(batch.column(1), CHUNK):
                own, first = word_keys(buf, offs)
                kinds, which = np.unique(own, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, kinds), max(0, len(keys) - 1))
                hit = keys[at] == kinds if len(keys) else np.zeros(len(kinds), bool)
                c = np.where(hit, n[at], 0) if len(keys) else np.zeros(len(kinds), np.int64)
                hit, c = hit[which], c[which]
                total = np.zeros(len(own) + 1)
                np.cumsum(np.where(hit, np.log10((c + 1) / scale), 0.0), out=total[1:])
                base = np.diff(total[first]) + np.log10((end_n + 1) / scale)
                known = T.per_document(hit, first) + int(end_n > 0)
                rest = own[~hit]
                rest_first = np.append(0, np.cumsum(~hit))[first]
                lists = pa.ListArray.from_arrays(pa.array(rest_first, pa.int32()), pa.array(rest))
                scores, grams, grams_first = model.score(buf, offs)
                gram_lists = pa.ListArray.from_arrays(pa.array(grams_first, pa.int32()), pa.array(grams))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(np.diff(first) + 1), pa.array(known), pa.array(base), pa.array(scores), pa.array(np.diff(offs) + 1), lists, gram_lists],
                    names=["doc_id", "n_tokens", "head_known", "head_score", "score", "n_bytes", "rest", "grams"],
                )

    rows = docs.mapInArrow(run, "doc_id long, n_tokens long, head_known long, head_score double, score double, n_bytes long, rest array<long>, grams array<long>")
    unknown = float(np.log10(1 / scale))
    if not whole_head or mixture is not None:
        rows = store(rows, "lm-rows")
    if whole_head:  # every counted word is in the head: the others are unknown
        rows = rows.select("*", F.lit(0).cast("long").alias("tail_known"), (F.size("rest") * F.lit(unknown)).alias("tail_score"))
    else:
        log = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(scale)))
        rows = with_tail(rows, "rest", words, F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"), F.sum(F.col("times") * log).alias("tail_score"))
    if mixture is None:  # every context of the training texts is in the table
        rows = rows.withColumn("tail_log", F.lit(0.0))
    else:
        wanted = rows.select(F.explode("grams").alias("key")).distinct()
        rows = with_tail(rows, "grams", joined_logs(grams, wanted, mixture), F.sum(F.col("times") * F.col("log")).alias("tail_log"))
    score = F.col("score") + F.col("tail_log")
    return rows.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("head_known") + F.col("tail_known")).alias("n_known"), F.lit(int(n_tokens)).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.col("tail_score")).alias("base_score"), score.alias("score"), (-score / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op8_context_tree_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
