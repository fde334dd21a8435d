"""Substring dedup by seed and extend (operator 5).

A window is `WINDOW` consecutive words. Its seed (anchor) is the smallest hash
among its runs of `SEED` words, so equal windows have equal anchors, and
neighbouring windows mostly share theirs: a run is a row of windows with one
anchor, that is the anchor extended both ways.

1. Runs of equal content repeat as a whole: all but the first (smallest doc_id,
   then start) are removed. Each task already keeps only the first of a run among
   the last FLUSH runs, so a passage shared by any number of documents reaches the
   shuffle a few times a task, and a task's memory does not grow with its share.
2. Anchors that stand in runs of different content are where repeats end. Only
   for the first occurrence of such runs single windows are compared.
3. Repeated runs and windows that touch or overlap add up to maximal repeats.
   They are applied to the text after each is checked against its words.

The result is exact (up to 64-bit hashes of whole windows).

Defined results: null and empty texts have no words. Texts under WINDOW words
lose nothing. Rows with one doc_id count as one document when order is judged
(equal rows keep the same words), a null doc_id comes before all others. An empty
table gives an empty result. Other columns of the input are ignored (`dedup_text`
keeps them).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .workspace import store

WINDOW = 20
SEED = 8
#: Windows of one run at most.
MOST = 63
#: Runs of a task that are sorted together.
FLUSH = 1 << 18
NO_ID = -(1 << 63)


def prefix_sums(word_hash: np.ndarray) -> np.ndarray:
    total = np.zeros(len(word_hash) + 1, dtype=T.U64)
    np.cumsum(word_hash * T.powers("word", len(word_hash), inverse=True), out=total[1:])
    return total


def content(total: np.ndarray, start: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of `words` words from `start` (signed), the same wherever they stand."""
    h = (total[start + words] - total[start]) * T.powers("word", len(total))[start]
    return T.mix(h + words.astype(T.U64) * T.U64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def runs(buf: np.ndarray, offsets: np.ndarray):
    """Runs of a chunk: document (row), packed position, anchor, content.

    position = start * 128 + windows * 2 + (1 if an anchor may repeat inside).
    """
    starts, ends, first = T.words(buf, offsets)
    word = T.span_hashes(buf, starts, ends)
    at, doc = T.window_starts(first, WINDOW)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    seeds = T.window_hashes(word, SEED)
    width = WINDOW - SEED + 1
    least = seeds[at].copy()
    for k in range(1, width):
        np.minimum(least, seeds[at + k], out=least)
    hits = np.zeros(len(at), dtype=np.int8)
    for k in range(width):
        hits += seeds[at + k] == least
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    if (length > MOST).any():  # long runs (repetitive text) are cut
        parts = -(-length // MOST)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(begin, parts) + nth * MOST
        length = np.minimum(MOST, np.repeat(length, parts) - nth * MOST)
    again = np.logical_or.reduceat(hits > 1, begin) | (length > width)
    start = at[begin]
    own = doc[begin]
    position = ((start - first[own]) << 7) | (length << 1) | again
    return own, position, least[begin].view(np.int64), content(prefix_sums(word), start, length + WINDOW - 1)


def found_runs(docs: DataFrame, flush: int = FLUSH) -> DataFrame:
    """anchor, run (content), doc, position, repeated: whether an earlier run of the same content is among those sorted together."""
    names = ["anchor", "run", "doc", "position", "repeated"]

    def sorted_runs(waiting: list[tuple[np.ndarray, ...]]):
        anchor, run, doc, position = (np.concatenate(c) for c in zip(*waiting))
        order = np.lexsort((position, doc, run))
        anchor, run, doc, position = anchor[order], run[order], doc[order], position[order]
        repeated = np.zeros(len(run), dtype=bool)
        repeated[1:] = run[1:] == run[:-1]
        # equal rows (one doc_id twice) are not repeats of each other
        same = np.zeros(len(run), dtype=bool)
        same[1:] = repeated[1:] & (doc[1:] == doc[:-1]) & (position[1:] == position[:-1])
        anchor, run, doc, position, repeated = (x[~same] for x in (anchor, run, doc, position, repeated))
        for lo in range(0, len(run), 1 << 16):
            cut = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (anchor, run, doc, position, repeated)], names=names)

    def find(batches):
        waiting: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, buf, offs in T.documents(batch.column(1)):
                own, position, anchor, run = runs(buf, offs)
                waiting.append((anchor, run, ids[lo:hi][own], position))
                if sum(len(w[0]) for w in waiting) >= flush:
                    yield from sorted_runs(waiting)
                    waiting = []
        if waiting:
            yield from sorted_runs(waiting)

    return docs.select("doc", "text").mapInArrow(find, "anchor long, run long, doc long, position long, repeated boolean")


def windows_of(joined: DataFrame) -> DataFrame:
    """window, doc, position of all windows in the runs listed for each document."""

    def expand(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(2)
            for lo, hi, buf, offs in T.documents(batch.column(1)):
                own, position, run = _items(lists[lo:hi])
                starts, ends, first = T.words(buf, offs)
                total = prefix_sums(T.span_hashes(buf, starts, ends))
                own, start, length = _checked(total, first, own, position, None)  # any real window may be compared
                doc = np.repeat(own, length)
                at = np.repeat(start, length) + np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length)
                window = content(total, at, np.full(len(at), WINDOW))
                yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(ids[lo:hi][doc]), pa.array(((at - first[doc]) << 7) | 2)], names=["window", "doc", "position"])

    return joined.mapInArrow(expand, "window long, doc long, position long")


def _items(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and content hash of all list entries."""
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    flat = lists.flatten()
    return np.repeat(np.arange(len(sizes)), sizes), flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)


def _checked(total, first, own, position, run):
    """Entries that fit the text, and whose words are those of the run: row, first word in the chunk, windows."""
    start, length = first[own] + (position >> 7), (position >> 1) & MOST
    fits = start + length + WINDOW - 1 <= first[own + 1]
    own, start, length = own[fits], start[fits], length[fits]
    if run is None:
        return own, start, length
    run = run[fits]
    same = content(total, start, length + WINDOW - 1) == run
    return own[same], start[same], length[same]


def _by_document(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.col("doc").alias("own")).agg(F.collect_list(F.struct("position", "run")).alias("items"))


def _with_text(docs: DataFrame, entries: DataFrame, how: str) -> DataFrame:
    """Documents with the entries listed for them."""
    return docs.alias("d").join(_by_document(entries).alias("e"), F.expr("d.doc <=> e.own"), how)


def repeats(docs: DataFrame) -> DataFrame:
    """doc, position, run of everything that starts earlier elsewhere; docs has doc and text."""
    found = found_runs(docs)
    seen = F.array_sort(F.collect_list(F.struct("doc", "position"))).alias("seen")  # one entry for each flush at most
    by_run = found.where("not repeated").select("anchor", "run", "doc", "position").repartition("run").groupBy("run").agg(F.min("anchor").alias("anchor"), seen)
    by_run = store(by_run.select("run", "anchor", F.element_at("seen", 1).alias("first"), F.when(F.size("seen") > 1, F.slice("seen", F.lit(2), F.size("seen") - 1)).alias("others")), "runs")
    later = by_run.select("run", "first", F.explode("others").alias("s")).where("s <> first").select("s.doc", "s.position", "run")
    here = found.where("repeated").select("doc", "position", "run")
    firsts = by_run.select("anchor", "first.doc", "first.position")
    ends = firsts.groupBy("anchor").agg(F.count("*").alias("n"), F.max(F.col("position").bitwiseAND(F.lit(1))).alias("again")).where("n > 1 or again = 1").select("anchor")
    edges = store(firsts.join(ends, "anchor", "left_semi").select("doc", "position"), "run-ends")
    single = store(windows_of(_with_text(docs, edges.withColumn("run", F.lit(None).cast("long")), "inner").select("d.doc", "d.text", "e.items")), "windows")
    least = single.groupBy("window").agg(F.min(F.struct("doc", "position")).alias("first"), F.count("*").alias("n")).where("n > 1")
    inside = single.join(least, "window").where("struct(doc, position) <> first").select("doc", "position", F.col("window").alias("run"))
    return store(here.union(later).union(inside), "repeats")


def apply(docs: DataFrame, make, schema: str) -> DataFrame:
    """make(doc ids, raw chunk with kept bytes marked, ...) for every document with its repeats."""
    joined = _with_text(docs, repeats(docs), "left").select("d.doc", "d.text", "e.items", *[f"d.{c}" for c in docs.columns if c not in ("doc", "text")])

    def cut(batches):
        for batch in batches:
            for lo, hi, buf, offs in T.documents(batch.column(1)):
                starts, ends, first = T.words(buf, offs)
                covered = np.zeros(len(starts), dtype=bool)
                own, position, run = _items(batch.column(2)[lo:hi])
                if len(own):
                    total = prefix_sums(T.span_hashes(buf, starts, ends))
                    _, start, length = _checked(total, first, own, position, run)
                    step = np.zeros(len(starts) + 1, dtype=np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + length + WINDOW - 1, -1)
                    covered = np.cumsum(step[:-1]) > 0
                yield make(batch.slice(lo, hi - lo), buf, offs, starts, ends, first, covered)

    return joined.mapInArrow(cut, schema)


def kept_texts(buf, offsets, starts, ends, first, covered) -> list[bytes]:
    """The words that stay, joined by one space."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stay = np.flatnonzero(~covered)
    out = np.full(len(buf) + 1, 32, dtype=np.uint8)
    out[:-1] = np.where(T.SEPARATOR[buf], np.uint8(32), buf)
    # a kept word with a kept word after it in its document takes along the separator byte behind it
    more = np.zeros(len(stay), dtype=bool)
    more[:-1] = doc[stay[1:]] == doc[stay[:-1]]
    step = np.zeros(len(buf) + 2, dtype=np.int8)
    step[starts[stay]] += 1
    np.subtract.at(step, ends[stay] + more, 1)
    keep = np.cumsum(step[:-1]) > 0
    whole = out[keep].tobytes()
    cuts = np.append(0, np.cumsum(keep))[offsets]
    return [whole[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def make(batch, buf, offs, starts, ends, first, covered):
        shas = [hashlib.sha256(t).hexdigest() for t in kept_texts(buf, offs, starts, ends, first, covered)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(T.per_document(covered, first)), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = apply(_prepared(docs), make, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def dedup_text(docs: DataFrame) -> DataFrame:
    """The same columns; texts that lose words are what is kept, joined by one space, the others stay as they are."""
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    carried = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(others)]
    prepared = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"), *carried)
    names = ["doc", "text", *(f"c{i}" for i in range(len(others)))]

    def make(batch, buf, offs, starts, ends, first, covered):
        lost = T.per_document(covered, first)
        kept = kept_texts(buf, offs, starts, ends, first, covered)
        texts = [(new.decode() if n else old) for new, n, old in zip(kept, lost.tolist(), batch.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[3:]], names=names)

    schema = ", ".join(["doc long", "text string", *(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(others))])
    rows = apply(prepared, make, schema)
    back = {f.name: F.col(f"c{i}") for i, f in enumerate(others)} | {"doc_id": F.nullif("doc", F.lit(NO_ID)), "text": F.col("text")}
    return rows.select(*[back[c].alias(c) for c in docs.columns])


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
