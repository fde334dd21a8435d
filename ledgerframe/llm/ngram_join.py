"""N-gram Jaccard join (operator 7): documents whose 5-word shingle sets have Jaccard similarity >= 0.75.

T-occurrence search with DivideSkip. A document with n shingles links only with
documents that stand in T = ceil(0.75 n) of its n inverted lists, or more.

1. Equal sets are one class (a digest); copies are never compared.
2. The lists are divided. Lengths are counted over all documents; in the order of
   shingles long lists come last. Of a document's lists the last L = T - k (the
   longest ones) are set aside, the first n - T + k are merged: a partner stands in
   at least k of these, in its own order as well.
3. The merge is a sort of (list, document) entries over all machines; a list of one
   document ends there. Long lists are dealt over parts by their length.
4. Documents with fewer than k lists left are out. Pairs are probed in the lists set
   aside: every shingle of the smaller set is looked up by binary search in the
   other one. The link is decided on the exact overlap.
5. Documents are only paired with sizes they can link with. The larger the overlap
   needed is, the fewer lists (the rarest ones first) need be looked at.
6. Only components are asked for, so a document is first probed against the leader
   of most of its lists (one pair a document, twice). The leader is the document with
   the most shingles in long lists: of a group of near copies that is the one the
   others were made from, or the one with the fewest changes.
7. The merge by pairs is for lists whose documents are in different components then,
   and only across these. A pair meets in the first list that both stand in, which
   is among the first n - O + 1 of a document when the overlap needed is O: what is
   peculiar to a document that is unlike the others comes before their common lists.
   Documents of the list's own component (that of most of them) meet the others only.

Defined results: null and empty texts, and texts without words, have no shingles
and link with nothing. Texts of fewer than five words are one shingle. Equal
doc_ids are one document of each text; a null doc_id takes part like any other
but has no id to be named by. An empty table gives an empty result. Other columns
of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textops as T
from .graph import components
from .workspace import broadcast_if_small, most_frequent, store

WORDS = 5
#: Similarity as a ratio of whole numbers: 100 * intersection >= 75 * union.
PERCENT = 75
#: Lists of so many documents are long: their shingles are broadcast (the longest first, so many at most).
LONG = 16
LONG_SHINGLES = 1 << 18
#: The share of T that documents must reach together in the merged lists is one in so many (and one list more).
MERGED = 32
#: Entries of a list that meet in one place.
PART = 1024
#: Shingles counted together, and bytes of text cut into shingles together.
FLUSH = 1 << 19
CHUNK = 1 << 18
NO_ID = -(1 << 63)

def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (signed, ascending within a document), and each document's place in them."""
    low = T.LOWER[buf]
    starts, ends, first = T.words(low, offsets)
    word = T.span_hashes(low, starts, ends)
    at, doc = T.window_starts(first, WORDS)
    h = T.window_hashes(word, WORDS)[at] if len(at) else np.zeros(0, T.U64)
    counts = np.diff(first)
    few = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(few):
        total = np.array([T.window_hashes(word[first[d] : first[d + 1]], int(counts[d]))[0] + T.U64(counts[d]) for d in few], dtype=T.U64)
        h, doc = np.concatenate([h, T.mix(total)]), np.concatenate([doc, few])
    h = h.view(np.int64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(first)))


def digests(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Order-free 64-bit digest of each set."""
    total = np.zeros(len(h) + 1, dtype=T.U64)
    np.cumsum(T.mix(h.view(T.U64) + T.U64(0x51ED270B)), out=total[1:])
    return T.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(T.U64)).view(np.int64)


def first_of_each(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of a chunk, each once: shingles, their bounds, digests (empty sets left out)."""
    own = digests(h, bounds)
    full = np.flatnonzero(np.diff(bounds))
    rows = full[np.sort(np.unique(own[full], return_index=True)[1])]
    n = np.diff(bounds)[rows]
    ends = np.cumsum(n)
    at = np.repeat(bounds[rows] - (ends - n), n) + np.arange(int(n.sum()))
    return h[at], np.append(0, ends), own[rows]


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of every row."""

    def describe(batches):
        for batch in batches:
            for lo, hi, buf, offs in T.documents(batch.column(1), CHUNK):
                h, bounds = shingle_sets(buf, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(bounds)), pa.array(digests(h, bounds))], names=["doc_id", "n_shingles", "digest"])

    return docs.select("doc_id", "text").mapInArrow(describe, "doc_id long, n_shingles long, digest long")


def list_lengths(docs: DataFrame, total: int, least: int) -> DataFrame:
    """shingle, n of the lists of `least` documents or more, over all documents.

    Tasks count in flushes of bounded size and send sorted runs of shingles to range buckets of bounded size, so a
    shingle, however frequent, reaches its bucket once a flush.
    """
    bits = max(4, int(total // FLUSH).bit_length())

    def rows(keys: np.ndarray, times: np.ndarray | None) -> pa.RecordBatch:
        bucket = ((keys.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - bits)).astype(np.int64)
        begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.zeros(0, np.int64)
        cuts = np.append(begin, len(keys)).astype(np.int32)
        counts = pa.ListArray.from_arrays(pa.array(np.zeros_like(cuts) if times is None else cuts), pa.array([] if times is None else times, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys)), counts], names=["bucket", "keys", "times"])

    def flushed(waiting: list[np.ndarray]):
        keys, times = np.unique(np.concatenate(waiting), return_counts=True)
        yield rows(keys[times == 1], None)
        yield rows(keys[times > 1], times[times > 1])

    def send(batches):
        waiting: list[np.ndarray] = []
        for batch in batches:
            for _, _, buf, offs in T.documents(batch.column(0), CHUNK):
                waiting.append(first_of_each(*shingle_sets(buf, offs))[0])
                if sum(map(len, waiting)) >= FLUSH:
                    yield from flushed(waiting)
                    waiting = []
        if waiting:
            yield from flushed(waiting)

    def count(table: pa.Table) -> pa.Table:
        once = table.filter(pa.array(table["times"].combine_chunks().value_lengths().to_numpy() == 0))
        more = table.filter(pa.array(table["times"].combine_chunks().value_lengths().to_numpy() > 0))
        flat = lambda t, c: t[c].combine_chunks().flatten().to_numpy()
        keys, n = np.unique(np.concatenate([flat(once, "keys"), flat(more, "keys")]), return_inverse=True)
        n = np.bincount(n, weights=np.concatenate([np.ones(len(flat(once, "keys"))), flat(more, "times")]), minlength=len(keys)).astype(np.int64)
        return pa.table({"shingle": keys[n >= least], "n": n[n >= least]})

    sent = docs.select("text").mapInArrow(send, "bucket long, keys array<long>, times array<long>")
    return sent.groupBy("bucket").applyInArrow(count, "shingle long, n long")


def long_shingles(docs: DataFrame, total: int, most: int = LONG_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (ascending) of the longest lists and their lengths; only the order of shingles depends on them."""
    top = most_frequent(store(list_lengths(docs, total, LONG), "long"), most).toArrow()
    order = np.argsort(top["shingle"].to_numpy())
    return top["shingle"].to_numpy()[order], top["n"].to_numpy()[order]


def merge_threshold(n, merged: int):
    """k of a document with n shingles (an array or a column): one, and one more for every `merged` lists of its T."""
    if isinstance(n, Column):
        return F.floor(F.ceil(n * PERCENT / 100) / merged) + 1
    return (PERCENT * n + 99) // 100 // merged + 1


def merged_lists(docs: DataFrame, long_lists) -> DataFrame:
    """shingle, digest, n, pos (place in the document's order), central, lead, lead_n for the lists that are merged: the first n - T + k of every document.

    central is the number of a document's shingles in long lists; the leader of a list is the most central document.
    A list over PART documents is dealt over parts (salt), each with its own leader; salt is -1 for other lists.
    """
    kept = ["shingle", "salt", "digest", "n", "pos", "central"]

    def first(batches):
        long_key, long_n = long_lists.value
        for batch in batches:
            for _, _, buf, offs in T.documents(batch.column(0), CHUNK):
                h, bounds, own = first_of_each(*shingle_sets(buf, offs))
                if not len(h):
                    continue
                n = np.diff(bounds)
                doc = np.repeat(np.arange(len(n)), n)
                weight = np.zeros(len(h), np.int64)
                if len(long_key):
                    at = np.minimum(np.searchsorted(long_key, h), len(long_key) - 1)
                    weight = np.where(long_key[at] == h, long_n[at], 0)
                # short lists keep the order of their hashes, long ones follow by length
                long = np.flatnonzero(weight)
                short = np.flatnonzero(weight == 0)
                long = long[np.lexsort((h[long], weight[long], doc[long]))]
                order = np.concatenate([short, long])
                order = order[np.argsort(doc[order], kind="stable")]
                pos = np.arange(len(h)) - np.repeat(bounds[:-1], n) + 1
                central = np.bincount(doc[long], minlength=len(n))
                keep = pos <= (n - (PERCENT * n + 99) // 100 + merge_threshold(n, MERGED))[doc]
                h, weight, doc, pos = h[order][keep], weight[order][keep], doc[keep], pos[keep]
                parts = 1 << np.ceil(np.log2(np.maximum(1, weight / PART))).astype(np.int64)
                salt = np.where(parts > 1, own[doc] & (parts - 1), -1)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(salt, pa.int32()), pa.array(own[doc]), pa.array(n[doc], pa.int32()), pa.array(pos, pa.int32()), pa.array(central[doc], pa.int32())], names=kept)

    def runs(batches):
        held = [np.zeros(0, np.int64)] * len(kept)

        def lists(shingle, salt, digest, n, pos, central):
            if not len(shingle):
                return
            new = np.append(True, (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1]))
            once = new | np.append(True, digest[1:] != digest[:-1])
            shingle, salt, digest, n, pos, central, new = (x[once] for x in (shingle, salt, digest, n, pos, central, new))
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(new)))
            of = np.repeat(np.arange(len(size)), size)
            lead = np.lexsort((digest, central, of))[begin + size - 1][of]
            keep = (size > 1)[of] | (salt >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (shingle, digest, n, pos, central, digest[lead], n[lead])], names=["shingle", "digest", "n", "pos", "central", "lead", "lead_n"])

        for batch in batches:
            now = [np.concatenate([x, batch.column(c).to_numpy().astype(np.int64)]) for x, c in zip(held, kept)]
            # the last list may go on in the next batch
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) if len(now[0]) else np.zeros(0, bool)
            cut = int(same.argmax()) if len(same) else 0
            yield from lists(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
        yield from lists(*held)

    entries = docs.select("text").mapInArrow(first, "shingle long, salt int, digest long, n int, pos int, central int")
    dealt = entries.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "digest")
    return dealt.mapInArrow(runs, "shingle long, digest long, n long, pos long, central long, lead long, lead_n long")


def needed(n, m) -> Column:
    """Overlap that sets of n and m shingles link at: the least i with 100 i >= 75 (n + m - i)."""
    return F.ceil((F.col(n) + F.col(m)) * PERCENT / (100 + PERCENT))


def shared_at_least(n, m) -> Column:
    """How many merged lists a linked pair has in common at least.

    Common shingles that are not in the merged lists of both are in what one of them set aside.
    """
    aside = lambda x: F.ceil(F.col(x) * PERCENT / 100) - merge_threshold(F.col(x), MERGED)
    return F.greatest(F.lit(1), needed(n, m) - F.greatest(aside(n), aside(m)))


def reachable(lists: DataFrame) -> DataFrame:
    """The lists of documents that stand in k of them at least, as every linked pair does together; others are out.

    reach is the overlap if nobody had the merged shingles whose list is of one document. It is an estimate, not a bound, as
    a partner may have such a shingle among those that it set aside: leaders are chosen by it, no pair is left out for it.
    """
    merged = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + merge_threshold(F.col("n"), MERGED)
    held = F.count("*").over(Window.partitionBy("digest"))
    return lists.withColumn("held", held).where(F.col("held") >= merge_threshold(F.col("n"), MERGED)).withColumn("reach", F.col("n") - merged + F.col("held")).drop("held")


def probed(docs: DataFrame, named: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of digests whose whole sets link. named: digest and doc of one document of each class."""
    pairs = store(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    need = store(pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct().join(named.select("digest", "doc"), "digest"), "needed")

    def cut(batches):
        for batch in batches:
            want = batch.column(0).to_numpy()
            for lo, hi, buf, offs in T.documents(batch.column(1), CHUNK):
                h, bounds = shingle_sets(buf, offs)
                # rows that share a doc_id with another text do not have the digest asked for
                ok = np.flatnonzero(digests(h, bounds) == want[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(want[lo:hi][ok]), pa.array([h[bounds[i] : bounds[i + 1]].tobytes() for i in ok], pa.binary())], names=["digest", "shingles"])

    sets = store(docs.join(broadcast_if_small(need), "doc").select("digest", "text").mapInArrow(cut, "digest long, shingles binary"), "sets")
    few = broadcast_if_small(pairs)
    of_b = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("of_b")).join(few, "b")
    of_a = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("of_a")).join(broadcast_if_small(pairs.select("a").distinct()), "a", "left_semi")
    both = of_b.join(of_a, "a")

    def probe(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                short, large = sorted((np.frombuffer(v.as_buffer(), dtype=np.int64) for v in (x, y)), key=len)
                shared = int((large[np.minimum(np.searchsorted(large, short), len(large) - 1)] == short).sum())
                ok[i] = 100 * shared >= PERCENT * (len(short) + len(large) - shared)
            yield batch.select([0, 1]).filter(pa.array(ok))

    # a doc_id that stands twice brings its set twice
    return store(both.select("a", "b", "of_a", "of_b").mapInArrow(probe, "a long, b long").distinct(), "links")


def with_best_leader(entries: DataFrame) -> DataFrame:
    """Each document with the leader of most of its lists, if these are half of what a link needs. entries: digest, n, reach, lead, lead_n."""
    able = entries.where("digest <> lead").where(F.col("reach") >= needed("n", "lead_n"))
    votes = able.groupBy("digest", "lead").agg(F.count("*").alias("lists"), F.min(shared_at_least("n", "lead_n")).alias("least"))
    best = votes.where(F.col("lists") * 2 >= F.col("least")).groupBy("digest").agg(F.max(F.struct("lists", "lead")).alias("best"))
    return best.select(F.col("digest").alias("a"), F.col("best.lead").alias("b"))


def unsettled(lists: DataFrame, links: DataFrame) -> DataFrame:
    """shingle, digest, n, pos, central, reach, component of the lists whose documents are in several components.

    main is the component of most of a list's documents, others how many are not in it.
    """
    comp = components(links).withColumnRenamed("node", "digest")
    placed = lists.select("shingle", "digest", "n", "pos", "central", "reach").join(comp, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    shares = placed.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    several = shares.groupBy("shingle").agg(F.max(F.struct("size", "component")).alias("most"), F.sum("size").alias("all")).where("all > most.size")
    return store(placed.join(several.select("shingle", F.col("most.component").alias("main"), (F.col("all") - F.col("most.size")).alias("others")), "shingle"), "unsettled")


#: Classes of size: linked documents are at most STEPS classes apart (and one for rounding).
STEPS = 4
_RATIO = float((100 / PERCENT) ** (1 / STEPS))


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(_RATIO)))


def led_by_size(rest: DataFrame) -> DataFrame:
    """Entries with the most central document of their own class of size in the list, where that is in another component."""
    rest = rest.withColumn("own", size_class(F.col("n")))
    head = rest.groupBy("shingle", "own").agg(F.max(F.struct("central", "component", "digest", "n")).alias("head"))
    led = rest.join(head, ["shingle", "own"]).where("component <> head.component")
    return led.select("digest", "n", "reach", F.col("head.digest").alias("lead"), F.col("head.n").alias("lead_n"))


def across(rest: DataFrame) -> DataFrame:
    """Pairs of documents of different components that meet early enough in a list to reach the overlap that their sizes need.

    A pair of sizes n and m needs an overlap O. The first shingle that both have is followed by O - 1 more in each, so it
    is among the first n - O + 1 of the one and the first m - O + 1 of the other. Documents meet by (list, class of one,
    class of the other): for sizes like its own a document need only be listed under its rarest lists. Documents of a
    list's main component only meet the others; these are dealt over parts of bounded size.
    """
    n, pos, own = F.col("n"), F.col("pos"), size_class(F.col("n"))
    partner = F.explode(F.sequence(own - STEPS - 1, own + STEPS + 1)).alias("partner")
    least = F.greatest(F.floor(F.pow(F.lit(_RATIO), F.col("partner").cast("double"))), F.ceil(n * PERCENT / 100))
    overlap = F.ceil((n + least) * PERCENT / (100 + PERCENT))
    able = rest.withColumn("own", own).select("*", partner).where(pos <= n - overlap + 1)
    parts = F.ceil(F.col("others") / PART)
    other = F.col("component") != F.col("main")
    x = able.where(other).select("shingle", F.col("own").alias("c1"), F.col("partner").alias("c2"), F.pmod(F.xxhash64("digest"), parts).alias("part"), *[F.col(c).alias(f"{c}_a") for c in ("digest", "n", "pos", "component")])
    y = able.select("shingle", F.col("partner").alias("c1"), F.col("own").alias("c2"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), other.alias("other"), *[F.col(c).alias(f"{c}_b") for c in ("digest", "n", "pos", "component")])
    o = needed("n_a", "n_b")
    met = x.join(y, ["shingle", "c1", "c2", "part"]).where("(other AND component_a < component_b) OR (NOT other AND component_a <> component_b)")
    met = met.where(F.col("pos_a") <= F.col("n_a") - o + 1).where(F.col("pos_b") <= F.col("n_b") - o + 1)
    return met.select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b")).distinct()


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, digest) and links between digests (a, b) enough for all components."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"))
    rows = store(classes(docs), "classes")
    named = rows.where("n_shingles > 0").groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("doc"))
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    long_lists = docs.sparkSession.sparkContext.broadcast(long_shingles(docs, total))
    lists = store(reachable(merged_lists(docs, long_lists)), "lists")
    links = probed(docs, named, with_best_leader(lists))
    rest = unsettled(lists, links)
    if not rest.isEmpty():
        links = links.union(probed(docs, named, with_best_leader(led_by_size(rest))))
        rest = unsettled(rest, links)
    if not rest.isEmpty():
        links = links.union(probed(docs, named, across(rest)))
    return rows, links


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, links = link(docs)
    comp = components(links)
    named = rows.join(comp.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    smallest = named.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    alone = named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.where("n_shingles > 0").join(smallest, "component").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")).union(alone)


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
