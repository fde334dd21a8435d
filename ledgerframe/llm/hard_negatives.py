"""Hard-negative mining (operator 11) by distributed radix selection.

For every anchor: its best `positives` rows of the same label, and for each of these the
best `negatives` rows of other labels whose score lies in a window that the positive's
score sets. Scores are exact integers (inner products of quantised vectors); higher ones
come first, ties by smaller vec_id.

Anchors are a stated query set, compared with all rows in cells of bounded size (a block
of rows, a block of anchors). No cell hands on its scores, and none is sorted as a whole:

1. Each task counts the values of its candidates by their leading digit, for every open
   window of an anchor, and hands on the leading buckets only, up to the k rows that are
   wanted (what a task holds below them cannot be among the first k anywhere).
2. Counts are added up over tasks; the bucket that holds the kth row is found by a running
   sum. If all of it qualifies, the window is closed; otherwise the next digit is counted,
   among the rows of this bucket alone.
3. When the digits of the score are used up, ties go on with the digits of vec_id, and
   rows that share both with those of their place in the table. So groups of equal vectors
   of any size cost one count a task and never meet in one place.
4. At last the rows up to the threshold are gathered: k of them for each window.

Defined results: rows with a null vec_id, label or vector, or with a component that is null
or not finite, take no part. Vectors of another length are not compared with an anchor. Rows
that share a vec_id are each a row: a repeated anchor gives its results once for each, and its
repeats are among its other rows. Anchors without a positive, and positives without a negative
in their window, give no row; an empty table an empty result. Other columns are ignored. Scores
of 2**62 and more (components of some millions) are refused with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .workspace import store

#: Bits of a digit. Buckets are counted sparsely, so a digit may be this wide.
DIGIT = 16
#: Bounds of a cell: vector components of its rows, and its anchors.
VALUES = 1 << 20
ANCHORS = 8192
#: Scores that a task holds at once.
HELD = 1 << 20


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, q (floor of `scale` times each component) of the rows that take part."""
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    return rows.where("vec_id is not null and label is not null and e is not null").where(sound).select("vec_id", "label", F.transform("e", lambda x: F.floor(x * F.lit(float(scale)))).alias("q"))


class _Cells:
    """The rows, stored once, and the anchors among them; what all passes share."""

    def __init__(self, rows: DataFrame, is_anchor: Column):
        rows = store(rows.select("vec_id", "label", "q", is_anchor.alias("anchor"), F.monotonically_increasing_id().alias("n")), "mining-rows")
        size = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        s = rows.agg(F.count("*").alias("rows"), F.sum(F.size("q")).alias("values"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.max(size).alias("most"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.max("n").alias("n")).first()
        self.most = (s["most"] or 0.0) * (1 + 1e-9) + 1
        if self.most >= 2.0**62:
            raise ValueError("the inner products of these vectors do not fit into 62 bits")
        cores = rows.sparkSession.sparkContext.defaultParallelism
        groups = max(-(-(s["values"] or 0) // VALUES), min(cores, -(-s["rows"] // 1024)), 1)
        blocks = max(1, -(-(s["anchors"] or 0) // ANCHORS))
        deal = lambda n, salt: F.pmod(F.xxhash64("n", F.lit(salt)), F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        self.rows = rows.select("vec_id", "label", "q", "n", F.size("q").alias("dim"), deal(groups, 1).alias("g"), each(blocks).alias("h"))
        self.anchors = rows.where("anchor").select(F.col("n").alias("a"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("asked"), F.col("q").alias("p"), F.size("q").alias("dim"), deal(blocks, 2).alias("h"))
        self.groups = groups
        #: most bits of score, vec_id and place, with sign
        self.bits = [max(int(x or 0).bit_length() for x in own) + 1 for own in ([self.most], [s["first"], s["last"]], [s["n"]])]

    def first_shift(self, phase: int) -> int:
        """A multiple of the digit, so that every later digit begins where its prefix ends."""
        return max(0, -(-(self.bits[phase] - DIGIT) // DIGIT) * DIGIT)

    def scan(self, state: DataFrame, same: bool, visit, schema: str) -> DataFrame:
        """visit(window, values of the phase, shift, rows of the candidates) for each anchor's windows in each cell; what it returns, in columns."""
        windows = state.groupBy("a").agg(F.collect_list(F.struct("w", "low", "high", "need", "phase", "shift", "prefix", "score", "id")).alias("windows"))
        queries = self.anchors.join(windows, "a").select("a", "asked", "p", "windows", "dim", "h", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))).alias("g"))
        exact_in_double = self.most < 2.0**53
        names = [part.split()[0] for part in schema.split(", ")]

        def cell(left, right):
            found: list[tuple] = []
            if left.num_rows and right.num_rows:
                left = left.take(pa.array(np.argsort(left["label"].to_numpy(), kind="stable")))
                vec, label, n, q = left["vec_id"].to_numpy(), left["label"].to_numpy(), left["n"].to_numpy(), _matrix(left["q"])
                anchor, asked, windows, p = right["a"].to_numpy(), right["asked"].to_numpy(), right["windows"].to_pylist(), _matrix(right["p"])
                if exact_in_double:
                    q, p = q.astype(np.float64), p.astype(np.float64)
                step = max(1, HELD // max(1, len(vec)))
                for at in range(0, len(p), step):
                    scores = (p[at : at + step] @ q.T).astype(np.int64)
                    for i, own in enumerate(scores, at):
                        lo, hi = np.searchsorted(label, asked[i], side="left"), np.searchsorted(label, asked[i], side="right")
                        if same:
                            pick = np.arange(lo, hi)
                            pick = pick[n[lo:hi] != anchor[i]]
                        else:
                            pick = np.concatenate([np.arange(lo), np.arange(hi, len(label))])
                        if len(pick):
                            own, ids, places = own[pick], vec[pick], n[pick]
                            for w in windows[i]:
                                found += visit(anchor[i], w, own, ids, places)
            columns = list(zip(*found)) if found else [[] for _ in names]
            return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(names, columns)})

        return self.rows.groupBy("dim", "g", "h").cogroup(queries.groupBy("dim", "g", "h")).applyInArrow(cell, schema)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy().reshape(len(lists), -1) if len(lists.flatten()) else np.zeros((len(lists), 0), np.int64)


def _candidates(w: dict, scores: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The values of the phase (ascending is better) of the rows that are still in question."""
    inside = (scores >= w["low"]) & (scores <= w["high"])
    if w["phase"] == 0:
        values = -scores[inside]
    else:
        inside &= scores == w["score"]
        if w["phase"] == 2:
            inside &= ids == w["id"]
        values = (ids if w["phase"] == 1 else places)[inside]
    return values if w["prefix"] is None else values[values >> (w["shift"] + DIGIT) == w["prefix"]]


def _count(a: int, w: dict, scores: np.ndarray, ids: np.ndarray, places: np.ndarray) -> list[tuple]:
    """Leading buckets of a window with their counts, as far as `need` rows reach."""
    values = _candidates(w, scores, ids, places) >> w["shift"]
    if len(values) > 4 * w["need"]:  # what lies beyond the need-th value is not looked at
        values = values[values <= np.partition(values, w["need"] - 1)[w["need"] - 1]]
    bucket, n = np.unique(values, return_counts=True)
    return [(a, w["w"], b, c) for b, c in zip(bucket.tolist(), n.tolist())]


def _gather(a: int, w: dict, scores: np.ndarray, ids: np.ndarray, places: np.ndarray) -> list[tuple]:
    """Rows of a closed window up to its threshold."""
    inside = (scores >= w["low"]) & (scores <= w["high"])
    reach = lambda x: (x >> w["shift"]) <= w["prefix"] if w["prefix"] is not None else np.ones(len(x), bool)
    if w["phase"] == 0:
        inside &= reach(-scores)
    elif w["phase"] == 1:
        inside &= (scores > w["score"]) | ((scores == w["score"]) & reach(ids))
    else:
        inside &= (scores > w["score"]) | ((scores == w["score"]) & ((ids < w["id"]) | ((ids == w["id"]) & reach(places))))
    at = np.flatnonzero(inside)
    return [(a, w["w"], s, i) for s, i in zip(scores[at].tolist(), ids[at].tolist())]


def best(cells: _Cells, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """a, w, score, vec_id, rank of the first k rows of each window (a, w, low, high): rows of the anchor's label, or of other ones."""
    none = F.lit(None).cast("long")
    opened = windows.select("a", "w", "low", "high", F.lit(k).alias("need"), F.lit(0).alias("phase"), F.lit(cells.first_shift(0)).alias("shift"), none.alias("prefix"), none.alias("score"), none.alias("id"))
    opened, closed = store(opened, "mining-windows"), []
    over = Window.partitionBy("a", "w").orderBy("bucket")
    while not opened.isEmpty():
        counted = cells.scan(opened, same, _count, "a long, w long, bucket long, n long").groupBy("a", "w", "bucket").agg(F.sum("n").alias("n"))
        run = counted.withColumn("before", F.sum("n").over(over) - F.col("n"))
        hit = opened.select("a", "w", "need").join(run, ["a", "w"]).where("before < need and before + n >= need").select("a", "w", "bucket", "before", "n")
        state = store(opened.join(hit, ["a", "w"], "left"), "mining-digits")
        whole = F.col("bucket").isNull() | (F.col("before") + F.col("n") == F.col("need"))
        # too few rows: everything from here on qualifies, which the widest shift says
        closed.append(state.where(whole).select("a", "w", "low", "high", "need", "phase", F.when(F.col("bucket").isNull(), 63).otherwise(F.col("shift")).alias("shift"), F.coalesce("bucket", F.lit(0)).alias("prefix"), "score", "id"))
        rest, used_up = state.where(~whole), F.col("shift") == 0
        # too few rows below a prefix cannot be: that bucket was chosen because it holds them
        opened = store(
            rest.select(
                "a", "w", "low", "high", (F.col("need") - F.col("before")).cast("int").alias("need"), (F.col("phase") + used_up.cast("int")).alias("phase"),
                F.when(~used_up, F.col("shift") - DIGIT).when(F.col("phase") == 0, cells.first_shift(1)).otherwise(cells.first_shift(2)).alias("shift"),
                F.when(~used_up, F.col("bucket")).alias("prefix"),
                F.when(used_up & (F.col("phase") == 0), -F.col("bucket")).otherwise(F.col("score")).alias("score"), F.when(used_up & (F.col("phase") == 1), F.col("bucket")).otherwise(F.col("id")).alias("id"),
            ),
            "mining-windows",
        )
    if not closed:
        return windows.sparkSession.createDataFrame([], "a long, w long, score long, vec_id long, rank int")
    settled = closed[0]
    for part in closed[1:]:
        settled = settled.union(part)
    rows = cells.scan(store(settled, "mining-closed"), same, _gather, "a long, w long, score long, vec_id long")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, q (array of long). A negative's score lies between share[0] and share[1] per cent of the positive's, both ends included.
    """
    cells = _Cells(rows, is_anchor)
    edge = F.lit(int(cells.most))
    everything = cells.anchors.select("a", F.lit(0).cast("long").alias("w"), (-edge).cast("long").alias("low"), edge.cast("long").alias("high"))
    near = store(best(cells, everything, positives, True).select("a", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "mining-positives")

    def part(percent: int, edge) -> Column:
        """Per cent of the positive's score, rounded inwards; hundreds and the rest apart, so that it is exact and stays a long."""
        return (percent * F.expr("positive_score div 100") + edge(percent * F.expr("positive_score % 100") / 100)).cast("long")

    windows = near.select("a", F.col("positive_score").alias("w")).distinct().withColumn("positive_score", F.col("w"))
    windows = windows.select("a", "w", part(share[0], F.ceil).alias("low"), part(share[1], F.floor).alias("high")).where("low <= high")
    hard = best(cells, windows, negatives, False).select("a", F.col("w").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(hard, ["a", "positive_score"]).join(cells.anchors.select("a", "anchor_id"), "a").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    rows = quantised(vectors).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 100 == 0)
