"""Quality classifier (operator 13): naive Bayes support vectors (NBSVM).

Features are indicators of hashed n-grams: one and two tokens (runs of letters and runs of other
characters, in the case of the text), and three shapes of tokens (the case of a word or the other
characters, and whether the token was just repeated).

1. Class counts of all n-grams are taken over all labelled training documents; each task
   adds up its own documents, so a fixed number of buckets is shuffled, whatever the corpus.
2. r = log-count ratio of the classes. Smoothing is in proportion to class sizes, so an n-gram
   that was never seen has r = 0, whatever the share of the classes.
3. A linear hinge-loss model over r-scaled indicators, rows of length 1, is fitted by dual
   coordinate descent on a bounded sample (about `PER_CLASS` documents of each class, whole
   texts, equal texts once); the sampled labels are broadcast, and the sample's features reach the driver. Weights are then
   drawn half-way to their mean magnitude, as NBSVM has it: naive Bayes, unless the hinge is sure.
4. Margins become probabilities by a logistic curve fitted to margins of documents that
   the model had not seen (two folds of the sample), classes weighing as in the corpus.

Defined results: a null or empty text has no features; its score is that of margin 0. A
document with conflicting label rows counts once per row. Label rows with a null quality or
doc_id are never learned from; without rows of both classes every score is the share of
class 1 (0.5 without labels). Equal margins have equal scores. Repeated rows give repeated
results, a null doc_id is scored and not held out; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .language_id import held_out
from .workspace import broadcast_if_small

BUCKETS = 1 << 18
#: Bound of the sample that the hinge-loss model is fitted on: expected documents of each class.
PER_CLASS = 4000
SMOOTHING = 1.0
#: Bound of the dual variables (cost of a violated margin).
COST = 1.0
EPOCHS = 30
#: Share of the fitted weights; the rest is their mean magnitude.
BLEND = 0.5
THRESHOLD = 0.7

SHAPES = 3

_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[T.SEPARATOR] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each document (ascending within it), and each document's place in them."""
    n = len(offsets) - 1
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    kind = _KIND[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = edge[0] = edge[-1] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    token = kind[starts] > 0
    starts, ends = starts[token], ends[token]
    first = np.searchsorted(starts, offsets)
    one = T.span_hashes(buf, starts, ends)
    where, doc = T.window_starts(first, 2)
    two = T.window_hashes(one, 2)
    owner = np.repeat(np.arange(n), np.diff(first))
    # shapes: case of a word, or the other characters themselves; and whether the token stood one or two tokens before
    upper = (buf >= 65) & (buf <= 90)
    shape = np.where(kind[starts] == 2, one, (upper[starts].astype(T.U64) + upper[ends - 1] * T.U64(2) + T.U64(1)))
    for back in (1, 2):
        again = np.zeros(len(one), dtype=bool)
        again[back:] = (one[back:] == one[:-back]) & (owner[back:] == owner[:-back])
        shape = T.mix(shape * T.U64(2) + again)
    form, form_doc = T.window_starts(first, SHAPES)
    three = T.window_hashes(shape, SHAPES)
    bucket = lambda hashes: (hashes & T.U64(BUCKETS - 1)).astype(np.int64)
    key = np.unique(np.concatenate([owner * BUCKETS + bucket(one), doc * BUCKETS + bucket(two[where]), form_doc * BUCKETS + bucket(three[form])]))
    return key % BUCKETS, np.searchsorted(key, np.arange(n + 1) * BUCKETS)


def ratios(counts: np.ndarray, sizes: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log-count ratio of each bucket: counts and sizes by class (0, 1)."""
    share = sizes / sizes.sum()
    low, high = ((counts[c] + smoothing * share[c]) / (sizes[c] + smoothing * share[c]) for c in (0, 1))
    return np.log(high) - np.log(low)


def descend(index: np.ndarray, value: np.ndarray, bounds: np.ndarray, sign: np.ndarray, cost: np.ndarray, width: int, epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and dual variables of min |w|^2 / 2 + sum of cost * hinge(sign * w.x): one dual variable after another to its best value within 0 .. cost."""
    w, alpha = np.zeros(width), np.zeros(len(sign))
    norm = np.array([(value[a:b] ** 2).sum() for a, b in zip(bounds, bounds[1:])])
    rng, open_rows = np.random.default_rng(seed), np.flatnonzero(norm > 0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(open_rows):
            a, b = bounds[i], bounds[i + 1]
            own, x = index[a:b], value[a:b]
            gradient = sign[i] * (w[own] @ x) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0.0:
                w[own] += step * sign[i] * x
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost.max():
            break
    return w, alpha


def scaled(index: np.ndarray, bounds: np.ndarray, r: np.ndarray) -> np.ndarray:
    """r-scaled indicators, each document of length 1."""
    value = r[index]
    return value / np.repeat(np.maximum(np.sqrt(_sums(value * value, bounds)), 1e-12), np.diff(bounds))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each document's values, the same to the last bit wherever the document stands."""
    n = len(bounds) - 1
    return np.bincount(np.repeat(np.arange(n), np.diff(bounds)), weights=values, minlength=n)


def blended(w: np.ndarray, blend: float = BLEND) -> np.ndarray:
    """Weights of r-scaled features between their mean magnitude (plain naive Bayes) and the fitted ones."""
    used = np.abs(w[w != 0])
    return (1 - blend) * (used.mean() if len(used) else 0.0) + blend * w


def logistic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (0 at least) and offset of P(label 1) by margin: Newton's method on the weighted likelihood, targets drawn in by one case."""
    up, down = (weight * label).sum(), (weight * (1 - label)).sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    beta = np.array([1.0, np.log(up + 1) - np.log(down + 1)])
    for _ in range(rounds):
        p = 0.5 * (1 + np.tanh(0.5 * (x @ beta)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * beta * [1, 0]
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        beta = beta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def fit(index: np.ndarray, bounds: np.ndarray, label: np.ndarray, r: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights by bucket (r included), slope and offset."""
    value = scaled(index, bounds, r)
    columns, place = np.unique(index, return_inverse=True)
    sign = np.where(label > 0, 1.0, -1.0)
    drawn = np.bincount(label, minlength=2)
    cost = COST * len(label) / (2.0 * np.maximum(1, drawn))[label]  # classes weigh the same

    def model(rows: np.ndarray) -> np.ndarray:
        pick = np.repeat(rows, np.diff(bounds))
        own = np.append(0, np.cumsum(np.diff(bounds)[rows]))
        return blended(descend(place[pick], value[pick], own, sign[rows], cost[rows], len(columns))[0])

    fold = np.arange(len(label)) % 2 == 0
    margin = np.zeros(len(label))
    for part in (fold, ~fold):
        unseen = _sums(model(~part)[place] * value, bounds)
        margin[part] = unseen[part]
    weight = (sizes / sizes.sum() / np.maximum(1, drawn))[label] * len(label)
    slope, offset = logistic(margin, label.astype(float), weight)
    full = np.zeros(BUCKETS)
    full[columns] = model(np.ones(len(label), bool))
    return full, slope, offset


def _lists(batches):
    """Text and label to the name of the text, its features and the label."""
    for batch in batches:
        for lo, hi, buf, offs in T.documents(batch.column(0)):
            index, bounds = features(buf, offs)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(index, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(T.span_hashes(buf, offs[:-1], offs[1:]).view(np.int64)), lists, batch.column(1)[lo:hi]], names=["name", "f", "label"])


def _class_counts(batches):
    """Documents of each class that hold a bucket, and (bucket -1) all documents of each class."""
    total = np.zeros((2, BUCKETS + 1), dtype=np.int64)
    for batch in batches:
        label = batch.column(1).to_numpy()
        for lo, hi, buf, offs in T.documents(batch.column(0)):
            index, bounds = features(buf, offs)
            own = label[lo:hi]
            total += np.bincount(np.repeat(own, np.diff(bounds)) * (BUCKETS + 1) + index + 1, minlength=total.size).reshape(total.shape)
            total[:, 0] += np.bincount(own, minlength=2)
    at = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at - 1), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "n0", "n1"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray, float, float]:
    """r, weights, slope and offset, from the documents that have label rows (doc_id, quality)."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long"), (F.col("quality").cast("int") != 0).cast("int").alias("label"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = rows.join(broadcast_if_small(known), "doc_id").select("text", "label").mapInArrow(_class_counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    counts = np.zeros((2, BUCKETS + 1))
    for c in (0, 1):
        counts[c, counted["bucket"].to_numpy() + 1] = counted[f"n{c}"].to_numpy()
    sizes = counts[:, 0]
    if not sizes.all():
        share = min(1 - 1e-6, max(1e-6, sizes[1] / sizes.sum())) if sizes.any() else 0.5
        return np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, float(np.log(share / (1 - share)))
    r = ratios(counts[:, 1:], sizes)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = [min(1 << 20, -(-per_class * (1 << 20) // int(n))) for n in sizes]
    sample = known.where(draw < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    table = rows.join(F.broadcast(sample), "doc_id").select("text", "label").mapInArrow(_lists, "name long, f array<int>, label int").toArrow()
    # equal texts once, in the order of their hash: the result does not hang on how rows are dealt
    once = np.unique(np.stack([table["name"].to_numpy(), table["label"].to_numpy().astype(np.int64)]), axis=1, return_index=True)[1]
    table = table.take(pa.array(once))
    lists = table["f"].combine_chunks()
    bounds = np.append(0, np.cumsum(lists.value_lengths().to_numpy())).astype(np.int64)
    return r, *fit(lists.flatten().to_numpy().astype(np.int64), bounds, table["label"].to_numpy().astype(np.int64), r, sizes)


def score(docs: DataFrame, r: np.ndarray, w: np.ndarray, slope: float, offset: float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (probability of class 1) and predicted."""
    model = docs.sparkSession.sparkContext.broadcast((r, w))

    def predict(batches):
        r, w = model.value
        for batch in batches:
            for lo, hi, buf, offs in T.documents(batch.column(1)):
                index, bounds = features(buf, offs)
                margin = _sums(w[index] * scaled(index, bounds, r), bounds)
                p = 0.5 * (1 + np.tanh(0.5 * (slope * margin + offset)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(predict, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Learn from the labelled rows that are not held out, then score every row."""
    model = train(docs.where(~held_out()), labels, per_class)
    return score(docs, *model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op13_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
