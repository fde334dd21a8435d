"""Toxicity (operator 6): cumulative-link ordinal regression over sparse text features.

Severity has three ordered grades made from the labels: 0 fit for use, 1 not
toxic but of low quality, 2 toxic. P(grade > k) = sigmoid(w.x - t_k) with one weight
vector for all thresholds t_0 <= t_1; the output is the expected severity.
Features are the distinct lower-cased words of a text, hashed, and three marks of
its style: the step of its length, of its share of distinct words and of its share
of characters that are neither letters nor white space.

The model is fitted on a bounded sample of labelled rows (about `PER_GRADE` documents
of each grade, whole texts, equal texts once). A feature has a weight if its share
of documents differs significantly across one of the thresholds (a word: if it is
commoner above); weights start at the log-odds there. Every document is scored.

Defined results: a null or empty text has no words, severity is that of the
thresholds and its style. Documents with conflicting label rows count once per row.
Rows with a null toxic, quality or doc_id are never learned from; with no labels at
all severity is 0. Repeated rows give repeated results; an empty table an empty one;
other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T

BUCKETS = 1 << 18
#: Steps of each mark of style; the marks follow the word buckets.
STEPS = 16
WIDTH = BUCKETS + 3 * STEPS
#: Bound of the training sample: expected documents of each grade.
PER_GRADE = 6000
GRADES = 3
#: Features carry weight only if their share of documents above and below a threshold differs by so many standard
#: errors (root of the likelihood ratio, which holds for rare words too): labels are noisy, and other features would
#: only memorise that noise.
MIN_ERRORS = 5.0
RIDGE = 1e-5

#: Bytes of letters (ASCII after lower-casing, and all of UTF-8 beyond).
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[97:123] = True
_WORD_BYTE[128:] = True


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each document (ascending within it), and each document's place in them."""
    low = T.LOWER[buf]
    letter = _WORD_BYTE[low]
    low = np.where(letter, low, np.uint8(32))
    starts, ends, first = T.words(low, offsets)
    bucket = (T.span_hashes(low, starts, ends) & T.U64(BUCKETS - 1)).astype(np.int64)
    n, n_words = len(first) - 1, np.diff(first)
    key = np.unique(np.repeat(np.arange(n), n_words) * WIDTH + bucket)
    distinct = np.diff(np.searchsorted(key, np.arange(n + 1) * WIDTH))
    other = T.per_document(~letter & ~T.SEPARATOR[buf], offsets) / np.maximum(1, np.diff(offsets))
    marks = (np.log2(n_words + 1), distinct / np.maximum(1, n_words) * STEPS, np.sqrt(other) * STEPS)
    marks = [np.arange(n) * WIDTH + BUCKETS + k * STEPS + np.minimum(STEPS - 1, m.astype(np.int64)) for k, m in enumerate(marks)]
    key = np.sort(np.concatenate([key, *marks]))
    return key % WIDTH, np.searchsorted(key, np.arange(n + 1) * WIDTH)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _gain(above: np.ndarray, below: np.ndarray, n_above: float, n_below: float) -> np.ndarray:
    """Log-likelihood that two shares instead of one pooled share explain these counts with."""
    both = np.maximum(above + below, 1e-9) / (n_above + n_below)
    part = lambda x, n: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / (n * both)), 0.0)
    return part(above, n_above) + part(below, n_below)


def telling(index: np.ndarray, bounds: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features whose share of documents differs significantly across a threshold, and the log-odds at the one that they tell most."""
    owner = np.repeat(grade, np.diff(bounds))
    hits = np.stack([np.bincount(index[owner == g], minlength=WIDTH) for g in range(GRADES)]).astype(float)
    sizes = np.bincount(grade, minlength=GRADES).astype(float)
    best, odds = np.zeros(WIDTH), np.zeros(WIDTH)
    for k in range(1, GRADES):
        above, below, n_above, n_below = hits[k:].sum(axis=0), hits[:k].sum(axis=0), max(1.0, sizes[k:].sum()), max(1.0, sizes[:k].sum())
        z = np.sqrt(2 * np.maximum(0.0, _gain(above, below, n_above, n_below) + _gain(n_above - above, n_below - below, n_above, n_below)))
        own = np.log((above + 0.5) / (n_above + 1)) - np.log((below + 0.5) / (n_below + 1))
        best, odds = np.maximum(best, z), np.where(z > best, own, odds)
    # a word tells by its presence; that junk lacks the words of prose is left to the marks of style
    return (best >= MIN_ERRORS) & ((odds > 0) | (np.arange(WIDTH) >= BUCKETS)), odds


def cumulative(s: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 0 .. GRADES (1 and 0 at the ends)."""
    return np.concatenate([np.ones((len(s), 1)), sigmoid(s[:, None] - cuts), np.zeros((len(s), 1))], axis=1)


def log_likelihood(s: np.ndarray, cuts: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> float:
    """Weighted log-likelihood of the grades: differences of neighbouring cumulative probabilities."""
    p, rows = cumulative(s, cuts), np.arange(len(s))
    return float((weight * np.log(np.maximum(p[rows, grade] - p[rows, grade + 1], 1e-9))).sum())


def gradient(s: np.ndarray, cuts: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of -log_likelihood by s and by the thresholds."""
    p, rows = cumulative(s, cuts), np.arange(len(s))
    d = p * (1 - p)
    like = np.maximum(p[rows, grade] - p[rows, grade + 1], 1e-9)
    up, down = d[rows, grade] / like, d[rows, grade + 1] / like
    return weight * (down - up), np.array([(weight * (up * (grade == k + 1) - down * (grade == k))).sum() for k in range(GRADES - 1)])


def fit(index: np.ndarray, bounds: np.ndarray, grade: np.ndarray, rounds: int = 800, rate: float = 0.05, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by Adam on the cumulative-link likelihood, grades weighing the same; ridge pulls weights to their log-odds."""
    use, odds = telling(index, bounds, grade)
    owner = np.repeat(np.arange(len(grade)), np.diff(bounds))
    keep = use[index]
    columns, index = np.unique(index[keep], return_inverse=True)
    owner = owner[keep]
    bounds = np.searchsorted(owner, np.arange(len(grade) + 1))
    sizes = np.bincount(grade, minlength=GRADES)
    weight = 1.0 / (np.count_nonzero(sizes) * sizes[grade])
    prior = odds[columns]
    w, t = prior.copy(), np.array([0.0, np.log(4.0)])  # first threshold and log of the step to the next
    m, v = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    for i in range(1, rounds + 1):
        g_s, g_cut = gradient(sums(w[index], bounds), np.array([t[0], t[0] + np.exp(t[1])]), grade, weight)
        g = np.concatenate([np.bincount(index, weights=g_s[owner], minlength=len(w)) + ridge * (w - prior), [g_cut.sum(), g_cut[1] * np.exp(t[1])]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        w, t = w - step[:-2], t - step[-2:]
    full = np.zeros(WIDTH)
    full[columns] = w
    return full, np.array([t[0], t[0] + np.exp(t[1])])


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade of the label rows that can be learned from."""
    grade = F.when(F.col("toxic").cast("int") != 0, GRADES - 1).when(F.col("quality").cast("int") == 0, 1).otherwise(0)
    return labels.where("doc_id is not null and toxic is not null and quality is not null").select(F.col("doc_id").cast("long"), grade.alias("grade"))


def labelled(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE) -> DataFrame:
    """text and grade of the bounded sample; only the sampled labels are broadcast, so no text is shuffled."""
    rows = graded(labels)
    draw, share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), F.lit(0)
    for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect():
        share = F.when(F.col("grade") == r["grade"], F.lit(min(1 << 20, -(-per_grade * (1 << 20) // r["n"])))).otherwise(share)
    sample = rows.where(draw < share)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id").select("text", "grade")


def train(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds; the features of the bounded sample come to the driver, equal texts once."""

    def extract(batches):
        for batch in batches:
            for lo, hi, buf, offs in T.documents(batch.column(0)):
                index, bounds = features(buf, offs)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(index, pa.int32()))
                name = T.span_hashes(buf, offs[:-1], offs[1:]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), lists, batch.column(1)[lo:hi]], names=["name", "f", "grade"])

    table = labelled(docs, labels, per_grade).mapInArrow(extract, "name long, f array<int>, grade int").toArrow()
    once = np.unique(np.stack([table["name"].to_numpy(), table["grade"].to_numpy().astype(np.int64)]), axis=1, return_index=True)[1] if len(table) else []
    table = table.take(pa.array(once, pa.int64()))
    lists, grade = table["f"].combine_chunks(), table["grade"].to_numpy()
    if not len(grade):
        return np.zeros(WIDTH), np.full(GRADES - 1, np.inf)
    bounds = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
    return fit(lists.flatten().to_numpy().astype(np.int64), bounds.astype(np.int64), grade.astype(np.int64))


def score(docs: DataFrame, weights: np.ndarray, cuts: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """Expected severity, most likely grade, P(toxic) and the flag."""
    model = docs.sparkSession.sparkContext.broadcast((weights, cuts))

    def predict(batches):
        w, t = model.value
        for batch in batches:
            for lo, hi, buf, offs in T.documents(batch.column(1)):
                index, bounds = features(buf, offs)
                reach = cumulative(sums(w[index], bounds), t)
                above, p = reach[:, 1:-1], reach[:, :-1] - reach[:, 1:]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(above.sum(axis=1)), pa.array(p.argmax(axis=1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= threshold)], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(predict, "doc_id long, severity double, grade long, p_toxic double, toxic boolean")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, *train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
