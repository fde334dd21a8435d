"""Language identification (operator 4): multinomial naive Bayes over hashed character n-grams.

Training counts come from a bounded sample of labelled rows (`per_language`
documents of each language, chosen by a hash of doc_id; whole texts). The
log-probability matrix has languages x buckets entries, so its broadcast has a
fixed size per language. Batches are scored in numpy as sparse rows.

Defined results: a null text, or one without a letter, is `und` with score 0.
Ties go to the first language in sorted order. Rows with a null lang or doc_id
are never learned from. With no training rows every document is `und`. Repeated
rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T

N_SIZES = (1, 2, 3)
BUCKETS = 1 << 15
#: Bound of the training sample: expected documents per language.
PER_LANGUAGE = 3000
SMOOTHING = 0.5
#: n-grams beyond this number add no more certainty to the score.
EVIDENCE = 60.0
UNDETERMINED = "und"

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point, whether it is a letter (made once per worker)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the document of each, and whether each document has a letter.

    Text is lower-cased; each run of other characters counts as one space.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(low)), [len(t) for t in low])
    is_letter = letters()[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] | (doc[1:] != doc[:-1])
    if len(keep):
        keep[0] = True
    codes, doc, is_letter = np.where(is_letter, codes, 32)[keep].astype(T.U64), doc[keep], is_letter[keep]
    buckets, owners = [], []
    for n in N_SIZES:
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        h = np.full(m, T.U64(n))
        some = np.zeros(m, dtype=bool)
        for k in range(n):
            h = h * T.U64(0x9E3779B97F4A7C15) + codes[k : k + m]
            some |= is_letter[k : k + m]
        ok = some & (doc[:m] == doc[n - 1 :])
        buckets.append((T.mix(h[ok]) & T.U64(BUCKETS - 1)).astype(np.int64))
        owners.append(doc[:m][ok])
    has = np.zeros(len(low), dtype=bool)
    has[doc[is_letter]] = True
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(buckets), np.concatenate(owners), has


def _texts(column: pa.Array, limit: int = T.CHUNK_BYTES // 4):
    for lo, hi, buf, offs in T.documents(column, limit):
        raw = buf.tobytes()
        yield lo, hi, [raw[a:b].decode("utf-8", "replace") for a, b in zip(offs, offs[1:])]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and the float32 matrix of log probabilities, languages x buckets."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1 << 20, -(-per_language * (1 << 20) // sizes[lang])))])
    sample = rows.where(draw < share[F.col("lang")])
    place = {lang: i for i, lang in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(place), BUCKETS), dtype=np.int64)
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for lo, hi, texts in _texts(batch.column(0)):
                bucket, doc, _ = features(texts)
                total += np.bincount(lang[lo:hi][doc] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    total = np.full((len(langs), BUCKETS), SMOOTHING)
    total[counted["i"].to_numpy(), counted["j"].to_numpy()] += counted["n"].to_numpy()
    return langs, np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32)


def predict_chunk(texts: list[str], langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text."""
    bucket, doc, has = features(texts)
    if not langs:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    n = np.bincount(doc, minlength=len(texts))
    logs = np.stack([np.bincount(doc, weights=row[bucket], minlength=len(texts)) for row in matrix], axis=1)
    scaled = (logs - logs.max(axis=1, keepdims=True)) * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
    p = np.where(has, 1.0 / np.exp(scaled).sum(axis=1), 0.0)
    return [langs[b] if ok else UNDETERMINED for b, ok in zip(logs.argmax(axis=1).tolist(), has.tolist())], p


def score(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score (posterior probability under at most EVIDENCE n-grams)."""
    model = docs.sparkSession.sparkContext.broadcast(matrix)

    def predict(batches):
        for batch in batches:
            for lo, hi, texts in _texts(batch.column(1)):
                names, p = predict_chunk(texts, langs, model.value)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(names, pa.string()), pa.array(p)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learn from the rows that are not held out, then predict every row."""
    langs, matrix = train(docs.where(~held_out()), per_language)
    return score(docs, langs, matrix).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: A document stays if a language is found with this probability at least.
MIN_SCORE = 0.4


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of docs, all columns, whose language is determined with `min_score` or more."""
    langs, matrix = train(docs.where(~held_out()), per_language)
    model = docs.sparkSession.sparkContext.broadcast(matrix)
    place = docs.columns.index("text")

    def choose(batches):
        for batch in batches:
            for lo, hi, texts in _texts(batch.column(place)):
                name, p = predict_chunk(texts, langs, model.value)
                known = np.array([x != UNDETERMINED for x in name], dtype=bool)
                yield batch.slice(lo, hi - lo).filter(pa.array(known & (p >= min_score)))

    return docs.mapInArrow(choose, docs.schema)
