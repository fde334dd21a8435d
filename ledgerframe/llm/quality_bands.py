"""Quality rules by compression bands (operator 10).

Ordinary prose compresses within a band that depends mostly on its length.
Text that compresses far better repeats itself; text that barely compresses is
noise. Each document is compressed with zstandard as a whole and in fixed
chunks; a ratio outside the band of its length rejects the document.

The bands are those of the corpus: for each length class (a quarter of an octave)
the median of the ratios of all documents that pass the base rules, and `FENCE`
times the distance to the quartile on either side. Equal lengths with equal ratios
count once, so that a group of copies does not make the band its own. Classes of
fewer than `MIN_VALUES` such ratios take the fixed, wide bands below.

Defined results: null or empty text has no words, fails the base rules
(fewer than 50 words) and has null ratios. Rows are judged one by one, so
repeated rows give repeated results and an empty table gives an empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from . import textops as T
from .workspace import store


@dataclass(frozen=True)
class Band:
    """Ratios (raw bytes / compressed bytes) accepted for texts of at least `min_bytes`."""

    min_bytes: int
    lowest: float
    highest: float


#: Whole documents: the longer the text, the more any prose compresses.
WHOLE_BANDS = (
    Band(0, 0.0, float("inf")),
    Band(256, 1.15, 5.0),
    Band(1024, 1.4, 7.0),
    Band(4096, 1.5, 9.0),
    Band(16384, 1.5, 12.0),
    Band(65536, 1.5, 16.0),
)
#: Fixed chunks; a last chunk shorter than half the size is judged with the one before it.
CHUNK_SIZE = 4096
CHUNK_BANDS = (Band(0, 0.0, float("inf")), Band(2048, 1.4, 12.0))
#: A document is rejected if more than this share of its chunks lies outside their band.
MAX_BAD_CHUNKS = 0.25
#: Classes of length to an octave, quartile distances from the median to the fence, and how many ratios a class needs.
CLASSES = 4
FENCE = 5.0
MIN_VALUES = 30
#: Least quartile distance, as a share of the median.
LEAST_SPREAD = 0.01

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, size long, ratio double, chunks array<struct<size:long,ratio:double>>"
_CHUNKS = pa.list_(pa.struct([("size", pa.int64()), ("ratio", pa.float64())]))

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def band_of(bands: tuple[Band, ...], size: int) -> Band:
    """The last band that the size reaches."""
    return [b for b in bands if size >= b.min_bytes][-1]


def chunk_edges(size: int, chunk: int) -> list[int]:
    edges = list(range(0, size, chunk)) + [size]
    if len(edges) > 2 and edges[-1] - edges[-2] < chunk // 2:
        del edges[-2]
    return edges


def dup_lines(raw: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = raw.split(b"\n")
    if len(lines) == 1 or len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip()]
    return len(lines) - len(set(lines))


def repeat_words(word_hash: np.ndarray, first_word: np.ndarray) -> np.ndarray:
    """Per document: words inside 3-word windows that its text holds twice or more."""
    at, doc = T.window_starts(first_word, 3)
    if not len(at):
        return np.zeros(len(first_word) - 1, np.int64)
    key = T.mix(T.window_hashes(word_hash, 3)[at] ^ T.mix(doc.astype(T.U64) + T.U64(1)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(at), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(word_hash), dtype=bool)
    for k in range(3):
        covered[at[again] + k] = True
    return T.per_document(covered, first_word)


def ratios(docs: DataFrame, chunk_size: int = CHUNK_SIZE, level: int = 3) -> DataFrame:
    """One row per document with its counts, its compression ratio and those of its chunks."""

    def measure(batches):
        packer = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)

        def ratio(raw: bytes) -> float:
            return len(raw) / len(packer.compress(raw))

        for batch in batches:
            for lo, hi, buf, offs in T.documents(batch.column(1)):
                starts, ends, first = T.words(buf, offs)
                n_words = np.diff(first)
                inside = ~T.SEPARATOR[buf] & ((buf & 0xC0) != 0x80)
                rep = repeat_words(T.span_hashes(buf, starts, ends), first)
                raw_all = buf.tobytes()
                dup, whole, chunks = [], [], []
                for i in range(hi - lo):
                    raw = raw_all[offs[i] : offs[i + 1]]
                    edges = chunk_edges(len(raw), chunk_size)
                    dup.append(dup_lines(raw))
                    whole.append(ratio(raw) if raw else None)
                    chunks.append([{"size": y - x, "ratio": whole[-1] if len(edges) == 2 else ratio(raw[x:y])} for x, y in zip(edges, edges[1:])] if raw else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi], pa.array(n_words), pa.array(T.per_document(inside, offs)), pa.array(T.per_document(_SYMBOL[buf], offs)), pa.array(dup, pa.int64()), pa.array(rep),
                        pa.array((n_words < 50) | (100 * rep > 50 * n_words)), pa.array(np.diff(offs)), pa.array(whole, pa.float64()), pa.array(chunks, _CHUNKS),
                    ],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "size", "ratio", "chunks"],
                )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(measure, SCHEMA)


def length_class(size: Column) -> Column:
    return F.floor(F.log2(size.cast("double")) * CLASSES).cast("int")


def limits(values: DataFrame, fence: float = FENCE) -> dict[int, tuple[float, float]]:
    """Lowest and highest ratio of each length class with enough values; one row a class reaches the driver. values: size, ratio."""
    once = values.distinct().groupBy(length_class(F.col("size")).alias("class")).agg(F.count("*").alias("n"), F.percentile_approx("ratio", [0.25, 0.5, 0.75], 10_000).alias("q"))
    out = {}
    for row in once.where(F.col("n") >= MIN_VALUES).collect():
        low, mid, high = row["q"]
        out[row["class"]] = (mid - fence * max(mid - low, LEAST_SPREAD * mid), mid + fence * max(high - mid, LEAST_SPREAD * mid))
    return out


def bounds(found: dict[int, tuple[float, float]], fixed: tuple[Band, ...], size: Column) -> tuple[Column, Column]:
    """Lowest and highest ratio for a size: of its class, or of the fixed band."""
    low, high = (F.lit(v) for v in (fixed[0].lowest, fixed[0].highest))
    for band in fixed[1:]:
        low, high = F.when(size >= band.min_bytes, band.lowest).otherwise(low), F.when(size >= band.min_bytes, band.highest).otherwise(high)
    if not found:
        return low, high
    pairs = [F.create_map(*[F.lit(x) for k, v in sorted(found.items()) for x in (k, float(v[i]))]) for i in (0, 1)]
    return F.coalesce(F.try_element_at(pairs[0], length_class(size)), low), F.coalesce(F.try_element_at(pairs[1], length_class(size)), high)


def quality(docs: DataFrame, whole: tuple[Band, ...] = WHOLE_BANDS, chunks: tuple[Band, ...] = CHUNK_BANDS, chunk_size: int = CHUNK_SIZE, max_bad: float = MAX_BAD_CHUNKS, fence: float = FENCE) -> DataFrame:
    """One row per document with its counts, its compression ratios and the verdict."""
    rows = store(ratios(docs, chunk_size), "ratios")
    passed = rows.where("not base_failed")
    of_whole = limits(passed.select("size", "ratio"), fence)
    of_chunks = limits(passed.select(F.explode("chunks").alias("c")).select("c.size", "c.ratio"), fence)
    low, high = bounds(of_whole, whole, F.col("size"))

    def outside(c: Column) -> Column:
        least, most = bounds(of_chunks, chunks, c["size"])
        return (c["ratio"] < least) | (c["ratio"] > most)

    bad = F.size(F.filter("chunks", outside)).cast("long")
    n = F.size("chunks").cast("long")
    band = F.when(F.col("ratio").isNull(), "none").when(F.col("ratio") > high, "repetitive").when(F.col("ratio") < low, "incompressible").when((n > 1) & (bad > max_bad * n), "chunks").otherwise("inside")
    out = rows.withColumn("band", band)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", F.array_min("chunks.ratio").alias("min_chunk_ratio"), F.array_max("chunks.ratio").alias("max_chunk_ratio"),
        bad.alias("bad_chunks"), n.alias("n_chunks"), "band", (~F.col("base_failed") & (F.col("band") == "inside")).alias("kept"),
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
