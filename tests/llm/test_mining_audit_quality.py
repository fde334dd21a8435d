"""Operators 11 to 13 against brute force, exact arithmetic and held-out rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import hard_negatives as H, quality_svm as Q, queries as LQ, source_audit as S, textops as T

VECTORS = "vec_id long, embedding array<double>, label int"


# --- 11 -----------------------------------------------------------------------------------------------------------


def mined(rows, positives=5, negatives=10):
    """Brute force over (vec_id, embedding, label): one result for each anchor row."""
    ok = [(i, l, [math.floor(256 * x) for x in e]) for i, e, l in rows if i is not None and l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for at, (i, label, q) in enumerate(ok):
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, p)), j, l) for k, (j, l, p) in enumerate(ok) if k != at and len(p) == len(q)]
        for s, j, _ in sorted(x[:2] + (0,) for x in scored if x[2] == label)[:positives]:
            hard = sorted(x[:2] for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(hard[:negatives], 1)]
    return sorted(out)


def mine(spark, rows, schema=VECTORS, **how):
    q = H.quantised(spark.createDataFrame(rows, schema))
    return sorted(tuple(r) for r in H.mine(q, F.col("vec_id") % 100 == 0, **how).collect())


def vectors(n, seed, dim=6, step=0.25):
    rng = random.Random(seed)
    return [(i, [round(rng.uniform(-1, 1) / step) * step for _ in range(dim)], rng.randrange(3)) for i in range(n)]


def test_mining_is_brute_force_with_ties_and_a_group_of_copies(spark):
    rows = vectors(400, 1) + [(1000 + i, [0.5, 0.25, 0.0, -0.25, 0.5, 0.5], i % 2) for i in range(300)]
    assert mine(spark, rows) == mined(rows) != []


def test_mining_goes_digit_by_digit(spark, monkeypatch):
    monkeypatch.setattr(H, "DIGIT", 7)
    rows = vectors(150, 2, step=0.125) + [(5000 + i, [0.5] * 6, 1) for i in range(60)]
    assert mine(spark, rows, negatives=4) == mined(rows, negatives=4) != []


def test_mining_leaves_out_unsound_rows_and_takes_repeats_as_rows(spark):
    rows = vectors(120, 3)
    unsound = [(200, None, 1), (300, [1.0] * 6, None), (None, [1.0] * 6, 1), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (500, [float("nan")] + [1.0] * 5, 1), (600, [float("inf")] + [1.0] * 5, 1), (700, [], 1), (800, [1.0, 1.0], 1)]
    assert mine(spark, rows + unsound) == mined(rows + unsound)
    repeated = rows + rows[:5] + rows[:1]  # row 0 is an anchor: three times now
    assert mine(spark, repeated) == mined(repeated)


def test_mining_of_an_empty_table_and_clashing_columns(spark):
    assert mine(spark, []) == []
    extra = [(*r, r[0], 1.0, "x", 7) for r in vectors(120, 4)]
    assert mine(spark, extra, VECTORS + ", a long, score double, q string, n int") == mined([r[:3] for r in extra])


def test_scores_beyond_62_bits_are_refused(spark):
    with pytest.raises(ValueError, match="62 bits"):
        mine(spark, [(0, [1e9], 1), (1, [1.0], 1)])


# --- 12 -----------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string"


def audited(rows, min_docs, top):
    """Brute force over (text, lang, source), all in integers."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = []
    for text, lang, source in rows:
        words = "".join(c if c.isascii() is False or c.isalpha() else " " for c in (text or "").translate(low)).split(" ")
        docs.append((Counter(w for w in words if w), lang or "", source or ""))
    out = []
    for lang in {d[1] for d in docs}:
        seen, by = Counter(), defaultdict(Counter)
        for words, l, source in docs:
            if l == lang:
                seen.update(list(words))
                by[source].update(words)
        kept = [w for w in seen if seen[w] >= min_docs]
        whole = Counter({w: sum(c[w] for c in by.values()) for w in kept})
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in by.items()}, share(whole)
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in by.items():
            pairs = [(sum(far(p[s][w], p[t][w]) for w in kept), t) for t in by if t != s]
            terms = [(far(p[s][w], q[w]), w) for w in kept if c[w] > 0 and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


def audit(spark, rows, min_docs=3, top=4, schema=DOCS):
    return sorted(tuple(r) for r in S.audit(spark.createDataFrame(rows, schema), min_docs, top).collect())


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "Ünder", "delta-x", "eps9eps", "zeta", "été", "ÉTÉ", "omega", "𝒳y"]
    return [(i, " ".join(rng.choice(words[: 4 + rng.randrange(8)]) for _ in range(rng.randrange(12))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "é"])) for i in range(n)]


def test_audit_is_brute_force(spark):
    rows = corpus(150, 1)
    assert audit(spark, rows) == audited([r[1:] for r in rows], 3, 4)


def test_audit_of_nulls_empty_and_long_texts_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None), (1, "", "en", "a"), (1, "", "en", "a"), (2, "x y x " * 20_000, "en", "b"), (3, "x y", "en", "c"), (3, "x y", "en", "c"), (4, "1 2 3", "fr", "only")] + [(None, "Same same", "en", s) for s in "abc"]
    assert audit(spark, rows, 2, 3) == audited([r[1:] for r in rows], 2, 3)
    assert audit(spark, [], 2, 3) == []


def test_audit_ignores_other_columns(spark):
    rows = corpus(60, 2)
    extra = [(*r, "q", 1, "t", 5) for r in rows]
    assert audit(spark, extra, schema=DOCS + ", term string, g int, vector string, n int") == audited([r[1:] for r in rows], 3, 4)


# --- 13 -----------------------------------------------------------------------------------------------------------

LABELS = "doc_id long, quality int"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def texts(n, seed):
    rng = random.Random(seed)
    good = lambda: " ".join(rng.choice(["quiet", "river", "stone", "north", "light"]) for _ in range(12)) + "."
    bad = lambda: " ".join(rng.choice(["CLICK", "$$$", "buy!!", "now", "free"]) for _ in range(12))
    return [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(n)]


def test_registered_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = LQ.queries()["op13_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    tested = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert np.mean([r["predicted"] == r["quality"] for r in tested]) >= 0.97
    assert np.mean([r["predicted"] for r in tested if r["quality"] == 1]) >= 0.97


def test_classifier_learns_from_text_alone_and_defines_odd_rows(spark):
    rows = texts(200, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "quiet river"), (900, None), (901, ""), (902, "quiet river " * 50_000), (5, rows[5][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], LABELS)
    out = Q.classify(docs, labels).collect()
    assert len(out) == 205
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["predicted"] == y for i, _, y in rows if held(i))
    assert by[900]["score"] == by[901]["score"] and not by[None]["held_out"] and by[902]["predicted"] == 1
    assert len({r["score"] for r in out if r["doc_id"] == 5}) == 1
    clash = docs.selectExpr("doc_id", "text", "doc_id AS label", "text AS name", "1 AS f")
    assert {(r["doc_id"], r["score"]) for r in Q.classify(clash, labels.selectExpr("*", "1 AS text", "2 AS score")).collect()} == {(r["doc_id"], r["score"]) for r in out}
    flipped = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], LABELS)  # labels of held-out rows say nothing
    assert {(r["doc_id"], r["score"]) for r in Q.classify(docs, flipped).collect()} == {(r["doc_id"], r["score"]) for r in out}


def test_classifier_without_labels_and_of_an_empty_table(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], LABELS)
    assert [tuple(r) for r in Q.classify(docs, none).collect()] == [(1, held(1), 0.5, 0)]
    assert Q.classify(docs.limit(0), none).count() == 0
    one = Q.classify(spark.createDataFrame([(i, "a") for i in range(8)], "doc_id long, text string"), spark.createDataFrame([(i, 1) for i in range(8)], LABELS))
    assert {r["predicted"] for r in one.collect()} == {1}


def test_features_are_the_distinct_grams(spark):
    raw = [b"Of and&&& and&&&\nand", b"", b"x"]
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    index, bounds = Q.features(buf, offsets)
    # tokens Of, and, &&& (3 kinds), pairs Of-and, and-&&&, &&&-and, shapes of 4 windows of which all differ
    assert np.diff(bounds).tolist() == [3 + 3 + 4, 0, 1] and all(len(set(index[a:b])) == b - a for a, b in zip(bounds, bounds[1:]))
    alone = [Q.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist() for t in raw]
    assert [index[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == alone


def test_ratios_are_zero_for_unseen_grams_and_follow_the_classes():
    r = Q.ratios(np.array([[0.0, 3.0, 0.0], [0.0, 0.0, 9.0]]), np.array([10.0, 30.0]))
    assert r[0] == pytest.approx(0) and r[1] < 0 < r[2]
    assert r[1] == pytest.approx(math.log(0.75 / 30.75) - math.log(3.25 / 10.25))


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    x, sign = rng.normal(size=(30, 4)), rng.choice([-1.0, 1.0], 30)
    cost = np.where(sign > 0, 0.7, 0.3)
    index, bounds = np.tile(np.arange(4), 30), np.arange(0, 121, 4)
    w, alpha = Q.descend(index, x.ravel(), bounds, sign, cost, 4, epochs=3000)
    assert ((alpha >= 0) & (alpha <= cost)).all() and w == pytest.approx((alpha * sign) @ x)
    primal = 0.5 * w @ w + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()
    assert primal - (alpha.sum() - 0.5 * w @ w) < 0.02 * primal  # duality gap


def test_logistic_is_monotone_and_calibrated():
    rng = np.random.default_rng(4)
    m = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * m + 0.5)))).astype(float)
    slope, offset = Q.logistic(m, y, np.ones(4000))
    assert slope == pytest.approx(2, abs=0.2) and offset == pytest.approx(0.5, abs=0.2)
    assert T.LOWER[65] == 97
