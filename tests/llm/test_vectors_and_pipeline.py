"""Embedding near-dedup, components and the pipeline against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import embed_dedup, graph


def union(n, edges):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 9), (10, 10)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union(200, edges)
    assert got == {i: want[i] for i in {x for e in edges for x in e if e[0] != e[1]}}


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16))
    near = np.concatenate([centres[:3].repeat(30, axis=0) + 0.01 * rng.standard_normal((90, 16)), centres[3:20].repeat(2, axis=0) + 0.02 * rng.standard_normal((34, 16)), centres[20:]])
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 7 == 0)) for i, v in enumerate(near)]
    n = len(rows)
    rows += [(n, rows[5][1], 0), (n + 1, rows[5][1], 0), (n + 2, [2 * x for x in rows[5][1]], 0), (n + 3, None, 0), (n + 4, [0.0] * 16, 0), (n + 5, [float("nan")] * 16, 0), (n + 6, [None] + [1.0] * 15, 0), (n + 7, rows[5][1], None), (n + 8, [1.0], 0), (n + 9, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("sim", F.lit("x"))
    unit = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, dtype=np.float32).astype(float)
            unit[i] = (label, a / np.linalg.norm(a))
    ids = list(unit)
    links = [(i, j) for k, i in enumerate(ids) for j in ids[:k] if unit[i][0] == unit[j][0] and len(unit[i][1]) == len(unit[j][1]) and unit[i][1] @ unit[j][1] >= 0.98]
    comp = union(n + 10, links)
    degree = np.bincount([x for e in links for x in e], minlength=n + 10)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(table).collect()}
    assert len(got) == n + 10 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert all(got[i]["n_links"] <= degree[i] for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * degree.sum()
    assert np.mean([got[i]["component_id"] == comp[i] for i in got]) >= 0.95


def test_audit_and_empty(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((100, 16))
    x = np.concatenate([base, base + 0.01 * rng.standard_normal((100, 16))])
    rows = embed_dedup.unit_rows(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int"))
    nodes = rows.select("space", "unit", F.col("vec_id").alias("node"))
    seen, seen_in_blocks = embed_dedup.descend(nodes, {rows.first()["space"]: len(x)})
    half = seen.where("sim >= 0.98").union(seen_in_blocks).select("node", "other")
    found, true = embed_dedup.audit(nodes, half.union(half.select("other", "node")).distinct())
    assert true >= 200 and found >= 0.9 * true
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.near_duplicates(none).count() == 0


def test_pipeline(spark):
    """Each stage is judged on its own input."""
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in C.STAGES]
    assert names == ["language_id", "ngram_jaccard_join", "substring_dedup", "pii_sanitisation", "best_fit_packing"]
    from tests_brute import dedup_words, kept_of_groups, sanitised

    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "language_id":
            assert len(after) >= 0.98 * len(before)
        elif name == "ngram_jaccard_join":
            assert set(after) == kept_of_groups({i: r["text"] for i, r in before.items()})
        elif name == "substring_dedup":
            assert {i: r["text"] for i, r in after.items()} == dedup_words({i: r["text"] for i, r in before.items()})
        else:
            assert {i: r["text"] for i, r in after.items()} == sanitised({i: r["text"] for i, r in before.items()})
        before = after
    packed = C.pack_sequences(spark, docs, sf).toPandas()
    assert set(packed.doc_id) == set(before) and packed.groupby("sequence_id").length.sum().max() <= 1024


def test_pipeline_run_is_its_stages(spark):
    """run() gives what the stages give one after another, with nulls, repeated rows and clashing columns in the table."""
    import os
    import tempfile

    import corpus_pipeline as C

    sf = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, "s", None), (None, "the and of " * 40, "en", "s", 440), (10**6 + 1, "", "en", "s", 0)], docs.schema)
    odd = docs.union(extra).union(docs.limit(3)).selectExpr("*", "'x' AS _kept", "1 AS digest", "'y' AS _text", "2 AS doc", "3 AS items", "4 AS component_id")
    odd.write.parquet(os.path.join(sf, "documents.parquet"))
    step = odd
    for _, stage in C.STAGES[:-1]:
        step = stage(spark, step, sf)
        rows = step.collect()
        assert step.columns == odd.columns and all((r["_kept"], r["digest"], r["_text"], r["doc"], r["items"], r["component_id"]) == ("x", 1, "y", 2, 3, 4) for r in rows)
        step = spark.createDataFrame(rows, odd.schema)
    key = lambda rows: sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(C.run(spark, sf).collect()) == key(C.pack_sequences(spark, step, sf).collect())
    for _, stage in C.STAGES:
        assert stage(spark, odd.where("false"), sf).count() == 0


def turned(rng, centre, cosine, n, noise):
    """n unit vectors about one that has the given cosine with centre."""
    side = rng.standard_normal(len(centre))
    side -= (side @ centre) * centre
    at = cosine * centre + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
    x = at + noise * rng.standard_normal((n, len(centre)))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_tight_clusters_of_full_lists_join(spark, monkeypatch):
    """Two clusters of 20, inside over 0.999, across 0.98 to 0.99, often in no common block: one component, all links."""
    monkeypatch.setattr(embed_dedup, "TREES", 1)
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    rng = np.random.default_rng(11)
    parts = [rng.standard_normal((500, 32))]
    for _ in range(16):
        centre = rng.standard_normal(32)
        centre /= np.linalg.norm(centre)
        parts += [turned(rng, centre, 1.0, 20, 0.001), turned(rng, centre, 0.985, 20, 0.001)]
    x = np.concatenate(parts)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.98
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(table).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == linked.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == union(len(x), np.argwhere(np.triu(linked)).tolist())


def test_short_recall_is_searched_again(spark, monkeypatch):
    """The first search finds nothing: the audit inside the query notices, and the result is whole all the same."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base + 0.01 * rng.standard_normal((60, 16))])
    search, calls = embed_dedup.descend, []

    def first_finds_nothing(*args, **options):
        graph, links = search(*args, **options)
        calls.append(1)
        return (graph, links) if len(calls) > 1 else (graph.where("sim < 0.98"), links.where("false"))

    monkeypatch.setattr(embed_dedup, "descend", first_finds_nothing)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["component_id"] for r in embed_dedup.near_duplicates(table).collect()}
    assert got == {i: i % 60 for i in range(120)}
