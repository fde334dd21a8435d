"""Embedding near-dedup by NN-descent (operator 3).

Vectors of one label link when their cosine (double precision) is 0.98 or more.

1. Equal unit vectors are one node, with their number; copies are never compared.
2. First graph: every label is cut into blocks of bounded size by random
   hyperplanes (as many planes as the label needs), a few times over; inside a
   block each node finds its nearest ones.
3. NN-descent: a node's neighbours, both ways, meet at that node and are compared
   with each other; each keeps its best. A node meets again as long as its
   neighbours change; if there are more of them than one meeting holds, in several
   draws after the last change. The search ends when no list changes any more.
4. Every pair met at the threshold makes components, also where both lists are
   full: a block or meeting hands on a spanning forest of its links, which joins
   the same components as all of them.
5. Saturated nodes (lists full of links) see nothing beyond their own cluster.
   They are searched again for neighbours outside their component, with new
   hyperplanes, until that joins no more components.
6. Recall is audited against brute force for a bounded sample of nodes, each
   compared with all nodes of its label in blocks; while it is short, trees are added.
7. Links are counted by comparing components as a whole, block by block, of which
   only the number of links leaves a task, never the pairs.

Defined results: rows with a null label or vector, a zero vector, or components
that are null or not finite link with nothing. Vectors of different lengths are
compared with none of another length. Equal vec_ids are one vector for each
content. Repeated rows link as copies. An empty table gives an empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .graph import components
from .workspace import store

THRESHOLD = 0.98
NEIGHBOURS = 12
#: Nodes of a block are all compared with each other.
BLOCK = 256
TREES = 3
#: Neighbours of a node, both ways, that meet there in one round.
MEETING = 24
#: Nodes whose meetings one task call holds.
CALL = 256
#: Draws without a change after which a node with more neighbours than that is settled.
DRAWS = 3
AUDITED = 256
#: Share of the links of the audited nodes that must be found.
RECALL = 0.99


def unit_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, unit (binary of float64, null if the vector links with nothing), key of its content."""

    def convert(batches):
        for batch in batches:
            ids, lists, labels = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            units, keys = [], []
            for v, label in zip(lists, labels):
                x = v.as_py()
                if x is None or label is None or not len(x) or any(c is None for c in x):
                    units.append(None)
                    continue
                a = np.array(x, dtype=np.float64)
                top = np.abs(a).max()
                if not np.isfinite(a).all() or top == 0:
                    units.append(None)
                    continue
                a = a / top
                units.append((a / np.sqrt((a * a).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(units, pa.binary())], names=["vec_id", "label", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("long")).mapInArrow(convert, "vec_id long, label long, unit binary")
    # the group of vectors that may be compared: one label, one length
    return rows.withColumn("space", F.when(F.col("unit").isNotNull(), F.xxhash64("label", F.length("unit"))))


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what all links of a symmetric matrix join: each node and the one that named its component."""
    n = len(linked)
    name, up = np.arange(n), np.arange(n)
    while n:
        near = np.where(linked, name[None, :], n)
        first = near.argmin(axis=1)
        low = near[np.arange(n), first]
        better = low < name
        if not better.any():
            break
        name, up = np.where(better, low, name), np.where(better, first, up)
    at = np.flatnonzero(up != np.arange(n))
    return at, up[at]


def within(ids: np.ndarray, x: np.ndarray, k: int, group: np.ndarray | None = None):
    """Edges from each row of a block to its k nearest ones of other groups, and a spanning forest of its links."""
    n = len(ids)
    if n < 2:
        none = np.zeros(0)
        return none.astype(np.int64), none.astype(np.int64), none
    group = ids if group is None else group
    sim = x @ x.T
    sim[group[:, None] == group[None, :]] = -2.0
    take = min(k, n - 1)
    near = np.argpartition(-sim, take - 1, axis=1)[:, :take]
    mask = np.zeros((n, n), dtype=bool)
    mask[np.repeat(np.arange(n), take), near.ravel()] = True
    mask[forest(sim >= THRESHOLD)] = True
    i, j = np.nonzero(mask & (sim > -1.5))
    return ids[i], ids[j], sim[i, j]


def blocks(nodes: DataFrame, sizes: dict[int, int], tree: int) -> DataFrame:
    """space, block, node, unit, group: every space cut into about BLOCK nodes by the signs on random hyperplanes."""
    planes = {s: max(0, int(np.ceil(np.log2(max(1, n) / BLOCK))) + 1) for s, n in sizes.items() if n > BLOCK}

    def cut(batches):
        normals: dict[int, np.ndarray] = {}  # by length, drawn once a task
        for batch in batches:
            units, spaces = batch.column(2).to_pylist(), batch.column(0).to_pylist()
            codes = []
            for space, unit in zip(spaces, units):
                code, n = 0, planes.get(space, 0)
                if n:
                    x = np.frombuffer(unit, dtype=np.float64)
                    if len(x) not in normals:
                        normals[len(x)] = np.random.default_rng([tree, len(x)]).standard_normal((64, len(x)))
                    code = int(((normals[len(x)][:n] @ x) > 0) @ (1 << np.arange(n)))
                codes.append(code)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64()), batch.column(1), batch.column(2), batch.column(3)], names=["space", "block", "node", "unit", "group"])

    return nodes.select("space", "node", "unit", "group").mapInArrow(cut, "space long, block long, node long, unit binary, group long")


EDGE = "node long, other long, sim double"


def _edges(node, other, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(sim, pa.float64())], names=["node", "other", "sim"])


def first_graph(nodes: DataFrame, sizes: dict[int, int], k: int, first_tree: int = 0) -> DataFrame:
    """Edges inside the blocks of all trees; a block larger than planned is dealt into parts of bounded size."""
    out = None
    for tree in range(first_tree, first_tree + TREES):
        cut = blocks(nodes, sizes, tree)
        counted = cut.groupBy("space", "block").agg(F.count("*").alias("n"))
        parts = F.ceil(F.col("n") / (4 * BLOCK))
        cut = cut.join(counted, ["space", "block"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(tree)), parts))

        def compare(table: pa.Table) -> pa.Table:
            ids, x = table["node"].to_numpy(), matrix(table["unit"].combine_chunks())
            return pa.Table.from_batches([_edges(*within(ids, x, k, table["group"].to_numpy()))])

        edges = cut.select("space", "block", "part", "node", "unit", "group").groupBy("space", "block", "part").applyInArrow(compare, EDGE)
        out = edges if out is None else out.union(edges)
    return out


def keep_best(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k best neighbours; `born` is the round that first brought an entry."""
    nr = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "other"))
    once = edges.groupBy("node", "other").agg(F.max("sim").alias("sim"), F.min("born").alias("born"))
    return once.withColumn("nr", nr).where(F.col("nr") <= k).select("node", "other", "sim", "born")


def local_join(nodes: DataFrame, graph: DataFrame, total: int, nth: int, k: int) -> DataFrame:
    """Neighbours of every unsettled node, both ways, compared with each other: edges better than what either end
    has, and a spanning forest of the links between full lists."""
    both = graph.select("node", "other", "born").union(graph.select("other", "node", "born")).toDF("at", "node", "born").groupBy("at", "node").agg(F.max("born").alias("born"))
    at = Window.partitionBy("at")
    both = both.withColumn("latest", F.max("born").over(at)).withColumn("degree", F.count("*").over(at))
    # a meeting of all the neighbours a node has need not be held twice
    both = both.where((F.col("latest") >= nth - 1) | ((F.col("degree") > MEETING) & (F.col("latest") >= nth - DRAWS)))
    drawn = F.row_number().over(at.orderBy((F.col("born") < nth - 1).cast("int"), F.xxhash64("node", F.lit(nth)), "node"))
    both = both.withColumn("nr", drawn).where(F.col("nr") <= MEETING).select("at", "node")
    # a list with room takes any neighbour
    worst = graph.groupBy("node").agg(F.when(F.count("*") >= k, F.min("sim")).alias("worst"))
    info = nodes.join(worst, "node", "left").select("node", "unit", "group", F.coalesce("worst", F.lit(-1.5)).alias("worst"))
    calls = max(1, total // CALL)
    filled = both.join(info, "node").withColumn("call", F.pmod(F.xxhash64("at"), F.lit(calls)))

    def compare(table: pa.Table) -> pa.Table:
        at, ids, least, x = table["at"].to_numpy(), table["node"].to_numpy(), table["worst"].to_numpy(), table["unit"].combine_chunks().to_pylist()
        group = table["group"].to_numpy()
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1])) if len(at) else np.zeros(0, np.int64)
        out = []
        for own in np.split(order, cuts[1:]):
            v = np.frombuffer(b"".join([x[i] for i in own]), dtype=np.float64).reshape(len(own), -1)
            sim = v @ v.T
            sim[group[own][:, None] == group[own][None, :]] = -2.0
            mask = sim > least[own][:, None]
            mask[forest(sim >= THRESHOLD)] = True
            i, j = np.nonzero(mask)
            out.append((ids[own[i]], ids[own[j]], sim[i, j]))
        if not out:
            return pa.Table.from_batches([_edges([], [], [])])
        node, other, sim = (np.concatenate(c) for c in zip(*out))
        _, once = np.unique(np.stack([node, other]), axis=1, return_index=True)
        return pa.Table.from_batches([_edges(node[once], other[once], sim[once])])

    return filled.groupBy("call").applyInArrow(compare, EDGE)


def descend(nodes: DataFrame, sizes: dict[int, int], k: int = NEIGHBOURS, first_tree: int = 0, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The neighbour graph (node, other, sim), and links that join the components of all links met.

    Nodes of one `group` (by default each its own) are never compared. `start` is an earlier graph to go on from.
    """
    nodes = nodes if "group" in nodes.columns else nodes.withColumn("group", F.col("node"))
    first = store(first_graph(nodes, sizes, k, first_tree), "blocks")
    known = first.withColumn("born", F.lit(0))
    if start is not None:  # its entries have met before
        known = known.union(start.select("node", "other", "sim", F.lit(-1 - DRAWS).alias("born")))
    graph = store(keep_best(known, k), "graph")
    links = first.where(F.col("sim") >= THRESHOLD)
    total = sum(sizes.values())
    # a label of one block has been compared as a whole
    nth, quiet = 0, DRAWS if max(sizes.values()) <= BLOCK else 0
    while quiet < DRAWS:
        nth += 1
        met = store(local_join(nodes, graph, total, nth, k), "met")
        links = links.union(met.where(F.col("sim") >= THRESHOLD))
        graph = store(keep_best(graph.union(met.withColumn("born", F.lit(nth))), k), "graph")
        quiet = 0 if graph.where(F.col("born") == nth).limit(1).count() else quiet + 1
    return graph.select("node", "other", "sim"), store(links.groupBy("node", "other").agg(F.max("sim").alias("sim")), "links")


def saturated(graph: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Nodes whose lists are full of links."""
    return graph.groupBy("node").agg(F.count("*").alias("held"), F.min("sim").alias("worst")).where((F.col("held") >= k) & (F.col("worst") >= THRESHOLD)).select("node")


def joined(links: DataFrame) -> DataFrame:
    """node, component of all nodes with a link."""
    return store(components(links.select(F.col("node").alias("a"), F.col("other").alias("b"))), "components")


def connect(nodes: DataFrame, graph: DataFrame, links: DataFrame, first_tree: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """links with those between saturated nodes of different components, the components, and the next tree.

    An unsaturated node holds all its links; only a pair with two full lists can be missed by both.
    """
    full = store(nodes.join(saturated(graph), "node", "left_semi").select("space", "node", "unit"), "full")
    while True:
        comp = joined(links)
        grouped = full.join(comp.withColumnRenamed("component", "group"), "node")
        sizes = {r["space"]: r["n"] for r in grouped.groupBy("space").agg(F.count("*").alias("n"), F.min("group").alias("a"), F.max("group").alias("b")).where("a < b").collect()}
        if not sizes:
            return links, comp, first_tree
        apart = store(grouped.where(F.col("space").isin(list(sizes))), "apart")
        _, more = descend(apart, sizes, first_tree=first_tree)
        first_tree += TREES
        if not more.limit(1).count():
            return links, comp, first_tree
        links = links.union(more)


def enlarged(members: DataFrame) -> DataFrame:
    """node, near (copies of all nodes it links with) for every node of whole components.

    members: component, node, unit, copies. Parts of bounded size meet in pairs; a task returns counts only.
    """
    size = members.groupBy("component").agg(F.count("*").alias("m"))
    rows = members.join(size, "component").withColumn("parts", F.ceil(F.col("m") / (2 * BLOCK)).cast("int"))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("component", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "p", "node", "unit", "copies")

    def count(table: pa.Table) -> pa.Table:
        ids, part, copies, x = table["node"].to_numpy(), table["p"].to_numpy(), table["copies"].to_numpy(), matrix(table["unit"].combine_chunks())
        linked = x @ x.T >= THRESHOLD
        np.fill_diagonal(linked, False)
        if table["lo"][0].as_py() != table["hi"][0].as_py():
            linked &= part[:, None] != part[None, :]  # pairs inside a part are counted where it meets itself
        return pa.table({"node": ids, "near": linked @ copies})

    return rows.groupBy("component", "lo", "hi").applyInArrow(count, "node long, near long").groupBy("node").agg(F.sum("near").alias("near"))


def true_links(nodes: DataFrame, sample: int = AUDITED, seed: int = 7) -> DataFrame:
    """node, other: all links of a bounded sample of nodes (brute force, in blocks)."""
    total = nodes.count()
    share = min(1 << 20, -(-sample * (1 << 20) // max(1, total)))
    drawn = nodes.where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 20)) < share).select("node", "space", "unit").limit(4 * sample).toArrow()
    spark = nodes.sparkSession
    queries = spark.sparkContext.broadcast({s: (drawn["node"].to_numpy()[at], matrix(drawn["unit"].combine_chunks().take(pa.array(at)))) for s in set(drawn["space"].to_pylist()) for at in [np.flatnonzero(drawn["space"].to_numpy() == s)]})

    def scan(batches):
        for batch in batches:
            spaces, ids = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for s in np.unique(spaces):
                if int(s) in queries.value:
                    q_ids, q = queries.value[int(s)]
                    at = np.flatnonzero(spaces == s)
                    sim = q @ matrix(batch.column(2).take(pa.array(at))).T
                    i, j = np.nonzero((sim >= THRESHOLD) & (q_ids[:, None] != ids[at][None, :]))
                    yield _edges(q_ids[i], ids[at][j], sim[i, j])

    return nodes.select("node", "space", "unit").mapInArrow(scan, EDGE).select("node", "other")


def audit(nodes: DataFrame, links: DataFrame, sample: int = AUDITED) -> tuple[int, int]:
    """Links of a bounded sample of nodes: how many were found, and how many there are."""
    true = true_links(nodes, sample)
    found = true.join(links.select("node", "other"), ["node", "other"], "left_semi")
    return found.count(), true.count()


def audit_components(nodes: DataFrame, comp: DataFrame, sample: int = AUDITED, seed: int = 7) -> tuple[int, int]:
    """Links of a bounded sample of nodes: how many lie inside a component, and how many there are."""
    name = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    true = true_links(nodes, sample, seed).join(name("node"), "node", "left").join(name("other"), "other", "left")
    found, every = true.agg(F.coalesce(F.sum((F.col("node_in") == F.col("other_in")).cast("long")), F.lit(0)), F.count("*")).first()
    return found, every


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = store(unit_rows(vectors), "units")
    good = rows.where("space is not null")
    nodes = store(good.groupBy("space", "unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("space", "unit")), "nodes")
    sizes = {r["space"]: r["n"] for r in nodes.groupBy("space").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    graph, links = descend(nodes, sizes)
    tree = TREES
    while True:
        links, comp, tree = connect(nodes, graph, links, tree)
        found, every = audit_components(nodes, comp, seed=tree)
        if found >= RECALL * every:
            break
        graph, more = descend(nodes, sizes, first_tree=tree, start=graph)
        links, tree = links.union(more), tree + TREES
    links = links.select("node", "other")
    links = store(links.union(links.select("other", "node")).distinct(), "links")
    # pairs are what their one link says; larger components are compared as a whole
    large = comp.groupBy("component").agg(F.count("*").alias("m")).where("m > 2").select("component")
    members = comp.join(large, "component", "left_semi").join(nodes.select("node", "unit", "copies"), "node")
    counted = store(enlarged(members), "enlarged")
    copies = nodes.select(F.col("node").alias("other"), "copies")
    listed = links.join(counted, "node", "left_anti").join(copies, "other").groupBy("node").agg(F.sum("copies").alias("near"))
    degree = listed.union(counted.select("node", "near"))
    named = nodes.join(degree, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("node", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.withColumn("node", F.xxhash64("space", "unit")).join(named, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("space is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
