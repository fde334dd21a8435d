"""Source divergence audit (operator 12) on deduplicated count columns.

How far do the term distributions of a language's sources lie apart? Every (lang, source)
group and every lang gives each kept term a share p in integers (parts of 10**9, two added
to each count); two shares differ by f = (p - q)**2 // (p + q).

1. Terms are counted once, by (lang, source) group: the number of occurrences and of documents.
2. A kept term is its sparse vector of counts by source. Terms with the same vector are one
   column, with their number; all further work is done once a distinct vector.
3. A pair of sources differs by the sum over all columns. Only pairs of sources that both
   have a count in a column are made from it; a column in which one of the two is empty
   depends on the other's count alone, so it is evaluated once a distinct count, and one in
   which both are empty once a pair: with g(c, d) = f of the shares of counts c and d,
   sum = V g(0, 0) + sum over columns with c > 0 of g(c, 0) - g(0, 0), the same for d, and
   over columns with both g(c, d) - g(c, 0) - g(0, d) + g(0, 0). Integers, so the sum is exact.
4. Original terms are ranked last: of the terms of one column, only the first ones in the
   order of their bytes can reach the ranks asked for.

Native: DataFrame functions only. Counts are pre-aggregated before each shuffle; a vector has
an entry for each source at most, as has each group of the result.

Defined results: null text, lang and source are ''. A language without kept terms has pairs
of value 0; one with a single source has no pairs. Repeated rows, and rows without a doc_id,
are documents of their own. Equal values are ranked in the order of the item's bytes. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .workspace import broadcast_if_small, store

MIN_DOCS = 10
TOP_TERMS = 10
#: What stands between terms: terms are the runs of letters A-Z, a-z and of all characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _named(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), *more)


def counted(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """g (the group's number in `groups`), term, n (occurrences), docs (documents with the term)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A-Z only: lower() does just that to ASCII, at a fraction of the cost
    text = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    # cutting is linear in a text; regexp_extract_all copies it for every match
    terms = F.sort_array(F.split(text, BETWEEN))
    rows = _named(docs, terms.alias("t")).join(broadcast_if_small(groups), ["lang", "source"])
    # sorted, so a term is new to its document where its neighbour differs
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("t", 1, F.size("t") - 1))
    rows = rows.select("g", F.inline(F.arrays_zip(F.col("t").alias("term"), before.alias("before"))).alias("term", "before")).where("term <> ''")
    return rows.groupBy("g", "term").agg(F.count("*").alias("n"), F.sum((~F.col("term").eqNullSafe(F.col("before"))).cast("long")).alias("docs"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 (n + 2) / (N + 2V)) by long division in two steps, so that nothing leaves the range of long below 9 * 10**13 occurrences (beyond that ANSI mode raises)."""
    a, b = n + F.lit(2), total + F.lit(2) * kept
    high, rest = F.call_function("div", a * F.lit(10_000), b), (a * F.lit(10_000)) % b
    return F.lit(1) + high * F.lit(100_000) + F.call_function("div", rest * F.lit(100_000), b)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    groups = store(_named(docs).distinct().withColumn("g", F.monotonically_increasing_id()), "audit-names")
    counts = counted(docs, groups).join(broadcast_if_small(groups.select("g", "lang")), "g")
    vectors = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("g", "n"))).alias("vector")).where(F.col("docs") >= min_docs)
    terms = store(vectors.select("lang", "term", "vector"), "audit-terms")

    # a column: a distinct vector, the number of its terms, and those of them that can be ranked
    first = terms.withColumn("k", F.row_number().over(Window.partitionBy("lang", "vector").orderBy("term"))).where(F.col("k") <= top_terms)
    named = first.groupBy("lang", "vector").agg(F.collect_list("term").alias("terms"))
    columns = store(terms.groupBy("lang", "vector").agg(F.count("*").alias("m")).join(named, ["lang", "vector"]).withColumn("column", F.monotonically_increasing_id()), "audit-columns")

    entries = columns.select("column", "m", F.inline("vector"))
    zero = F.lit(0).cast("long")
    totals = entries.groupBy("g").agg(F.sum(F.col("m") * F.col("n")).alias("total"))
    kept = columns.groupBy("lang").agg(F.sum("m").alias("kept"), F.sum(F.col("m") * F.aggregate("vector", zero, lambda s, x: s + x["n"])).alias("whole"))
    groups = groups.join(totals, "g", "left").join(kept, "lang", "left").select("g", "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("kept", zero).alias("kept"), "whole")
    groups = store(groups.withColumn("none", F.when(F.col("kept") > 0, _share(zero, F.col("total"), F.col("kept")))), "audit-groups")

    # pairs of groups, each once
    right = groups.select("lang", F.col("g").alias("b"), F.col("none").alias("b0"))
    base = groups.select("lang", F.col("g").alias("a"), F.col("none").alias("a0"), "kept").join(right, "lang").where("a < b").select("a", "b", F.coalesce(F.col("kept") * _apart(F.col("a0"), F.col("b0")), zero).alias("value"))

    share = _share(F.col("n"), F.col("total"), F.col("kept"))
    alone = entries.groupBy("g", "n").agg(F.sum("m").alias("m")).join(groups, "g").select("lang", "g", "m", "none", share.alias("p"))
    other = groups.select("lang", F.col("g").alias("other"), F.col("none").alias("q"))
    gain = F.col("m") * (_apart(F.col("p"), F.col("q")) - _apart(F.col("none"), F.col("q")))
    alone = alone.join(other, "lang").where("g <> other").select(F.least("g", "other").alias("a"), F.greatest("g", "other").alias("b"), gain.alias("value"))

    # shares of a column's groups are worked out once, then its pairs
    shared = columns.where(F.size("vector") > 1).select("column", "m", F.inline("vector")).join(groups.select("g", "total", "kept", "none"), "g")
    shared = shared.groupBy("column", "m").agg(F.sort_array(F.collect_list(F.struct("g", share.alias("p"), F.col("none").alias("p0")))).alias("v"))
    ends = shared.select("m", "v", F.posexplode("v").alias("at", "x")).select("m", "x", F.explode(F.slice("v", F.col("at") + 2, F.size("v"))).alias("y"))
    extra = _apart(F.col("x.p"), F.col("y.p")) - _apart(F.col("x.p"), F.col("y.p0")) - _apart(F.col("x.p0"), F.col("y.p")) + _apart(F.col("x.p0"), F.col("y.p0"))
    both = ends.select(F.col("x.g").alias("a"), F.col("y.g").alias("b"), (F.col("m") * extra).alias("value"))

    pairs = store(base.union(alone).union(both).groupBy("a", "b").agg(F.sum("value").alias("value")), "audit-pairs")
    pairs = pairs.union(pairs.select("b", "a", "value")).toDF("g", "h", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    names = groups.select("g", "lang", "source")
    pairs = pairs.join(names, "g").join(groups.select(F.col("g").alias("h"), F.col("source").alias("item")), "h")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    q = _share(F.aggregate("vector", zero, lambda s, x: s + x["n"]), F.col("whole"), F.col("kept"))
    over = columns.join(kept, "lang").select("terms", q.alias("q"), F.inline("vector")).join(groups.select("g", "lang", "source", "total", "kept"), "g")
    over = over.select("lang", "source", "terms", share.alias("p"), "q").where("p > q").select("lang", "source", F.explode("terms").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    over = over.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top_terms)
    return pairs.union(over)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
