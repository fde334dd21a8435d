"""PII sanitisation by information content (operator 1), in DataFrame functions only.

Base findings: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone
numbers, by one pattern each, leftmost and without overlap within a kind.

The corpus says how strongly a term (a run of letters and digits, lower-cased) reveals
what is protected. Protected are the four kinds (that a document holds any e-mail
address, say) and every single entity (that it holds this address). With document
counts over the whole corpus, PMI(term; c) = log2 p(c | term) / p(c) is set against the
information IC(c) = -log2 p(c) that knowing c gives away. For a kind, a document counts
if the term stands anywhere in it; for an entity, if it stands within `CONTEXT` code
points of it. A term whose PMI / IC reaches `GENERALISE_AT` discloses c and is
generalised (replaced by the kind's name), from `REMOVE_AT` on it is removed; both only
in documents that hold c, where it would give the masked entity away.

Rare terms disclose most, so no number of documents is asked for. Instead the evidence,
n(term, c) * PMI bits, must exceed the log2 of the number of pairs judged by
`EVIDENCE_BITS`: then chance makes not one in 2 ** EVIDENCE_BITS corpora show it. Two
or three documents are enough for a term that occurs with one entity only.

Positions are code points, ends exclusive. They come from cutting the text at the
matches: the pieces between matches and the matches add up to the text.

Defined results: null text counts as empty (no spans; sanitised text stays null).
Repeated rows count as documents of their own and give repeated results, equal
doc_ids with different texts are kept apart, a null doc_id is a row like any other.
Actions that tie go to the stronger one, then the larger ratio, then the later kind
in the alphabet. An empty table gives an empty result. Other columns of the input are
ignored (`sanitise` keeps them, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .workspace import store

#: The patterns, written so that the engine never tries a start or a repetition twice: same matches, linear time.
#: A start inside a run is only tried right after a match.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that every text with a match passes.
HINTS = {
    "email": lambda text: text.contains("@"),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]"),
    "card": lambda text: text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda text: text.contains("+"),
}
TERM = r"([\p{L}\p{N}]++)"
#: Code points on either side of an entity whose terms occur with it.
CONTEXT = 120
#: Bits by which the evidence for a pair exceeds what the number of pairs explains.
EVIDENCE_BITS = 7
GENERALISE_AT = 0.7
REMOVE_AT = 0.9
BLOCK = 64

_SPAN = "array<struct<kind:string,start:long,stop:long>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x pass Luhn's check."""
    d = F.reverse(digits(x))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(d, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def valid(kind: str, x: Column) -> Column:
    """Whether a match counts."""
    n = F.length(digits(x))
    if kind == "ip":
        # leading zeros aside, at most three digits and at most 255
        plain = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(x, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.lpad(F.substring(plain(p), 1, 3), 3, "0").cast("int") <= 255))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(x)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def before(values: Column, join) -> Column:
    """For each entry, what the entries before it join to (from 0), by blocks so that long arrays stay cheap."""
    fold = lambda values, start: F.aggregate(values, start, lambda a, x: join(a, x))
    zero = F.lit(0).cast("long")
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    so_far = lambda bs: F.aggregate(bs, F.array(zero), lambda a, b: F.concat(a, F.array(fold(b, F.element_at(a, -1)))))
    inside = lambda b, start: F.transform(b, lambda x, i: fold(F.slice(b, F.lit(1), i), start))
    whole = lambda bs: F.flatten(F.zip_with(bs, F.slice(so_far(bs), F.lit(1), F.size(bs)), inside))
    return bound(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<long>")).otherwise(bound(blocks(v), whole)))


def offsets(sizes: Column) -> Column:
    return before(sizes, lambda a, x: a + x)


def locate(df: DataFrame, name: str, text: Column, pattern: str, when: Column, context: bool = False) -> DataFrame:
    """Column `name`: matches of a pattern with their places (and what stands around them), array of (match, start, context).

    Empty where `when` fails. In steps, so that each regular expression runs once for each row.
    """
    none = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(when, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).otherwise(none))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn("_o", offsets(F.zip_with(F.slice("_p", F.lit(1), F.size("_m")), "_m", lambda p, m: (F.length(p) + F.length(m)).cast("long"))))
    starts = F.zip_with("_o", F.slice("_p", F.lit(1), F.size("_m")), lambda o, p: o + F.length(p))
    # no column is read by place inside a function of elements: the optimiser would compute it anew for each of them
    hits = F.zip_with("_m", starts, lambda m, s: F.struct(m.alias("match"), s.alias("start")))
    if context:
        around = F.zip_with(F.slice("_p", F.lit(1), F.size("_m")), F.slice("_p", F.lit(2), F.size("_m")), lambda a, b: F.concat_ws(" ", nearby(a, F.right, "^"), nearby(b, F.left, "$")))
        hits = F.zip_with(hits, around, lambda h, c: F.struct(h["match"].alias("match"), h["start"].alias("start"), c.alias("context")))
    return df.withColumn(name, hits).drop("_m", "_p", "_o")


def nearby(piece: Column, side, edge: str) -> Column:
    """The end of a piece that is next to a match; a term that is cut in two there is left out."""
    partial = rf"^{TERM}" if edge == "^" else rf"{TERM}$"
    return F.when(F.length(piece) > CONTEXT, F.regexp_replace(side(piece, F.lit(CONTEXT)), partial, "")).otherwise(piece)


def span(kind: Column, hit: Column) -> Column:
    return F.struct(kind.alias("kind"), hit["start"].alias("start"), (hit["start"] + F.length(hit["match"])).alias("stop"))


def has(kind: str, spans: str = "_spans") -> Column:
    return F.exists(spans, lambda s: s["kind"] == kind)


def terms_of(text: Column) -> Column:
    """Distinct terms outside e-mail addresses."""
    rest = F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.transform(F.regexp_extract_all(rest, F.lit(TERM), 1), F.lower))


def entities_of(kind: str, hits: str) -> Column:
    """Protected entities: kind, a key of the match (case and separators do not tell entities apart), and the context."""

    def entity(hit):
        same = F.lower(hit["match"]) if kind == "email" else hit["match"] if kind == "ip" else digits(hit["match"])
        return F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), same).alias("key"), hit["context"].alias("context"))

    return F.transform(hits, entity)


def disclosing(pairs: DataFrame, documents: int, generalise_at: float, remove_at: float) -> DataFrame:
    """Those of (term, kind, key, n_both, n_term, n_entity) at or over the thresholds and sure enough, with ratio and action."""
    pairs = pairs.where(F.col("n_entity") < documents)
    pmi = F.log2((F.col("n_both") / F.col("n_term")) / (F.col("n_entity") / documents))
    ratio = pmi / -F.log2(F.col("n_entity") / documents)
    judged = pairs.agg(F.greatest(F.count("*"), F.lit(1)).alias("judged"))
    sure = F.col("n_both") * pmi >= F.log2("judged") + EVIDENCE_BITS
    rows = pairs.crossJoin(F.broadcast(judged)).where(sure).select("term", "kind", "key", ratio.alias("ratio")).where(F.col("ratio") >= generalise_at)  # judged: one row
    return rows.withColumn("action", F.when(F.col("ratio") >= remove_at, "remove").otherwise("generalise"))


def valid_hits(kind: str, hits: str) -> Column:
    return F.filter(hits, lambda h: valid(kind, h["match"]))


def valid_spans(kind: str, hits: str) -> Column:
    return F.transform(hits, lambda h: span(F.lit(kind), h))


def find(docs: DataFrame) -> DataFrame:
    """All columns of docs, plus _text, _spans (base findings, by kind as listed and then by start) and _entities."""
    found = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for kind in KINDS:
        found = locate(found, f"_hits_{kind}", F.col("_text"), PATTERNS[kind], HINTS[kind](F.col("_text")), context=True)
        found = found.withColumn(f"_hits_{kind}", valid_hits(kind, f"_hits_{kind}"))
    entities = F.concat(*[entities_of(k, f"_hits_{k}") for k in KINDS])
    found = found.withColumn("_spans", F.concat(*[valid_spans(k, f"_hits_{k}") for k in KINDS])).withColumn("_entities", entities)
    return found.drop(*[f"_hits_{k}" for k in KINDS])


def telling_terms(found: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> tuple[DataFrame, DataFrame]:
    """Terms that disclose a kind (term, kind, ratio, action), and those that disclose an entity (the same with its key).

    found: _row, _text, _spans, _entities of all documents.
    """
    flags = [has(k).cast("long").alias(f"n_{k}") for k in KINDS]
    sums = [F.sum(f"n_{k}").alias(f"n_{k}") for k in KINDS]
    total = found.select(*flags).agg(F.count("*").alias("n"), *[F.coalesce(s, F.lit(0)).alias(f"n_{k}") for s, k in zip(sums, KINDS)]).first()
    counts = store(found.select(F.explode(terms_of(F.col("_text"))).alias("term"), *flags).groupBy("term").agg(F.count("*").alias("n_term"), *sums), "pii-terms")
    one = counts.select("term", "n_term", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n_both"), F.lit(total[f"n_{k}"]).alias("n_entity")) for k in KINDS])).alias("r"))
    of_kind = disclosing(one.select("term", "r.kind", F.lit(0).alias("key"), "r.n_both", "n_term", "r.n_entity").where("n_both > 0"), total["n"], generalise_at, remove_at)
    near = near_terms(found)
    holders = found.select("_row", F.explode(F.array_distinct(F.transform("_entities", lambda e: e["key"]))).alias("key")).groupBy("key").agg(F.count("*").alias("n_entity"))
    both = near.groupBy("term", "kind", "key").agg(F.count("*").alias("n_both"))
    pairs = store(both.join(holders, "key").join(counts.select("term", "n_term"), "term").select("term", "kind", "key", "n_both", "n_term", "n_entity"), "pii-pairs")
    return of_kind.drop("key"), disclosing(pairs, total["n"], generalise_at, remove_at)


def near_terms(found: DataFrame) -> DataFrame:
    """_row, kind, key, term: distinct terms of a document in the context of each of its entities."""
    held = found.where(F.size("_entities") > 0).select("_row", "_entities", terms_of(F.col("_text")).alias("own"))
    each = held.select("_row", "own", F.explode("_entities").alias("e"))
    # a match can cut an e-mail address in two; its parts are no terms of the document
    return each.select("_row", "e.kind", "e.key", F.explode(F.array_intersect("own", terms_of(F.col("e.context")))).alias("term")).distinct()


def with_terms(docs: DataFrame) -> DataFrame:
    """doc_id, text, carried, plus _text, _spans (base) and _terms (spans of disclosing terms). docs: doc_id, text, carried."""
    # the patterns run once; what follows reads the columns it needs
    found = store(find(docs).drop("_text").withColumn("_row", F.monotonically_increasing_id()), "pii").withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    of_kind, of_entity = telling_terms(found)
    none = F.array().cast(_SPAN)
    clean = found.where(F.size("_spans") == 0).withColumn("_terms", none)
    held = found.where(F.size("_spans") > 0)
    kinds = F.array_distinct(F.transform("_spans", lambda s: s["kind"]))
    words = held.select("_row", kinds.alias("kinds"), F.explode(terms_of(F.col("_text"))).alias("term"))
    hits = words.join(of_kind, "term").where(F.array_contains("kinds", F.col("kind"))).select("_row", "term", "action", "ratio", "kind")
    hits = hits.union(near_terms(held).join(of_entity, ["term", "kind", "key"]).select("_row", "term", "action", "ratio", "kind"))
    # the strongest action of a term in a document stands
    per_term = hits.groupBy("_row", "term").agg(F.max(F.struct("action", "ratio", "kind")).alias("a"))
    per_doc = per_term.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", F.concat_ws("-", "a.action", "a.kind")))).alias("_actions"))
    held = locate(held.join(per_doc, "_row", "left"), "_words", F.col("_text"), TERM[1:-1], F.col("_actions").isNotNull())
    held = held.withColumn("_words", F.transform("_words", lambda h: span(F.try_element_at("_actions", F.lower(h["match"])), h)))
    inside = F.filter("_words", lambda t: t["kind"].isNotNull() & ~F.exists("_spans", lambda s: (t["start"] < s["stop"]) & (s["start"] < t["stop"])))
    held = held.withColumn("_terms", F.when(F.col("_actions").isNull(), none).otherwise(inside)).drop("_actions", "_words")
    return clean.unionByName(held)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """The same columns with base findings masked as [KIND], disclosing terms generalised to [kind] or removed."""
    carried = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"])
    found = with_terms(docs.select("doc_id", "text", carried.alias("carried")))
    spans = F.array_sort(F.transform(F.concat("_spans", "_terms"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    # reach: how far the spans before each one extend (overlapping spans are masked once)
    mark = lambda s: F.when(s["kind"].startswith("remove-"), "").when(s["kind"].startswith("generalise-"), F.concat(F.lit("["), F.substring_index(s["kind"], "-", -1), F.lit("]"))).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    cut = lambda a, b: F.substring(F.col("_text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    parts = F.zip_with("_all", "_reach", lambda s, r: F.concat(cut(r, s["start"]), F.when(s["start"] >= r, mark(s)).otherwise("")))
    last = F.array_max(F.transform("_all", lambda s: s["stop"]))
    found = found.withColumn("_all", spans)
    found = found.withColumn("_reach", before(F.transform("_all", lambda s: s["stop"]), F.greatest))
    text = F.when(F.size("_all") == 0, F.col("text")).otherwise(F.concat(F.array_join(parts, ""), cut(last, F.length("_text").cast("long"))))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"carried.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op1_pii_sanitisation(spark, sf_dir: str) -> DataFrame:
    found = with_terms(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{k}")
    terms = F.array_sort(F.col("_terms"))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("_spans")), 256).alias("base_sha256"), joined(F.concat("_spans", terms)).alias("spans"))
