"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: query -> module of this subpackage that defines a function of that name
_WHERE = {
    "op1_pii_sanitisation": "pii",
    "op2_bpe_lexicon": "bpe_lexicon",
    "op3_embedding_near_dedup": "embed_dedup",
    "op4_language_id": "language_id",
    "op5_substring_dedup": "substring",
    "op6_toxicity": "toxicity",
    "op7_ngram_jaccard_join": "ngram_join",
    "op8_context_tree_scoring": "ctw",
    "op9_best_fit_packing": "packing",
    "op10_quality_rules": "quality_bands",
    "op11_hard_negatives": "hard_negatives",
    "op12_source_divergence": "source_audit",
    "op13_quality_classifier": "quality_svm",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _WHERE.items()}



#: Words of a text (null: none) as a list.
_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
#: A-Z in lower case, other letters as they are.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: comp: the smallest id that each end of a link reaches. Expects links (x, y).
_REACH = """both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT DISTINCT x, x AS y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
comp AS (SELECT x, min(y) AS least FROM reach GROUP BY x)"""

OP3 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id < b.vec_id WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
{_REACH}, degree AS (SELECT x, count(*) AS n FROM both_ways GROUP BY x)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(least, e.vec_id) AS component_id, coalesce(least, e.vec_id) = e.vec_id AS kept FROM embeddings e LEFT JOIN degree d ON d.x = e.vec_id LEFT JOIN comp c ON c.x = e.vec_id"""

OP5 = f"""WITH w AS (SELECT doc_id, {_WORDS.format(text='text')} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS key FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS j FROM later),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""

OP7 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS key FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b ON a.key = b.key AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
{_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, d.doc_id) AS component_id FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN comp c ON c.x = d.doc_id"""

OP11 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10"""

#: share of a count n among total occurrences of kept terms, in parts of 10**9
_SHARE = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * {kept})"
_APART = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"

OP12 = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT lang, count(*)::HUGEINT AS kept, sum(n) AS whole FROM kept GROUP BY lang),
total AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, {_SHARE.format(n='coalesce(c.n, 0)', total='total', kept='size.kept')} AS p, {_SHARE.format(n='kept.n', total='whole', kept='size.kept')} AS q FROM total JOIN size USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
diff AS (SELECT a.lang, a.source, b.source AS item, sum({_APART.format(p='a.p', q='b.p')}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN diff ON diff.lang = a.lang AND diff.source = a.source AND diff.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ({_APART.format(p='p', q='q')})::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_near_dedup": OP3, "op5_substring_dedup": OP5, "op7_ngram_jaccard_join": OP7, "op11_hard_negatives": OP11, "op12_source_divergence": OP12}
