"""Brute-force versions of pipeline stages over {doc_id: text}."""

import re

from test_text_operators import PATTERNS, WORD, counts, jaccard_components


def kept_of_groups(texts):
    ids = sorted(texts)
    got = jaccard_components([texts[i] for i in ids])
    return {ids[k] for k, (_, top) in got.items() if top == k}


def dedup_words(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        w = WORD.findall(texts[i])
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        out[i] = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else texts[i]
    return out


def masked_base(text):
    """Base findings masked; the smallest table has no term over the disclosure thresholds."""
    spans = sorted((m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if counts(k, m[0]))
    out, at = "", 0
    for start, stop, kind in spans:
        out += text[at:start]
        if start >= at:
            out += f"[{kind.upper()}]"
        at = max(at, stop)
    return out + text[at:]


def sanitised(texts: dict) -> dict:
    """Base findings masked and disclosing terms generalised or removed, by the definition over all these texts."""
    from test_text_operators import base_spans, brute_terms

    out, ids = {}, list(texts)
    for i, terms in zip(ids, brute_terms([texts[i] for i in ids])):
        t = texts[i]
        base = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in (x.split(":") for x in base_spans(t).split(",") if x)]
        marks = base + [(a, b, "" if k.startswith("remove") else f"[{k.split('-')[1]}]") for k, a, b in terms] if base else []
        text, at = "", 0
        for a, b, mark in sorted(marks):
            text, at = text + t[at:a] + mark if a >= at else text, max(at, b)
        out[i] = text + t[at:]
    return out
