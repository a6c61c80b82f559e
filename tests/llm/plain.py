"""Plain versions of pipeline stages, over lists of document rows (doc_id, text, lang, source, n_chars)."""

from test_decontaminate import brute as contamination
from test_neardup import shingle_set
from test_secrets import brute as secret_spans

from flowsieve.llm import secrets


def near_duplicates_go(rows):
    sets = [shingle_set(r[1], 5) for r in rows]
    component = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                component = [component[j] if c == component[i] else c for c in component]
    kept = []
    for i, row in enumerate(rows):
        least = min((r[0] for r, c in zip(rows, component) if c == component[i] and r[0] is not None), default=None)
        if (row[0] is None or row[0] == least) and (row[0] is None or row not in kept):
            kept.append(row)
    return kept


def contaminated_go(rows, items):
    bad = {r[0] for r in contamination([(r[0], r[1]) for r in rows], items) if r[4]}
    return [r for r in rows if r[0] not in bad]


def secrets_masked(rows):
    owners, repositories = {}, {}
    for _, text, lang, source, _ in rows:
        for start, place, _, end in secret_spans(text):
            value = _value(text, start, place, end)
            owners.setdefault(value, set()).add(source or "")
            repositories.setdefault(value, set()).add("/".join(x for x in (source, lang) if x is not None))
    out = []
    for doc_id, text, lang, source, n_chars in rows:
        pieces, at, hit = [], 0, False
        for start, place, _, end in secret_spans(text):
            value = _value(text, start, place, end)
            if len(owners[value]) < secrets.EXAMPLE_OWNERS and len(repositories[value]) < secrets.EXAMPLE_REPOSITORIES:
                if start > at or not pieces:
                    pieces += [text[at:start], secrets.MARK]
                at, hit = max(at, end), True
        if hit:
            text = "".join(pieces) + text[at:]
            n_chars = len(text)
        out.append((doc_id, text, lang, source, n_chars))
    return out


def _value(text, start, place, end):
    import re

    _, pattern, group, _, _ = secrets.KINDS[place]
    return re.compile(pattern, re.ASCII).search(text, start)[group]
