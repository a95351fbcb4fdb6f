"""Plain-Python forms of the operators, for small tables."""

from __future__ import annotations

import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=4):
    w = spaced((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def link_components(rows, percent=85):
    """``{doc_id: (n, component)}`` by comparing every pair that shares a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    shared = {}
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[b], ids[a]] = shared.get((ids[b], ids[a]), 0) + 1
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def windows(words, n=10):
    return {tuple(words[i:i + min(n, len(words))]) for i in range(max(1, len(words) - n + 1))} if words else set()


def decontaminate(text, items):
    """(n_words, n_hit, item ids) of one text against ``[(id, text)]``."""
    w = alnum(text)
    hit, ids = set(), set()
    for item_id, item in items:
        for g in windows(alnum(item)):
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    ids.add(str(item_id))
    return len(w), len(hit), sorted(ids)


def _kind(text, pattern, ok=lambda m: True):
    return [(m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m.group())]


def _luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return 14 <= len(digits) <= 19 and sum(sum(divmod(d * 2, 10)) if i % 2 else d for i, d in enumerate(digits)) % 10 == 0


def base_spans(text):
    """``[(start, rank, end, kind)]`` of the base kinds."""
    text = text or ""
    digits = lambda v: sum(c in string.digits for c in v)
    found = {
        "email": _kind(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": _kind(text, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": _kind(text, r"[0-9]([\x20-]?[0-9])+", _luhn),
        "phone": _kind(text, r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= digits(v) <= 15),
    }
    return sorted((a, i, b, k) for i, (k, spans) in enumerate(found.items()) for a, b in spans)


def phrase_places(words, phrases):
    """``{label: [starts]}``."""
    out = {}
    for phrase, label in phrases:
        p = phrase.split()
        out.setdefault(label, []).extend(i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p)
    return out


def block_labels(words, templates, threshold, stretch):
    """Labels and best containment over every window of ``ceil(stretch * n)`` words."""
    import math

    labels, best = set(), 0.0
    for label, wording in templates:
        tokens = set(wording.split())
        n = len(tokens)
        need, size = math.ceil(threshold * n - 1e-9), math.ceil(stretch * n)
        for i in range(len(words)):
            both = len(tokens & set(words[i:i + size]))
            if both >= need:
                labels.add(label)
                best = max(best, both / n)
    return labels, best
