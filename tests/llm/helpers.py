"""Brute-force versions of the training-data operators, on rows (doc_id, text)."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")

#: Nulls, empty and blank texts, repeated rows, ties, clashing extra columns.
ODD = [(None, "a b c"), (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (5, "one  two"), (6, "é ß 日本 🙂")]


def words(text):
    return WORD.findall(text or "")


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def near_classes(rows, size=5, threshold=0.8):
    """{doc_id: (rep_id, class_id)} by comparing all pairs of different texts."""
    first, rep, bag = {}, {}, {}
    for i, text in sorted((i, t) for i, t in rows if i is not None and words(t)):
        w = tuple(words(text))
        rep[i] = first.setdefault(w, i)
        bag[rep[i]] = Counter(w[k : k + size] for k in range(max(1, len(w) - size + 1)))
    parent = {i: i for i in bag}
    for a in bag:
        for b in bag:
            if b < a:
                both = sum((bag[a] & bag[b]).values())
                if both >= threshold * (sum(bag[a].values()) + sum(bag[b].values()) - both):
                    x, y = find(parent, a), find(parent, b)
                    parent[max(x, y)] = min(x, y)
    out = {i: (i, i) for i, _ in rows if i is not None}
    return out | {i: (r, find(parent, r)) for i, r in rep.items()}


def cut_passages(rows, size=13):
    """{doc_id: (kept words, removed)} for distinct ids."""
    first = {}
    for i, text in sorted((i, t) for i, t in rows if i is not None and t):
        w = words(text)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = {}
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = ([x for x, g in zip(w, gone, strict=True) if not g], gone)
    return out


def contained(docs, items, size=5, threshold=0.8):
    """{(doc_id, item_id): (n_shingles, n_shared)}."""
    grams = lambda t: {tuple(words(t)[k : k + size]) for k in range(len(words(t)) - size + 1)}
    held = defaultdict(set)
    for i, t in docs:
        held[i] |= grams(t)
    out = {}
    for j, t in items:
        g = grams(t)
        for i, h in held.items():
            if i is not None and j is not None and g and len(g & h) >= threshold * len(g):
                out[i, j] = (len(g), len(g & h))
    return out
