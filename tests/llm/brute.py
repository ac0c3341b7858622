"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = words(lower(text))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_components(docs):
    """{doc_id: (n_shingles, component_id)} by comparing all documents that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    holders = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            holders[x].add(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    done = set()
    for held in holders.values():
        held = sorted(held)
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                if (a, b) not in done:
                    done.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeats(docs, length=50):
    """[(doc_id, n_words, n_removed, kept text)] for (doc_id, text) rows."""
    low = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - length + 1):
            if d is not None:
                k = tuple(w[i : i + length])
                low[k] = min(low.get(k, d), d)
    out = []
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - length + 1):
            if d is not None and low[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def folded_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items, window=10):
    """[(doc_id, n_words, n_hit, item ids sorted as strings)]"""
    wins = defaultdict(set)
    for i, t in items:
        w = folded_words(t)
        if w:
            for k in range(max(1, len(w) - window + 1)):
                wins[tuple(w[k : k + window])].add(str(i))
    lengths = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, found = folded_words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[x]
        out.append((d, len(w), len(hit), sorted(found)))
    return out
