"""Plain sequential versions of the community methods for small graphs."""

from __future__ import annotations

import hashlib
import math
from collections import deque

DEFAULT_LOSS = -math.log(0.1)


class Graph:
    """nodes {id: {...}} and edges {(src, dst): {...}} with src < dst."""

    def __init__(self, nodes, edges):
        self.node, self.edge = nodes, edges
        self.near = {n: sorted([b for a, b in edges if a == n] + [a for a, b in edges if b == n]) for n in nodes}

    def data(self, unit):
        return self.edge[unit] if isinstance(unit, tuple) else self.node[unit]

    def key(self, a, b):
        return (a, b) if a < b else (b, a)


def name(unit):
    return "|".join(unit) if isinstance(unit, tuple) else unit


def ordered(g, units, order, seed):
    loss = lambda u: 0.0 if order == "random" else (1 if order == "min_loss" else -1) * g.data(u).get("loss", DEFAULT_LOSS)
    return sorted(units, key=lambda u: (loss(u), hashlib.md5(f"{seed}|{name(u)}".encode()).hexdigest(), name(u)))


def grow(g, most, seed, depth_first, starts=None):
    """[(units in order of use)] of breadth- or depth-first growth."""
    used, out = set(), []
    for start in ordered(g, [*g.node, *g.edge] if starts is None else starts, "random", seed):
        if start in used:
            continue
        found, todo = [], deque([start])
        while todo and len(found) < most:
            unit = todo.pop() if depth_first else todo.popleft()
            if unit in used:
                continue
            used.add(unit)
            found.append(unit)
            if isinstance(unit, tuple):
                todo.extend(n for n in unit if n not in used)
            else:
                free = [k for n in g.near[unit] if (k := g.key(unit, n)) not in used]
                todo.extend(free[:1] if depth_first else free)
        out.append(found)
    return out


def grow_ece(g, most, least, tokens, order, seed):
    used, out = set(), []
    for start in ordered(g, [*g.node, *g.edge], order, seed):
        if start in used:
            continue
        length = lambda u: g.data(u).get("length", 0)
        held, total, todo = [start], length(start), deque([start])
        used.add(start)
        while todo and len(held) < most and total < tokens:
            unit = todo.popleft()
            around = list(unit) if isinstance(unit, tuple) else [g.key(unit, n) for n in g.near[unit]]
            for x in ordered(g, [x for x in around if x not in used], order, seed):
                if len(held) >= most or total >= tokens:
                    break
                used.add(x)
                held.append(x)
                total += length(x)
                todo.append(x)
        if len(held) >= least:
            out.append(held)
    return out


def grow_scoped(g, anchors, section, kinds, required, most, least, seed):
    taken, out = set(), []
    for start in ordered(g, anchors, "random", seed):
        if start in taken:
            continue
        here = section[start]
        inside = lambda n: not (here and section[n] and section[n] != here)  # noqa: B023, E731
        used, found, todo = set(), [], deque([start])
        while todo and len(found) < most:
            unit = todo.popleft()
            if unit in used or not all(map(inside, unit if isinstance(unit, tuple) else (unit,))):
                continue
            used.add(unit)
            found.append(unit)
            todo.extend([n for n in unit if n not in used] if isinstance(unit, tuple) else [k for n in g.near[unit] if (k := g.key(unit, n)) not in used])
        held = [u for u in found if not isinstance(u, tuple)]
        if len(found) >= least and all(any(r in kinds[n] for n in held) for r in required):
            taken.update(held)
            out.append(found)
    return out


def modularity(edges, home):
    m2, degree, inside = 2 * len(edges), {}, 0
    for a, b in edges:
        degree[home[a]] = degree.get(home[a], 0) + 1
        degree[home[b]] = degree.get(home[b], 0) + 1
        inside += home[a] == home[b]
    return 2 * inside / m2 - sum(d * d for d in degree.values()) / m2**2


def greedy_modularity(g, seed):
    """Local moving one node at a time until nothing moves: {node: community}."""
    m2 = 2 * len(g.edge)
    home = {n: n for n in g.node if g.near[n]}
    weight = {n: len(g.near[n]) for n in home}
    moved = True
    while moved:
        moved = False
        for n in ordered(g, list(home), "random", seed):
            links = {}
            for x in g.near[n]:
                links[home[x]] = links.get(home[x], 0) + 1
            k, own = len(g.near[n]), home[n]
            weight[own] -= k
            gain = lambda c: links.get(c, 0) - weight[c] * k / m2  # noqa: B023, E731
            best = max(sorted({*links, own}), key=lambda c: (gain(c), c == own))
            if gain(best) > gain(own) + 1e-12:
                home[n], moved = best, True
            weight[home[n]] += k
    return home
