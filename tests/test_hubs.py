"""Rows that joins make on graphs with hubs, and what merging reads again."""

from __future__ import annotations

from itertools import permutations

from weftgraph.operators import baselines, graph


def most_rows(df, kind="Join", metric="numOutputRows"):
    """The largest number of rows that a join, or a step of another kind, of the query made, after it ran."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        if kind in name and p.metrics().contains(metric):
            most = max(most, p.metrics().apply(metric).value())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_neighbours_of_a_hub_dont_meet_each_other(spark):
    rows = [("hub", f"leaf{i}") for i in range(500)] + [("hub", "next"), ("next", "end")]
    found = baselines.simple_paths(spark.createDataFrame(rows, "src string, dst string"))
    assert most_rows(found) <= 2 * 502
    assert sorted(map(tuple, found.collect())) == sorted(p for i in range(500) for p in ((f"leaf{i}", "hub", "next", "end"), ("end", "next", "hub", f"leaf{i}")))


def test_paths_beside_triangles_equal_brute_force(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "e"), ("b", "a"), ("x", "y")]
    near = {frozenset(r) for r in rows}
    expected = sorted(p for p in permutations("abcdexy", 4) if all(frozenset(q) in near for q in zip(p, p[1:], strict=False)))
    edges = spark.createDataFrame(rows, "src string, dst string")
    assert sorted(map(tuple, baselines.simple_paths(edges).collect())) == expected
    starts = sorted({p[0] for p in expected} | {"x", "y"})[:2]
    assert sorted(map(tuple, baselines.simple_paths(edges, sources=2).collect())) == [p for p in expected if p[0] in starts]


def brute_hops(rows, seeds, hops):
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = set()
    for s in seeds:
        seen, frontier = {s}, {s}
        out.add((s, s, 0))
        for hop in range(1, hops + 1):
            frontier = {y for x in frontier for y in near.get(x, ())} - seen
            seen |= frontier
            out |= {(s, x, hop) for x in frontier}
    return sorted(out)


def test_hops_equal_brute_force_and_lone_neighbours_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARE", 7)
    rows = [("hub", f"leaf{i}") for i in range(60)] + [("hub", "a"), ("hub", "b"), ("a", "c"), ("b", "c"), ("c", "c"), ("c", "d"), ("d", "c"), ("x", "y")]
    seeds = [f"leaf{i}" for i in range(0, 60, 3)] + ["hub", "c", "x", "nowhere"]
    edges, start = spark.createDataFrame(rows, "src string, dst string"), spark.createDataFrame([(s,) for s in seeds], "seed string")
    for hops in (1, 2, 3):
        assert sorted(map(tuple, graph.k_hop(edges, start, hops).collect())) == brute_hops(rows, seeds, hops)
    found = graph.k_hop(edges, start, 2)
    assert most_rows(found, "Exchange", "shuffleRecordsWritten") < len(brute_hops(rows, seeds, 2)) / 4
