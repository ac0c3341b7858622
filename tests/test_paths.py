from __future__ import annotations

import random
from collections import Counter
from itertools import permutations

import pytest

from weftgraph.operators import paths


def listed(edges):
    """All paths of four nodes with b < c, by brute force."""
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return sorted((a, b, c, d) for b in near for c in near[b] if b < c for a in near[b] for d in near[c] if len({a, b, c, d}) == 4)


def drawn_graph(seed, nodes=9, edges=16):
    rng = random.Random(seed)
    pairs = rng.sample(list(permutations(range(nodes), 2)), edges)
    return [(f"n{a}", f"n{b}") for a, b in pairs] + [("n0", f"n{i}") for i in range(1, nodes)]


@pytest.mark.parametrize("seed", range(3))
def test_every_path_once_without_draws(spark, seed):
    rows = drawn_graph(seed) + [("n1", "n1"), (None, "n2")]
    found = paths.sample_paths(spark.createDataFrame(rows, "src string, dst string")).collect()
    assert sorted((r.a, r.b, r.c, r.d) for r in found) == listed(rows)


@pytest.mark.parametrize("seed", range(3))
def test_counts_equal_brute_force(spark, seed):
    rows = drawn_graph(seed) + [("n1", "n1"), (None, "n2")]
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(10)], "id string")
    found = {r.id: r.n_paths for r in paths.path_counts(nodes, spark.createDataFrame(rows, "src string, dst string")).collect()}
    starts = Counter(x for p in listed(rows) for x in (p[0], p[3]))
    assert found == {f"n{i}": starts[f"n{i}"] for i in range(10)}


def test_draws_are_even_and_repeatable(spark):
    rows = drawn_graph(7)
    edges = spark.createDataFrame(rows, "src string, dst string")
    index = paths.path_index(edges)
    draws = 40 * index.walks + 13
    take = lambda seed: Counter((r.a, r.b, r.c, r.d) for r in paths.sample_paths(edges, draws, seed=seed, index=index).collect())
    found = take(1)
    assert sorted(found) == listed(rows)
    expected = draws / index.walks
    assert all(abs(n - expected) <= 2 for n in found.values())  # a walk meets at most two shares that lie in it in part
    assert found == take(1)
    few = paths.sample_paths(edges, 5, seed=3, index=index).collect()
    assert len(few) <= 5 and {(r.a, r.b, r.c, r.d) for r in few} <= set(listed(rows))


def test_seeds_reach_every_path_with_one_draw(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "e")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    index = paths.path_index(edges)
    found = Counter((r.a, r.d) for seed in range(24) for r in paths.sample_paths(edges, 1, seed=seed, index=index).collect())
    assert set(found) == {("a", "d"), ("e", "d")} and min(found.values()) >= 5


def test_prefix_sums_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(paths, "BLOCK", 4)
    df = spark.range(0, 90, 3).withColumnRenamed("id", "number").selectExpr("number", "number % 7 AS w")
    found = {r.number: r.before for r in paths.prefix_sums(df, "number", "w", "before", 90).collect()}
    assert found == {k: sum(j % 7 for j in range(0, k, 3)) for k in range(0, 90, 3)}


def test_hub_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(paths, "BLOCK", 3)
    rows = [("hub", f"x{i}") for i in range(12)] + [("x0", f"y{i}") for i in range(5)]
    found = paths.sample_paths(spark.createDataFrame(rows, "src string, dst string")).collect()
    assert sorted((r.a, r.b, r.c, r.d) for r in found) == listed(rows)


@pytest.mark.parametrize("rows", [[], [("a", "b")], [("a", "a"), (None, "a")], [("a", "b"), ("b", "c"), ("c", "a")]])
def test_graphs_without_paths(spark, rows):
    edges = spark.createDataFrame(rows, "src string, dst string")
    assert paths.sample_paths(edges).collect() == paths.sample_paths(edges, 9).collect() == []
    nodes = spark.createDataFrame([("a",), ("z",)], "id string")
    assert {(r.id, r.n_paths) for r in paths.path_counts(nodes, edges).collect()} == {("a", 0), ("z", 0)}


def test_written_tables_leave_no_shuffle_files(spark):
    from pathlib import Path

    from weftgraph.sources.storage import CLEANUP, cut_lineage

    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}
    before, kept = files(), spark.conf.get(CLEANUP)
    df = spark.range(20_000).repartition(3, "id").selectExpr("id % 900 AS k").groupBy("k").count()
    assert cut_lineage(df).count() == 900
    own = cut_lineage(df.orderBy("k"))
    assert [r["count"] for r in own.orderBy("k").limit(2).collect()] == [23, 23] and spark.conf.get(CLEANUP) == kept
    index = paths.path_index(spark.createDataFrame(drawn_graph(3), "src string, dst string"))
    assert index.walks > 0
    left = [f for f in files() - before if f.exists()]
    assert sum(f.stat().st_size for f in left) < 20_000
