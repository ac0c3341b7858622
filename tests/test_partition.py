"""Community methods against sequential versions on random graphs."""

from __future__ import annotations

import random

import plain
import pytest

from weftgraph.operators import leiden, partition


def random_graph(seed, n=40, m=70, hub=True):
    rng = random.Random(seed)
    nodes = {f"n{i:02d}": {"length": rng.randint(0, 9), "loss": rng.choice((0.1, 0.5, 0.5, 1.0, 2.5))} for i in range(n)}
    names = sorted(nodes)
    edges = {}
    for _ in range(m):
        a, b = sorted(rng.sample(names, 2))
        edges[a, b] = {"length": rng.randint(0, 9), "loss": rng.choice((0.1, 0.5, 1.0))}
    if hub:  # one node beside most others
        for x in names[2:-4]:
            edges[names[1], x] = {"length": 1, "loss": 0.5}
    return plain.Graph(nodes, edges)


def tables(spark, g, **more):
    n = [(i, d["length"], d["loss"], *[of[i] for of in more.values()]) for i, d in g.node.items()]
    e = [(b, a, d["length"], d["loss"]) if i % 2 else (a, b, d["length"], d["loss"]) for i, ((a, b), d) in enumerate(g.edge.items())]
    return spark.createDataFrame(n, "id string, length int, loss double" + "".join(f", {k} string" for k in more)), spark.createDataFrame(e, "src string, dst string, length int, loss double")


def found(df):
    return sorted(([*r.nodes], [(e.src, e.dst) for e in r.edges], r.community_id) for r in df.collect())


def expected(communities):
    return sorted(([u for u in c if not isinstance(u, tuple)], [u for u in c if isinstance(u, tuple)], plain.name(c[0])) for c in communities)


@pytest.mark.parametrize("seed, most", [(2, 3), (4, 12)])
def test_breadth_and_depth_first_equal_sequential_growth(spark, seed, most):
    g = random_graph(seed)
    t = tables(spark, g)
    assert found(partition.bfs(*t, max_units=most, seed=seed)) == expected(plain.grow(g, most, seed, False))
    assert found(partition.dfs(*t, max_units=most, seed=seed)) == expected(plain.grow(g, most, seed, True))


@pytest.mark.parametrize("seed, order, tokens", [(5, "random", 10_000), (6, "max_loss", 25), (7, "min_loss", 10_000)])
def test_growth_by_loss_equals_sequential_growth(spark, seed, order, tokens):
    g = random_graph(seed)
    rows = partition.ece(*tables(spark, g), max_units=7, min_units=2, max_tokens=tokens, order=order, seed=seed)
    assert found(rows) == expected(plain.grow_ece(g, 7, 2, tokens, order, seed))


@pytest.mark.parametrize("method, params", [("bfs", {"max_units": 5}), ("ece", {"max_units": 7})])
def test_a_giant_component_is_grown_in_blocks(spark, method, params):
    """Every unit is in one community, communities hang together and stay small, whatever the blocks."""
    g = random_graph(11, 150, 250)
    rows = partition.partition(*tables(spark, g), method, block_units=40, **params).collect()
    assert sorted(n for r in rows for n in r.nodes) == sorted(g.node)
    assert sorted((e.src, e.dst) for r in rows for e in r.edges) == sorted(g.edge)
    assert max(len(r.nodes) + len(r.edges) for r in rows) > 1
    for r in rows:
        units = [*r.nodes, *[(e.src, e.dst) for e in r.edges]]
        assert len(units) <= params["max_units"]
        root = {u: u for u in units}
        for e in units:
            for n in e if isinstance(e, tuple) else ():
                if n in root:
                    old, new = root[n], root[e]
                    root = {u: new if x == old else x for u, x in root.items()}
        assert len(set(root.values())) == 1


def test_blocks_are_bounded(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from weftgraph.operators import growth

    g = random_graph(12, 150, 600)
    n, e = tables(spark, g)
    units = growth.blocked(n.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), "length", "loss", F.lit(True).alias("starts")), e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "length", "loss", F.lit(True).alias("starts")), most=128, seed=1)
    sizes = Counter(r.block for r in units.collect())
    assert sum(sizes.values()) == len(g.node) + len(g.edge) and max(sizes.values()) <= 2 * 128 + 64 and len(sizes) > 3


def test_a_chain_in_seed_order_is_grown_to_the_end(spark):
    names = [f"n{i:02d}" for i in range(30)]
    g = plain.Graph({x: {"length": 1, "loss": float(i)} for i, x in enumerate(names)}, {(a, b): {"length": 1, "loss": 0.5 + i} for i, (a, b) in enumerate(zip(names, names[1:], strict=False))})
    assert found(partition.ece(*tables(spark, g), max_units=4, order="min_loss")) == expected(plain.grow_ece(g, 4, 1, 10**9, "min_loss", 42))


@pytest.mark.parametrize("seed", [8])
def test_anchors_equal_sequential_growth(spark, seed):
    g, rng = random_graph(seed), random.Random(seed)
    kind = {n: rng.choice(("IMAGE", "text", "Table", "person", "image_crop", None)) for n in g.node}
    section = {n: rng.choice(("", "a", "a", "b")) for n in g.node}
    t = tables(spark, g, entity_type=kind, section=section)
    anchors = [n for n in g.node if "image" in (kind[n] or "").lower()]
    assert found(partition.anchor_bfs(*t, max_units=5, seed=seed)) == expected(plain.grow(g, 5, seed, False, anchors))
    shown = {n: {"image" if "image" in (k or "").lower() else "table" if k == "Table" else "text", (k or "").lower()} for n, k in kind.items()}
    for scoped in (True, False):
        where = section if scoped else dict.fromkeys(section, "")
        rows = partition.aggregated_vqa(*t, max_units=9, min_units=4, section_scoped=scoped, seed=seed)
        assert found(rows) == expected(plain.grow_scoped(g, anchors, where, shown, ("image", "text"), 9, 4, seed))


@pytest.mark.parametrize("kind", ["struct", "map", "json"])
def test_section_is_read_from_the_metadata(spark, kind):
    paths = {"img": "s/A", "near": "s/A", "p1": "s/B", "p2": "s/B"}
    value = {"struct": "named_struct('path', p)", "map": "map('path', p)", "json": "to_json(named_struct('path', p))"}[kind]
    nodes = spark.createDataFrame([(i, "IMAGE" if i == "img" else "PERSON", p) for i, p in paths.items()], "id string, entity_type string, p string").selectExpr("id", "entity_type", f"{value} AS metadata")
    edges = spark.createDataFrame([("img", x) for x in ("near", "p1", "p2")], "src string, dst string")
    [c] = partition.aggregated_vqa(nodes, edges, min_units=2).collect()
    assert sorted(c.nodes) == ["img", "near"]


def test_growth_of_empty_tables(spark):
    nodes, edges = spark.createDataFrame([], "id string, entity_type string"), spark.createDataFrame([], "src string, dst string")
    for method in partition.METHODS:
        assert partition.partition(nodes, edges, method).collect() == []


def blocks(seed, groups=6, size=14, inside=0.5, across=0.02):
    rng = random.Random(seed)
    names = [f"v{g}_{i:02d}" for g in range(groups) for i in range(size)]
    edges = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < (inside if a[:3] == b[:3] else across)}
    return plain.Graph({n: {} for n in names}, dict.fromkeys(sorted(edges), {}))


@pytest.mark.parametrize("make", [lambda: blocks(2, 6, 8, 0.6, 0.01), lambda: random_graph(4, 40, 50, True)])
@pytest.mark.parametrize("small", [0, 20_000])
def test_modularity_is_no_worse_than_greedy_moving_and_communities_are_connected(spark, make, small):
    g = make()
    edges = spark.createDataFrame([(b, a) for a, b in g.edge], "src string, dst string")
    labels = leiden.communities(edges, small=small)
    home = {r.id: r.community for r in labels.collect()}
    assert set(home) == {n for n in g.node if g.near[n]}
    own = plain.modularity(list(g.edge), home)
    assert own >= plain.modularity(list(g.edge), plain.greedy_modularity(g, 42)) - 0.01
    assert abs(leiden.modularity(edges, labels) - own) < 1e-9
    for c in set(home.values()):
        members = {n for n, x in home.items() if x == c}
        assert c == min(members)
        seen, todo = set(), [c]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [x for x in g.near[n] if x in members]
        assert seen == members


def test_two_cliques_are_cut_to_size(spark):
    left, right = [("a", "b"), ("b", "c"), ("a", "c")], [("x", "y"), ("y", "z"), ("x", "z")]
    edges = spark.createDataFrame([*left, *right, ("c", "x")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcxyzq"], "id string")
    rows = partition.leiden(nodes, edges, max_size=2).collect()
    assert sorted(r.nodes for r in rows) == [["a", "b"], ["c"], ["x", "y"], ["z"]]
    assert sorted((e.src, e.dst) for r in rows for e in r.edges) == [("a", "b"), ("x", "y")]
