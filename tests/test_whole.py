"""Queries over whole tables, against brute force on small folders of tables."""

from __future__ import annotations

from collections import defaultdict

import pytest

from weftgraph.operators import graph
from weftgraph.plans.catalogue import QUERIES

TABLES = {
    "region": ("r_regionkey long, r_name string", [(0, "AFRICA"), (1, "ASIA")]),
    "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "X", 0), (1, "Y", 0), (2, "Z", 1)]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey long", [(1, "s1", 0), (60, "s60", 1), (77, "s77", 2)]),
    "customer": ("c_custkey long, c_name string, c_nationkey long", [(i, f"c{i}", i % 2) for i in range(9)]),
    "part": ("p_partkey long, p_name string, p_brand string, p_size int", [(i, f"p{i}", "Brand#55", 40) for i in range(8)]),
    "lineitem": (
        "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_discount double",
        [(1, 2, 1, 0, 40.0, 0.1), (1, 3, 60, 0, 40.0, 0.25), (2, 1, 60, 1, 5.0, 0.5), (2, 2, 60, 1, 5.0, 0.25), (3, 4, 77, 5, 30.0, 0.75)],
    ),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def links():
    t = {k: v[1] for k, v in TABLES.items()}
    nodes = [p + str(r[0]) for p, n in zip("RNSCP", ("region", "nation", "supplier", "customer", "part"), strict=True) for r in t[n]]
    edges = {(f"N{r[0]}", f"R{r[2]}") for r in t["nation"]} | {(f"S{r[0]}", f"N{r[2]}") for r in t["supplier"]} | {(f"C{r[0]}", f"N{r[2]}") for r in t["customer"]} | {(f"S{r[2]}", f"P{r[3]}") for r in t["lineitem"]}
    return nodes, edges


def brute_components():
    nodes, edges = links()
    root = {n: n for n in nodes}
    while any(root[a] != root[b] for a, b in edges):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components_of_the_whole_graph(spark, tables):
    root = brute_components()
    assert {r.id: r.component for r in QUERIES["connected_components"](spark, tables).collect()} == root
    groups = defaultdict(list)
    for n, c in sorted(root.items()):
        groups[c].append(n)
    largest = max(sorted(groups), key=lambda c: len(groups[c]))
    assert sorted(r.id for r in QUERIES["largest_component"](spark, tables).collect()) == groups[largest]
    split = {(r.community, r.id, r.part) for r in QUERIES["split_communities"](spark, tables).collect()}
    assert split == {(c, n, k // 3) for c, g in groups.items() for k, n in enumerate(g)}


def test_a_giant_community_is_ranked_over_several_ranges(spark):
    ids = [f"n{i:05d}" for i in range(5000)]
    members = spark.createDataFrame([("a" if i % 10 else "b", x) for i, x in enumerate(ids)], "community string, id string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.id: r.part for r in graph.split_large(members, 7).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for rest in (lambda i: i % 10 != 0, lambda i: i % 10 == 0):
        own = [x for i, x in enumerate(ids) if rest(i)]
        assert [found[x] for x in own] == [k // 7 for k in range(len(own))]


def test_confidence_of_all_suppliers(spark, tables):
    pairs = defaultdict(list)
    for _, _, s, p, _, discount in TABLES["lineitem"][1]:
        pairs[f"P{p}", f"S{s}"].append(discount)
    found = {(r.src, r.dst): (r.confidence, r.n_confidence) for r in QUERIES["merge_confidence"](spark, tables).collect()}
    assert found == {k: (sum(v) / len(v), len(v)) for k, v in pairs.items()}


LONG = " ".join(f"word{i}" for i in range(900))
DOCS = [(1, "Ein kurzer Text.", "de"), (2, LONG, "fr"), (3, None, "en"), (4, "x" + LONG[:400] + "y tail", "en"), (5, LONG[:200] + " other end", "en"), (6, "a\n b", "es")]
ITEMS = [(10, LONG[:400]), (11, LONG[:200] + " something else"), (12, "kurzer  Text"), (13, "a b"), (14, "urzer Te"), (15, "Ein kurzer Tex"), (16, "word898 word899")]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_trees_hold_whole_texts_of_all_languages(spark, texts):
    assert {r.doc_id for r in QUERIES["tree_parents"](spark, texts).collect()} == {d for d, _, _ in DOCS}
    lengths = defaultdict(list)
    for r in QUERIES["tree_chunks"](spark, texts).filter("type = 'text' AND path LIKE '%text%'").collect():
        lengths[r.doc_id].append(r.length)
    assert lengths[1] == [len("Ein kurzer Text.")]
    assert len(lengths[2]) > 3 and sum(lengths[2]) >= len(LONG.replace(" ", ""))


def test_evidence_is_tested_whole(spark, texts):
    plain = lambda t: " ".join((t or "").split())
    expected = sorted((i, d) for i, s in ITEMS for d, t, _ in DOCS if plain(s) in plain(t))
    assert sorted(tuple(r) for r in QUERIES["evidence_join"](spark, texts).collect()) == expected
    assert (10, 4) in expected and (11, 5) not in expected


def test_communities_of_the_whole_graph(spark, tables):
    nodes, edges = links()
    rows = QUERIES["partition_bfs"](spark, tables).collect()
    assert sorted(n for r in rows for n in r.nodes.split(",") if n) == sorted(nodes)
    assert sorted(e for r in rows for e in r.edges.split(",") if e) == sorted("|".join(sorted(e)) for e in edges)
