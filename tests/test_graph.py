from __future__ import annotations

import pytest

from weftgraph.operators import graph, kg, partition

GRID = ["01", "12", "03", "14", "25", "34", "45"]


@pytest.fixture(scope="module")
def grid(spark):
    nodes = spark.createDataFrame([(str(i), "T", 3, 0.1 * i) for i in range(6)], "id string, entity_type string, length int, loss double")
    edges = spark.createDataFrame([(e[0], e[1], 2, 0.5) for e in GRID], "src string, dst string, length int, loss double")
    return nodes, edges


def test_empty_and_single_node(spark):
    edges = spark.createDataFrame([], "src string, dst string")
    assert partition.bfs(spark.createDataFrame([], "id string"), edges).collect() == []
    [one] = partition.ece(spark.createDataFrame([("A",)], "id string"), edges).collect()
    assert (one.nodes, one.edges) == (["A"], [])


def test_token_budget(spark):
    nodes = spark.createDataFrame([(x, 3000) for x in "ABC"], "id string, length int")
    edges = spark.createDataFrame([("A", "B", 2000)], "src string, dst string, length int")
    assert len(partition.ece(nodes, edges, max_tokens=5000).collect()) >= 2


def test_section_scope(spark):
    nodes = spark.createDataFrame([("img", "IMAGE", "sec/A"), ("a", "TEXT", "sec/A"), ("b", "TEXT", "sec/B")], "id string, entity_type string, section string")
    edges = spark.createDataFrame([("img", "a"), ("img", "b")], "src string, dst string")
    [c] = partition.aggregated_vqa(nodes, edges, min_units=2).collect()
    assert sorted(c.nodes) == ["a", "img"] and len(c.edges) == 1


def test_components_of_a_long_path(spark):
    nodes = spark.createDataFrame([(i,) for i in range(70)], "id int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "src int, dst int")
    found = {r.id: r.component for r in graph.components(nodes, edges).collect()}
    assert found == {i: 0 if i <= 60 else i for i in range(70)}


def test_edge_upsert_needs_both_ends(grid, spark):
    new = spark.createDataFrame([("5", "0", 9, 0.1), ("5", "99", 9, 0.1), ("1", "0", 7, 0.2)], "src string, dst string, length int, loss double")
    rows = {(r.src, r.dst): r.length for r in graph.upsert_edges(*grid, new).collect()}
    assert rows[("0", "5")] == 9 and rows[("0", "1")] == 7 and len(rows) == 8


def test_structure_of_an_empty_graph(spark):
    row = graph.structure(spark.createDataFrame([], "id string"), spark.createDataFrame([], "src string, dst string")).first()
    assert row.total_nodes == 0 and row.noise_ratio is None and row.is_robust is False


def test_strict_build_keeps_grounded_triplets(spark):
    chunks = spark.createDataFrame([("c1", "Alpha uses Beta. Gamma is alone.")], "chunk_id string, content string")
    reply = '("entity"<|>alpha<|>t<|>d<|>Alpha)##("entity"<|>beta<|>t<|>d<|>Beta)##("entity"<|>ghost<|>t<|>d<|>Ghost)##("relationship"<|>alpha<|>beta<|>uses<|>s<|>Alpha uses Beta<|>0.9)##("relationship"<|>alpha<|>ghost<|>uses<|>s<|>Alpha<|>0.9)##("relationship"<|>beta<|>alpha<|>low<|>s<|>Beta<|>0.1)<|COMPLETE|>'
    nodes, edges = kg.build_tree(chunks, spark.createDataFrame([("c1", reply)], "chunk_id string, reply string"), grounded=True)
    assert sorted(r.id for r in nodes.collect()) == ["ALPHA", "BETA"]
    [e] = edges.collect()
    assert (e.src, e.dst, e.relation_type, e.confidence) == ("ALPHA", "BETA", "uses", 0.9)


def test_filter_entities_drops_the_ghost(spark):
    nodes = spark.createDataFrame([("ALPHA", "c1", "Alpha"), ("GHOST", "c1", "never"), ("NONE", "c1", "")], "id string, source_id string, evidence_span string")
    edges = spark.createDataFrame([("ALPHA", "GHOST")], "src string, dst string")
    kept, left = kg.filter_entities(nodes, edges, spark.createDataFrame([("c1", "Alpha here")], "chunk_id string, content string"))
    assert [r.id for r in kept.collect()] == ["ALPHA"] and left.collect() == []
