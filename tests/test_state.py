"""Increments: the mergeable state of a graph, the ledger's commits, and what the build wires in."""

from __future__ import annotations

import random

import pytest

from weftgraph.models.base import ScriptedModel
from weftgraph.operators import kg
from weftgraph.sources import storage
from weftgraph.streaming.incremental import Ledger

ENTITIES, RELATIONS = "chunk_id string, ord int, name string, type string, description string, evidence string", "chunk_id string, ord int, src string, dst string, relation string, description string, evidence string, confidence double"


def mentions(seed=1, n=120):
    rng = random.Random(seed)
    e = [(f"c{rng.randint(0, 30):02d}", i, rng.choice("ABCDE"), rng.choice(("T", "U", "V")), rng.choice(("", "d1", "d2", "d3")), rng.choice(("", "e1"))) for i in range(n)]
    r = [(f"c{rng.randint(0, 30):02d}", i, rng.choice("ABCDEX"), rng.choice("ABCDE"), rng.choice(("r", "s")), rng.choice(("", "d1")), "", rng.choice((0.1, 0.3, 0.7, 1 / 3))) for i in range(n)]
    return e, r


def plain(e, r):
    """Nodes and edges by the rules, from lists."""
    def label(rows, at):
        kinds = {x[at] for x in rows}
        return min(kinds, key=lambda k: (-sum(x[at] == k for x in rows), min((x[0], x[1]) for x in rows if x[at] == k), k))

    join = lambda values: "<SEP>".join(sorted({v for v in values if v}))
    nodes = {}
    for name in {x[2] for x in e}:
        rows = [x for x in e if x[2] == name]
        nodes[name] = (label(rows, 3), join(x[4] for x in rows), join(x[5] for x in rows), join(x[0] for x in rows))
    edges = {}
    for pair in {tuple(sorted(x[2:4])) for x in r if x[2] != x[3]}:
        rows = [x for x in r if tuple(sorted(x[2:4])) == pair]
        if set(pair) <= set(nodes):
            edges[pair] = (label(rows, 4), join(x[5] for x in rows), join(x[0] for x in rows), round(sum(x[7] for x in rows) / len(rows), 9), len(rows))
    return nodes, edges


def tables(state):
    nodes = {r.id: (r.entity_type, r.description, r.evidence_span, r.source_id) for r in state.nodes().collect()}
    edges = {(r.src, r.dst): (r.relation_type, r.description, r.source_id, round(r.confidence, 9), r.n_confidence) for r in state.edges().collect()}
    return nodes, edges


def test_increments_give_what_one_run_gives(spark, tmp_path):
    e, r = mentions()
    of = lambda part: kg.GraphState.of(spark.createDataFrame([x for x in e if part(x)], ENTITIES), spark.createDataFrame([x for x in r if part(x)], RELATIONS))
    want = plain(e, r)
    assert tables(of(lambda x: True)) == want
    first = of(lambda x: x[1] % 3 == 0).save(str(tmp_path / "s1"))
    merged = of(lambda x: x[1] % 3 == 2).merge(first).merge(of(lambda x: x[1] % 3 == 1)).save(str(tmp_path / "s2"))
    assert tables(merged) == want


def test_rows_can_be_bounded_while_the_state_keeps_all(spark):
    rows = [(f"c{i:03d}", i, "HUB", "T", f"d{i:03d}", "") for i in range(50)]
    state = kg.GraphState.of(spark.createDataFrame(rows, ENTITIES), spark.createDataFrame([], RELATIONS))
    [node] = state.nodes(most=3).collect()
    assert node.source_id == "c000<SEP>c001<SEP>c002" and state.values.filter("field = 'chunk'").count() == 50


def test_state_of_empty_tables(spark):
    state = kg.GraphState.of(spark.createDataFrame([], ENTITIES), spark.createDataFrame([], RELATIONS))
    assert tables(state.merge(state)) == ({}, {})


REPLY = '("entity"<|>"image-1"<|>"image"<|>"A picture of treated tissue.")##("entity"<|>"Tissue"<|>"component"<|>"Tissue in it.")##("relationship"<|>"image-1"<|>"Tissue"<|>"contains"<|>"It holds tissue."<|>"not quoted"<|>0.2)<|COMPLETE|>'


def test_images_are_exempt_from_evidence_rules_and_carry_metadata(spark):
    chunks, replies = spark.createDataFrame([("t1", "Alpha here")], "chunk_id string, content string"), spark.createDataFrame([("t1", '("entity"<|>alpha<|>t<|>d<|>Alpha)##("entity"<|>ghost<|>t<|>d<|>never said)')], "chunk_id string, reply string")
    rows = spark.createDataFrame([("i1", "image", "", ["Figure 1 shows treated tissue of a mouse, stained."], "a/b.png"), ("f1", "formula", "x", [], ""), ("i2", "image", "own words", [], "")], "chunk_id string, type string, content string, caption array<string>, img_path string")
    shown = kg.multimodal_text(rows)
    texts = {r.chunk_id: r.content for r in shown.collect()}
    assert texts == {"i1": "[Image Caption]\nFigure 1 shows treated tissue of a mouse, stained.", "i2": "own words"}
    answers = spark.createDataFrame([("i1", REPLY), ("f1", REPLY)], "chunk_id string, reply string")
    nodes, edges = kg.build(chunks, replies, multimodal=(shown, answers), require_entity_evidence=True)
    found = {r.id: r for r in nodes.collect()}
    assert set(found) == {"ALPHA", "IMAGE-1", "TISSUE"}
    assert '"img_path":"a/b.png"' in found["IMAGE-1"].metadata and found["TISSUE"].metadata is None
    [e] = edges.collect()
    assert (e.src, e.dst, e.confidence, e.source_id) == ("IMAGE-1", "TISSUE", 0.2, "i1")


def test_short_image_texts_get_their_own_content(spark):
    rows = spark.createDataFrame([("i", "image", "Long words around", "Fig 1", ""), ("t", "table", "c", "Table 1", "<table>1</table>"), ("u", "table", "only content", "", "")], "chunk_id string, type string, content string, caption string, body string")
    found = {r.chunk_id: r.content for r in kg.multimodal_text(rows).collect()}
    assert found == {"i": "[Image Caption]\nFig 1\n\n[Fallback Context]\nLong words around", "t": "Table 1\n\n<table>1</table>", "u": "only content"}


def test_long_descriptions_are_summarised(spark):
    chunks = spark.createDataFrame([("c", "A is " + "word " * 30)], "chunk_id string, content string")
    replies = spark.createDataFrame([("c", f'("entity"<|>a<|>t<|>{"word " * 30}<|>)##("entity"<|>b<|>t<|>short<|>)')], "chunk_id string, reply string")
    nodes, _ = kg.build(chunks, replies, summarizer=ScriptedModel((("Summarize what is said of A ", "in short"),), "wrong"), limit=20)
    assert {r.id: r.description for r in nodes.collect()} == {"A": "in short", "B": "short"}


def test_the_model_is_asked_whether_records_are_missing(spark):
    chunks = spark.createDataFrame([("c1", "one"), ("c2", "two")], "chunk_id string, content string")
    model = ScriptedModel((("two\n", '"No"'), ("MORE\nRecords so far are above. Are", "no"), ("Are entities", ' "Yes" '), ("Add the ones", "MORE")), "FIRST")
    got = {r.chunk_id: r.reply for r in kg.extraction_replies(chunks, model, max_loop=3).collect()}
    assert got == {"c1": "FIRST##MORE", "c2": "FIRST"}


SCHEMA = "_trace_id string, content string"


def upper(rows):
    return rows.selectExpr("concat('up-', _trace_id) AS _trace_id", "upper(content) AS content", "_trace_id AS source_trace_id")


def test_a_run_that_fails_between_outputs_and_lineage_leaves_nothing(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path), "up", SCHEMA)
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(ledger, "_write_lineage", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            ledger.run(rows, upper, batch="b1")
    assert ledger.outputs().collect() == [] and ledger.lineage().collect() == []
    for _ in range(2):  # the retry, and a repetition of what was done
        got = ledger.run(rows, upper, batch="b1").collect()
        assert sorted(r.content for r in got) == ["A", "B"]
    assert ledger.outputs().count() == 2 and ledger.lineage().count() == 2


def test_compacting_keeps_what_readers_see(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), "up", SCHEMA)
    for i in range(3):
        ledger.run(spark.createDataFrame([(str(i), "x"), ("0", "x")], SCHEMA).dropDuplicates(), upper)
    before = sorted(map(tuple, ledger.outputs().collect()))
    ledger.compact()
    assert len(ledger.batches()) == 1 and sorted(map(tuple, ledger.outputs().collect())) == before and len(before) == 3


def test_cut_tables_can_be_released(spark):
    import os

    cut = storage.cut_lineage(spark.range(10).toDF("x"))
    folder = cut.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    storage.release(cut)
    assert not os.path.exists(folder)
