"""RDF in three syntaxes gives equal tables; the parsers on the corners of the syntaxes."""

from __future__ import annotations

import pytest

from weftgraph.sources import rdf, readers

TURTLE = '''@prefix ex: <http://e.org/> .
@base <http://e.org/> .
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
# a comment
ex:alpha a ex:Thing ; rdfs:label "Alpha"@en , "line\\n\\u00e9" ; ex:size 42 ; ex:near <beta> , ex:gamma.x ; .
<beta> ex:said """long "quoted" text""" ; ex:ok true ; ex:weight -1.5e3 .
'''
TRIPLES = """<http://e.org/alpha> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e.org/Thing> .
<http://e.org/alpha> <http://www.w3.org/2000/01/rdf-schema#label> "Alpha"@en .
<http://e.org/alpha> <http://www.w3.org/2000/01/rdf-schema#label> "line\\n\\u00e9" .
<http://e.org/alpha> <http://e.org/size> "42"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://e.org/alpha> <http://e.org/near> <http://e.org/beta> .
<http://e.org/alpha> <http://e.org/near> <http://e.org/gamma.x> .
<http://e.org/beta> <http://e.org/said> "long \\"quoted\\" text" .
<http://e.org/beta> <http://e.org/ok> "true"^^<http://www.w3.org/2001/XMLSchema#boolean> .
<http://e.org/beta> <http://e.org/weight> "-1.5e3"^^<http://www.w3.org/2001/XMLSchema#double> .
"""
XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:ex="http://e.org/" xml:base="http://e.org/">
 <ex:Thing rdf:about="alpha" ex:size="42">
  <rdfs:label xml:lang="en">Alpha</rdfs:label><rdfs:label>line
&#233;</rdfs:label>
  <ex:near><rdf:Description rdf:about="beta"><ex:said>long "quoted" text</ex:said><ex:ok>true</ex:ok><ex:weight>-1.5e3</ex:weight></rdf:Description></ex:near>
  <ex:near rdf:resource="gamma.x"/>
 </ex:Thing>
</rdf:RDF>
"""


def test_three_syntaxes_give_equal_tables(spark, tmp_path):
    tables = []
    for name, text in (("a.ttl", TURTLE), ("b.nt", TRIPLES), ("c.owl", XML)):
        (tmp_path / name).write_text(text)
        rows = readers.read_rdf(spark, str(tmp_path / name)).collect()
        tables.append(sorted((r.type, r.id, r.content, sorted(r.properties.items())) for r in rows))
    assert tables[0] == tables[1] == tables[2]
    assert [r[1] for r in tables[0]] == ["http://e.org/alpha", "http://e.org/beta"]
    assert tables[0][0][2] == "42 Alpha line\né"


def test_files_are_united_and_found_by_read(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix e: <http://e.org/> . e:x e:p 'one' . _:b e:p 'left' .")
    (tmp_path / "b.ttl").write_text("@prefix e: <http://e.org/> . e:x e:p 'two' . _:b e:p 'right' .")
    rows = {r.id: r.content for r in readers.read(spark, str(tmp_path)).collect()}
    assert rows.pop("http://e.org/x") == "one two"
    assert sorted(rows.values()) == ["left", "right"]  # blank nodes of one name in two files


def triples(text):
    return list(rdf.Turtle("@prefix e: <http://e.org/> . " + text, scope="f-").triples())


def test_blank_nodes_and_collections():
    e, r = "http://e.org/", rdf.RDF
    assert triples("e:s e:p [ e:q 1 ; e:r [] ] .") == [("_:f-g1", e + "q", "1", True), ("_:f-g1", e + "r", "_:f-g2", False), (e + "s", e + "p", "_:f-g1", False)]
    assert triples("e:s e:p ( 'a' e:b ) , () .") == [
        ("_:f-g1", r + "first", "a", True), ("_:f-g1", r + "rest", "_:f-g2", False), ("_:f-g2", r + "first", e + "b", False), ("_:f-g2", r + "rest", r + "nil", False),
        (e + "s", e + "p", "_:f-g1", False), (e + "s", e + "p", r + "nil", False),
    ]
    assert triples("[ e:p 1 ] . _:x e:p _:y.z .") == [("_:f-g1", e + "p", "1", True), ("_:f-x", e + "p", "_:f-y.z", False)]
    assert triples("e:a\\,b e:p '' , '''it's''' , 1.5 .") == [(e + "a,b", e + "p", "", True), (e + "a,b", e + "p", "it's", True), (e + "a,b", e + "p", "1.5", True)]


@pytest.mark.parametrize("text", ["e:s e:p", "e:s e:p 'open .", "e:s e:p [ e:q 1 .", "e:s ; e:p 1 .", "{ e:s e:p 1 }"])
def test_broken_turtle_is_an_error(text):
    with pytest.raises((ValueError, KeyError)):
        triples(text)


def test_lists_and_nested_parts_of_xml():
    body = b"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e.org/">
    <rdf:Description rdf:nodeID="n"><e:p rdf:parseType="Collection"><e:T rdf:about="http://e.org/a"/></e:p><e:q rdf:parseType="Resource"><e:r>x</e:r></e:q><rdf:li>one</rdf:li><rdf:li rdf:nodeID="n"/></rdf:Description></rdf:RDF>"""
    e, r = "http://e.org/", rdf.RDF
    assert set(rdf.RdfXml(body, scope="f-").triples()) == {
        ("http://e.org/a", r + "type", e + "T", False), ("_:f-g1", r + "first", "http://e.org/a", False), ("_:f-g1", r + "rest", r + "nil", False), ("_:f-n", e + "p", "_:f-g1", False),
        ("_:f-g2", e + "r", "x", True), ("_:f-n", e + "q", "_:f-g2", False), ("_:f-n", r + "_1", "one", True), ("_:f-n", r + "_2", "_:f-n", False),
    }


def test_pickles_and_pdfs_are_named_not_skipped(spark, tmp_path):
    import pickle

    (tmp_path / "x.pickle").write_bytes(pickle.dumps([{"type": "text", "content": "p"}]))
    with pytest.raises(ValueError, match="pickle"):
        readers.read(spark, str(tmp_path))
    assert [r.content for r in readers.read(spark, str(tmp_path), pickle_schema="type string, content string").collect()] == ["p"]
    (tmp_path / "y.PDF").write_bytes(b"%PDF")
    rows = readers.read(spark, str(tmp_path), pickle_schema="type string, content string", convert=lambda body: [{"type": "text", "content": f"{len(body)} bytes"}]).collect()
    assert sorted(r.content for r in rows) == ["4 bytes", "p"]
