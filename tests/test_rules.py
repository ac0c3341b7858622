"""Parsing and scoring rules on the cases that earlier versions had wrong, and the splitters against plain versions."""

from __future__ import annotations

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import split as sp
from weftgraph.functions import text as tx
from weftgraph.operators import generate, sample, tree


def reply(options, answer):
    return f"<qa_pair><question>Q</question><options>{options}</options><answer>{answer}</answer></qa_pair>"


FOUR = "A. a\nB. b\nC. c\nD. d"


def test_multi_choice_takes_one_letter_and_nothing_else(spark):
    cases = {reply(FOUR, "B"): "B", reply(FOUR, ' "B" '): "B", reply(FOUR, "Because"): None, reply(FOUR, "b"): None, reply(FOUR, "B."): None, reply(FOUR, "E"): None, reply("A. a\nB. b\nC. c", "A"): None, reply("A) a\nB. b\nC. c\nD. d", "A"): None, reply("A a\nnote\nB. b\nC. c\nD. d\nE. e\nA. again", "A"): "A"}
    rows = spark.createDataFrame(list(enumerate(cases)), "community_id int, reply string")
    found = {r.community_id: (r.answer, dict(r.options)) for r in generate.parse_multi_choice(rows).collect()}
    assert {i: a for i, (a, _) in found.items()} == {i: a for i, a in enumerate(cases.values()) if a}
    assert found[8][1] == {"A": "again", "B": "b", "C": "c", "D": "d"}


def test_multi_answer_splits_at_commas_and_takes_either_case(spark):
    cases = [(reply(FOUR, "a, C"), ["A", "C"]), (reply("X. a\nY b", "x,y"), ["X", "Y"]), (reply(FOUR, "A、C"), None), (reply(FOUR, "A, Z"), None), (reply(FOUR, " , "), None)]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "community_id int, reply string")
    assert {r.community_id: r.answers for r in generate.parse_multi_answer(rows).collect()} == {i: a for i, (_, a) in enumerate(cases) if a}


def test_all_entities_are_resolved(spark):
    texts = ["&eacute; &#233; &#xE9; &#34; &apos;", "&amp;lt; &lt;b&gt;", "no mark", "&notanentity; &amp", None, "&copy2024 &#128; &#0;"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.unescape(F.col("t")).alias("u")).collect()
    assert {r.i: r.u for r in rows} == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}


def test_node_ranking_counts_terms_inside_words_and_puts_the_seed_first(spark):
    near = spark.createDataFrame([("s", "s", 0), ("s", "a", 1), ("s", "b", 1)], "seed string, id string, distance int")
    nodes = spark.createDataFrame([("s", "", "plain"), ("a", "", "latencies and bandwidth limits"), ("b", "said", "none")], "id string, evidence_span string, description string")
    rows = {r.id: (r.score, r["rank"]) for r in sample.rank_nodes(near, nodes).collect()}
    # bandwidth, limit; the seed leads whatever it scores
    assert rows == {"s": (0.6, 1), "b": (1.5, 2), "a": (0.8, 3)}


def test_candidates_are_compared_with_the_node_they_hang_on(spark):
    nodes = spark.createDataFrame([("seed", "alpha words", "", "", "{}"), ("mid", "copper cable", "", "", "{}"), ("far", "Copper CABLE here", "", "", "{}")], "id string, description string, evidence_span string, source_id string, metadata string")
    edges = spark.createDataFrame([("seed", "mid", "near", "", ""), ("mid", "far", "near", "quoted", "")], "src string, dst string, relation_type string, evidence_span string, source_id string")
    selected = spark.createDataFrame([("seed", "seed", 0), ("seed", "mid", 1)], "seed string, id string, depth int")
    [c] = sample.candidates(selected, nodes, edges).collect()
    assert (c.parent, c.id, c.score) == ("mid", "far", 0.44)


def pack(parts, glue, size, overlap):
    """Greedy runs, by trying every start."""
    width = lambda run: len(glue.join(run))
    out, run = [], []
    for part in parts:
        if run and width([*run, part]) > size:
            out.append(glue.join(run))
            while run and (width(run) > overlap or width([*run, part]) > size):
                run = run[1:]
        run = [*run, part]
    return [*out, glue.join(run)]


@pytest.mark.parametrize("glue, size, overlap", [("", 10, 0), ("", 12, 5), (" ", 12, 5), ("--", 9, 9), (" ", 3, 1)])
def test_packing_equals_greedy_runs(glue, size, overlap):
    rng = random.Random(size)
    for _ in range(300):
        parts = ["x" * rng.randint(1, 6) for _ in range(rng.randint(1, 12))]
        assert list(sp.Splitter((" ",), size, overlap).pack(parts, glue)) == pack(parts, glue, size, overlap)


def test_recursive_chunks_hold_all_words_in_order():
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice(("word", "longerword" * 3, " ", "\n", "\n\n", " ")) for _ in range(80))
        chunks = sp.recursive(40, 0).split(text)
        assert all(len(c) <= 40 for c in chunks)
        assert "".join(re.sub(r"\s", "", c) for c in chunks) == re.sub(r"\s", "", text)


MARKDOWN = """intro line

# 1 Part
para one
more

Table 1: data

<table>
<tr><td>1</td></tr>

</table>
after

![x](a/b.png "t")
note here

Figure 2: shown
tail
## Sub
not a caption

<TABLE><tr></tr></table>
<img src='c.png'> rest
no caption behind
<table>open
to the end"""


def test_markdown_parts():
    parts = tree.parse_markdown(MARKDOWN)
    assert [(p["type"], p["title"]) for p in parts] == [
        ("text", "Document"), ("section", "# 1 Part"), ("text", "# 1 Part"), ("table", "# 1 Part"), ("text", "# 1 Part"), ("image", "# 1 Part"),
        ("section", "## Sub"), ("text", "## Sub"), ("table", "## Sub"), ("image", "## Sub"), ("text", "## Sub"), ("table", "## Sub"),
    ]
    table, image = parts[3], parts[5]
    assert table["caption"] == ["Table 1: data"] and table["body"] == "<table>\n<tr><td>1</td></tr>\n\n</table>"
    assert (image["img_path"], image["note"], image["caption"]) == ("a/b.png", "note here", ["Figure 2: shown", "tail"])
    assert parts[2]["content"] == "para one\nmore" and parts[8]["caption"] == [] and parts[9]["img_path"] == "c.png"
    assert parts[10]["content"] == "no caption behind" and parts[11]["body"] == "<table>open\nto the end"
    assert tree.parse_markdown(None) == [] == tree.parse_markdown("\n \n")


def test_image_paths_agree_between_lines_and_documents(spark):
    lines = ["![x](a.png)", '![x](a.png "t")', "![x](a b.png)", "<img alt='' src=\"d/e.png\">", "text", "![](x.png) tail"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", tx.image_path(F.col("x")).alias("p")).collect()
    assert {r.i: r.p for r in rows} == {i: (tree.parse_markdown(x)[0]["img_path"] if tree.parse_markdown(x)[0]["type"] == "image" else "") for i, x in enumerate(lines)}
