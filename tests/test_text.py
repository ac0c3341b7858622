from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import split as sp
from weftgraph.functions import text as tx


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column.alias("v")).first().v


@pytest.mark.parametrize("text, lang", [("hello", "en"), ("", "en"), ("123", "en"), ("这是中文", "zh"), ("这是 ab", "zh"), ("这 abc", "en")])
def test_language(spark, text, lang):
    assert value(spark, tx.main_language(F.col("t")), t=text) == lang


@pytest.mark.parametrize("raw, out", [(' "a\nb" ', "ab"), ("'x'", "x"), ("a&amp;b &lt;c&gt;", "a&b <c>"), ("a\x01b\x7f", "ab"), ("a  b", "a  b")])
def test_clean(spark, raw, out):
    assert value(spark, tx.clean(F.col("t")), t=raw) == out


def test_evidence(spark):
    assert value(spark, tx.evidence_supported(F.col("e"), F.col("s")), e="big  cat", s="A big cat sat") is True
    assert value(spark, tx.evidence_supported(F.col("e"), F.col("s")), e="", s="A big cat sat") is False
    assert value(spark, tx.evidence_supported(F.col("e"), F.col("s")), e="Big cat", s="A big cat sat") is False


@pytest.mark.parametrize("raw, out", [("<think>x</think>y", "y"), ("x</think> y", "y"), ("<think>only</think>", "<think>only</think>"), ("plain", "plain")])
def test_think_tags(spark, raw, out):
    assert value(spark, tx.without_think(F.col("t")), t=raw) == out


def test_tags_and_json(spark):
    assert value(spark, tx.tag(F.col("t"), "answer"), t='<answer>\n"yes" </answer>') == "yes"
    assert value(spark, tx.tag(F.col("t"), "answer"), t="none") is None
    for raw in ('{"a": 1}', 'say ```json\n{"a": 1}\n```', 'so {"a": 1} it is'):
        assert value(spark, F.to_json(tx.json_payload(F.col("t"))), t=raw) == '{"a":1}'


@pytest.mark.parametrize("raw, ok", [("1", True), ("-0.2", True), (".5", True), ("1.", False), ("1e3", False), ("", False)])
def test_is_float(spark, raw, ok):
    assert value(spark, tx.is_float(F.col("t")), t=raw) is ok


def test_lines(spark):
    assert value(spark, tx.ocr_lines(F.col("t")), t="Pump\npump\n12\npage 3\nab\nx-axis\nValve one") == "Pump\nValve one"
    assert value(spark, tx.file_stem(F.col("t")), t="/a/b/c.tar.gz") == "c.tar"
    assert value(spark, tx.image_path(F.col("t")), t='![x](a/b.png "t")') == "a/b.png"
    assert value(spark, tx.image_path(F.col("t")), t="<img src='q.jpg'>") == "q.jpg"


def test_character_splitter():
    text = "This is a sentence.\n\nThis is another, longer sentence.\n\nShort."
    assert sp.CharacterSplitter(size=25, overlap=5).split(text) == text.split("\n\n")


def test_recursive_splitter_bounds():
    text = "\n\n".join(" ".join(f"word{i}" for i in range(40)) for _ in range(5))
    chunks = sp.recursive(150, 10).split(text)
    assert all(0 < len(c) <= 150 for c in chunks)
    assert set(" ".join(chunks).split()) == set(text.split())


def test_chinese_splitter():
    text = "今天天气很好。我们去公园玩吧！你想去吗？" * 6 + "\n\n\n第二段落在这里。"
    chunks = sp.chinese(60, 0).split(text)
    assert all(len(c) <= 60 and "\n\n\n" not in c for c in chunks)
    assert "".join(chunks).replace("\n", "") == text.replace("\n", "")
    assert sp.chinese(5, 0).split("没有分隔符的长文本") == ["没有分隔符的长文本"]


def test_markdown_splitter():
    chunks = sp.markdown(40, 0).split("intro text here\n# One\nbody of one goes on\n# Two\nbody of two goes on")
    assert any(c.startswith("# One") for c in chunks) and any(c.startswith("# Two") for c in chunks)


def test_chunk_keeps_other_types(spark):
    docs = spark.createDataFrame([("a", "text", "one two", "f"), ("b", "image", None, "g")], "_trace_id string, type string, content string, img_path string")
    rows = {r.doc_trace_id: r for r in sp.chunk(docs).collect()}
    assert rows["a"].content == "one two" and rows["a"].length == 2
    assert rows["b"].type == "image" and '"img_path":"g"' in rows["b"].metadata


def test_rows_without_a_type_stay(spark):
    docs = spark.createDataFrame([("a", None, "one two")], "_trace_id string, type string, content string")
    assert [(r.doc_trace_id, r.content) for r in sp.chunk(docs).collect()] == [("a", "one two")]
