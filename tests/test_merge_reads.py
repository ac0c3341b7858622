"""What building a graph reads again, and cleaning of whole replies."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as tx
from weftgraph.operators import kg

REPLY = '("entity"<|>alpha<|>t<|>d<|>Alpha)##("entity"<|>&lt;beta&gt;<|>t<|>d<|>&lt;beta&gt;)##("entity"<|>ghost<|>t<|>d<|>Ghost)##("relationship"<|>alpha<|>&lt;beta&gt;<|>uses<|>s<|>Alpha uses<|>0.9)<|COMPLETE|>'


def test_merging_reads_neither_chunks_nor_replies_again(spark, tmp_path):
    spark.createDataFrame([("c1", "Alpha uses <beta>.")], "chunk_id string, content string").write.parquet(f"{tmp_path}/chunks")
    spark.createDataFrame([("c1", REPLY)], "chunk_id string, reply string").write.parquet(f"{tmp_path}/replies")
    nodes, edges = kg.build(spark.read.parquet(f"{tmp_path}/chunks"), spark.read.parquet(f"{tmp_path}/replies"))
    assert not [f for t in (nodes, edges) for f in t.inputFiles() if str(tmp_path) in f]
    assert sorted((r.id, r.evidence_span) for r in nodes.collect()) == [("<BETA>", "<beta>"), ("ALPHA", "Alpha")]
    assert [(r.src, r.dst, r.relation_type, r.confidence) for r in edges.collect()] == [("<BETA>", "ALPHA", "uses", 0.9)]


def test_parts_are_cleaned_as_by_themselves(spark):
    rows = ["a", " 'b' <|>\t\"c\" ", "&lt;|&gt;<|>&amp;amp;<|>", "x\x01y<|><|>\x1f&quot;z&quot;", "<|>"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    df = df.select("t", tx.clean_parts(F.col("t"), "<|>").alias("got"), F.split("t", r"<\|>").alias("parts")).select("t", "got", F.posexplode("parts").alias("at", "p"))
    for r in df.select("got", "at", tx.clean(F.col("p")).alias("own")).collect():
        assert r.got[r.at] == r.own


@pytest.mark.parametrize("text, language", [("", "en"), ("中文ab", "zh"), ("中文abc", "en"), ("a中b文", "zh"), ("123", "en"), (None, "en")])
def test_language_by_letters(spark, text, language):
    assert spark.createDataFrame([(text,)], "t string").select(tx.main_language(F.col("t"))).first()[0] == language
