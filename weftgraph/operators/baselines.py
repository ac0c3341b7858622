"""Relational parts of simpler generators: paths, pairs and string-split parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.graph import symmetric


def simple_paths(edges: DataFrame, *, sources: int | None = None, limit: int | None = None) -> DataFrame:
    """Paths of four different nodes (a, b, c, d), from every start or the first ``sources`` of them.

    Only edges whose two ends both have further neighbours can stand in the
    middle, so a half path goes on to a whole one unless all that is left closes
    a triangle; neighbours of a hub don't meet each other.
    """
    e = symmetric(edges.filter("src != dst")).distinct()
    hop = lambda x, y: e.select(F.col("id").alias(x), F.col("other").alias(y))
    first = hop("a", "b")
    if sources is not None:
        first = first.join(first.select("a").distinct().orderBy("a").limit(sources), "a", "left_semi")
    inner = e.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    middle = hop("b", "c").join(inner.select(F.col("id").alias("b")), "b", "left_semi").join(inner.select(F.col("id").alias("c")), "c", "left_semi")
    out = first.join(middle, "b").filter("c != a").join(hop("c", "d"), "c").filter("d != a AND d != b").select("a", "b", "c", "d")
    return out if limit is None else out.orderBy("a", "b", "c", "d").limit(limit)


#: Entities of one block: a row lists at most this number squared of pairs at once.
BLOCK = 64


def entity_pairs(entities: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, one, two): of all unordered pairs of a document's entities the ``most`` with the smallest hash.

    Every pair is hashed. A document's sorted entities are cut into blocks, and
    each block meets itself and the later ones in a row of its own, so a
    document of very many entities is spread over tasks. A row keeps its
    ``most`` best pairs; the best of those are the document's.
    """
    held = entities.groupBy("doc_id").agg(F.sort_array(F.collect_set("entity")).alias("e")).filter("size(e) > 1")
    held = held.withColumn("last", F.expr(f"(size(e) - 1) div {BLOCK}"))
    met = held.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("i")).select("*", F.explode(F.sequence("i", "last")).alias("j"))
    block = lambda k: F.slice("e", (F.col(k) * BLOCK + 1).cast("int"), F.lit(BLOCK))
    met = met.select("doc_id", "i", "j", block("i").alias("one"), block("j").alias("two")).repartition("doc_id", "i", "j")
    hashed = lambda x, y: F.struct(F.md5(F.concat_ws("|", x, y).cast("binary")).alias("hash"), x.alias("one"), y.alias("two"))
    pairs = F.flatten(F.transform("one", lambda x: F.transform(F.filter("two", lambda y: y > x), lambda y: hashed(x, y))))
    best = met.select("doc_id", F.explode(F.slice(F.sort_array(pairs), 1, most)).alias("p")).select("doc_id", "p.*")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("hash", "one", "two"))
    return best.withColumn("n", rank).filter(F.col("n") <= most).select("doc_id", "one", "two")


def dedupe_by_hash(docs: DataFrame) -> DataFrame:
    """One document per content hash: the smallest id."""
    return docs.groupBy(F.md5(F.col("text").cast("binary")).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"))


def split_reply(reply: Column, question_mark: str, answer_mark: str) -> tuple[Column, Column]:
    """Question and answer from a reply with plain marks such as ``Question:`` and ``Answer:``."""
    body = F.element_at(F.split(reply, "\\Q" + question_mark + "\\E", 2), -1)
    parts = F.split(body, "\\Q" + answer_mark + "\\E", 2)
    return F.trim(parts[0]), F.trim(F.get(parts, F.lit(1)))
