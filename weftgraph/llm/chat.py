"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Logs often hold every state of a conversation: each snapshot repeats the one
before and adds turns. Every conversation gets rolling hashes of its turn
prefixes (position, role and text); a conversation whose whole hash is a proper
prefix hash of another one is such a snapshot and goes, by an anti join. Of
equal conversations the one with the smallest id stays. What is left is
rendered turn by turn as ChatML.

A rolling hash is the running exclusive or of hashes that hold the turn's
position, in two independent 64-bit halves, so it can be built in two levels:
per block of turns, then over the blocks. A conversation that holds a third of
all rows is thereby split over its blocks. First turns that many conversations
share are cut to one row per prefix, with map-side combining, before the join.

Defined cases: null roles and texts count as empty; turns are in the order of
turn (nulls first), then role, then text, so ties and repeated rows have a
fixed place; conversations with a null id are left out; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import Workspace

#: Turn numbers per block of the two-level rolling hash.
BLOCK = 4096


def _fold(*halves: str) -> list[Column]:
    return [F.bit_xor(h).alias(h) for h in halves]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (1..), role, text and the rolling prefix hash (h1, h2) of every turn."""
    t = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    over_blocks = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(over_blocks), F.lit(0)).alias("before"))
    t = t.withColumn("rn", F.row_number().over(in_block)).join(blocks, ["conv_id", "block"]).withColumn("pos", F.col("before") + F.col("rn"))
    t = t.withColumn("x1", F.xxhash64("pos", "role", F.length("role"), "text")).withColumn("x2", F.xxhash64(F.lit(7), "text", F.length("text"), "role", "pos"))
    sums = t.groupBy("conv_id", "block").agg(*_fold("x1", "x2"))
    prior = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(x).over(over_blocks), F.lit(0)).alias(f"p{x}") for x in ("x1", "x2")])
    running = in_block.rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(prior, ["conv_id", "block"])
    h1, h2 = (F.bit_xor(x).over(running).bitwiseXOR(F.col(f"p{x}")) for x in ("x1", "x2"))
    return t.select("conv_id", "pos", "role", "text", h1.alias("h1"), h2.alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, pos, role, text) of conversations that no longer one continues."""
    hashed = Workspace(turns.sparkSession, "chat").table("prefixes", prefix_hashes(turns))
    size = hashed.groupBy("conv_id").agg(F.max("pos").alias("pos"))
    whole = hashed.join(size, ["conv_id", "pos"]).groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = hashed.join(size.withColumnRenamed("pos", "n"), "conv_id").filter("pos < n").select("pos", "h1", "h2").distinct()
    kept = whole.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv_id")
    return hashed.join(kept, "conv_id", "left_semi").select("conv_id", "pos", "role", "text")


def render_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos and the ChatML of each turn; concatenated by pos they are the conversation."""
    return turns.select("conv_id", F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")).alias("chatml"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_turns(maximal(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id
), u AS (SELECT min(conv_id) AS conv_id, turns FROM c GROUP BY turns
), prefixes AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM u)
), kept AS (SELECT conv_id FROM u WHERE turns NOT IN (SELECT turns FROM prefixes))
SELECT conv_id, CAST(pos AS BIGINT) AS pos, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS chatml
FROM t WHERE conv_id IN (SELECT conv_id FROM kept)
"""
