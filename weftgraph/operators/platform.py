"""Browsing of runs and samples as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as tx


def scan_runs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of every ``root/{run_id}/generate/*.jsonl`` with run_id and key."""
    raw = spark.read.schema(schema).json(f"{root.rstrip('/')}/*/generate/*.jsonl").select("*", F.col("_metadata.file_path").alias("file"))
    return raw.withColumn("run_id", F.element_at(F.split("file", "/"), -3)).withColumn("sample_id", sample_id(F.col("run_id"), F.coalesce("_trace_id", F.md5(F.to_json(F.struct("*"))))))


def sample_id(run: Column, key: Column) -> Column:
    return F.left(F.sha1(F.concat_ws(":", run, key).cast("binary")), F.lit(16))


def run_stats(samples: DataFrame) -> DataFrame:
    """Per run: samples, nodes, edges, evidence coverage and dangling edges of (run_id, sample_id, nodes, edges)."""
    n = samples.select("run_id", "sample_id", F.explode_outer("nodes").alias("n")).groupBy("run_id").agg(F.count_distinct("sample_id").alias("n_samples"), F.count("n").alias("n_nodes"), F.count(F.when(F.coalesce("n.evidence_span", F.lit("")) != "", 1)).alias("n_evidence"))
    ids = F.transform("nodes", lambda x: x["id"])
    e = samples.select("run_id", ids.alias("ids"), F.explode("edges").alias("e")).groupBy("run_id").agg(F.count("*").alias("n_edges"), F.count(F.when(~F.array_contains("ids", F.col("e.src")) | ~F.array_contains("ids", F.col("e.dst")), 1)).alias("n_dangling"))
    out = n.join(e, "run_id", "left").na.fill(0, ["n_edges", "n_dangling"])
    return out.withColumn("evidence_coverage", F.when(F.col("n_nodes") > 0, F.round(F.col("n_evidence") / F.col("n_nodes"), 6)).otherwise(0.0))


def type_counts(samples: DataFrame) -> DataFrame:
    return samples.select("run_id", F.explode("nodes").alias("n")).groupBy("run_id", F.col("n.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))


def list_samples(samples: DataFrame, *, search: str = "", has_image: bool | None = None, has_graph: bool | None = None, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """A page (ordered by sample_id, 140-character preview) and the total of matching rows."""
    hit = samples
    if search:
        hit = hit.filter(F.contains(F.lower(F.concat_ws("\n", "question", "answer")), F.lit(search.lower())))
    for flag, c in ((has_image, "img_path"), (has_graph, "sub_graph")):
        if flag is not None:
            there = F.coalesce(F.col(c), F.lit("")) != ""
            hit = hit.filter(there if flag else ~there)
    page = hit.orderBy("sample_id").offset(offset).limit(limit)
    return page.select("sample_id", F.left("question", F.lit(140)).alias("preview")), hit.agg(F.count("*").alias("total"))


def evidence_items(samples: DataFrame) -> DataFrame:
    """(sample_id, kind, unit, span): node spans, then edge spans."""
    n = samples.select("sample_id", F.explode("nodes").alias("x")).select("sample_id", F.lit("node").alias("kind"), F.col("x.id").alias("unit"), F.explode(tx.source_ids(F.coalesce("x.evidence_span", F.lit("")))).alias("span"))
    e = samples.select("sample_id", F.explode("edges").alias("x")).select("sample_id", F.lit("edge").alias("kind"), F.concat_ws("|", "x.src", "x.dst").alias("unit"), F.explode(tx.source_ids(F.coalesce("x.evidence_span", F.lit("")))).alias("span"))
    return n.unionByName(e)


def evidence_contexts(items: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items with the chunk their unit came from (unit, chunk_id) and its content; null where unknown."""
    return items.join(sources, "unit", "left").join(chunks.select("chunk_id", "content"), "chunk_id", "left")


def token_estimate(texts: DataFrame, factor: int = 50) -> DataFrame:
    """Tokens of 512-character windows of ``content``, and the usage estimate."""
    from weftgraph.functions.split import fixed_windows

    w = texts.select(F.explode(fixed_windows(F.col("content"))).alias("w"))
    return w.agg(F.coalesce(F.sum(tx.token_count(F.col("w"))), F.lit(0)).alias("tokens")).withColumn("usage", F.col("tokens") * factor)
