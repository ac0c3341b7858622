"""A corpus through five operators: toxicity, exact and near duplicates, benchmark leaks, packing.

``STAGES`` holds (name, function); each function takes the session, the
documents that its predecessor kept and the folder of the tables, and returns
the documents that stay with all their columns; the last returns the packed
pieces. ``ORACLE_SQL`` is None: the trained score and the packing plan have no
SQL form, so the tests hold ``run`` against a brute-force version.

Defined cases: null texts are empty ones and count as copies of each other, so
one of them stays; removal goes by row, so null ids, repeated rows and ids with
two texts are treated each by itself; without labels nothing is toxic; texts of
any length are taken whole and cut into several pieces; an empty table gives an
empty result; further columns of documents pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.common import Workspace
from weftgraph.llm.decontaminate import remove_contaminated
from weftgraph.llm.exact_dedup import remove_duplicates
from weftgraph.llm.ngram_join import remove_near_duplicates
from weftgraph.llm.packing import pack, tokenizer_path
from weftgraph.llm.toxicity import remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score 0.7 or more."""
    return remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the document with the largest id."""
    return remove_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a shingle similarity of 0.75 keeps the one with the smallest id."""
    return remove_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: one row per piece."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written and read again."""
    ws = Workspace(spark, "pipeline")
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = ws.table(name.replace(" ", "-"), stage(spark, out, sf_dir))
    return out
