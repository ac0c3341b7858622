"""Lookup of biological entries: query routing as expressions, retrieval as joins.

A source is a table that the caller supplies (an export or a cache of replies);
network lookups plug in as a model-like callable and are off by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCES = ("uniprot", "ncbi", "rnacentral", "interpro")
AMINO = "(?i)^[ACDEFGHIKLMNPQRSTVWY\\s]+$"
DNA, RNA = "^[ACGTNacgtn\\s]+$", "^[ACGTUNacgtun\\s]+$"


def route(source: str, query: Column) -> Column:
    """The kind of lookup that a query asks of a source; null for a blank query."""
    q = F.trim(F.coalesce(query, F.lit("")))
    sequence = F.regexp_replace(q, "^>[^\n]*\n?", "")
    fasta = q.startswith(">")
    if source == "uniprot":
        kind = F.when(fasta | sequence.rlike(AMINO), "sequence").when(q.rlike("(?i)^[A-Z][A-Z0-9]{5,9}$"), "accession").otherwise("keyword")
    elif source == "ncbi":
        kind = F.when(fasta | (sequence.rlike(DNA) & (F.length(sequence) > 3)), "sequence").when(q.rlike("^[0-9]+$"), "gene_id").when(q.rlike("^[A-Z]{2}_[0-9]+(\\.[0-9]+)?$") | q.rlike("^[A-Z]{1,2}[0-9]{5,8}(\\.[0-9]+)?$"), "accession").otherwise("keyword")
    elif source == "rnacentral":
        kind = F.when(fasta | (sequence.rlike(RNA) & (F.length(sequence) > 3)), "sequence").when(q.rlike("^URS[0-9A-F]{10}(_[0-9]+)?$"), "rna_id").otherwise("keyword")
    elif source == "interpro":
        kind = F.lit("accession")
    else:
        raise ValueError(f"unknown source {source}; known: {', '.join(SOURCES)}")
    return F.when(q == "", None).otherwise(kind)


def molecule_type(accession: Column) -> Column:
    """DNA, RNA or protein from an accession's prefix."""
    prefix = F.upper(F.left(accession, F.lit(3)))
    return F.when(prefix.isin("NM_", "XM_", "NR_", "XR_"), "RNA").when(prefix.isin("NP_", "XP_", "YP_", "WP_"), "protein").when(prefix.isin("NC_", "NT_", "NG_", "NW_", "NZ_"), "DNA")


def rna_digest(sequence: Column) -> Column:
    """MD5 of the upper-case sequence in DNA letters, as the RNA archive keys it."""
    plain = F.regexp_replace(F.regexp_replace(sequence, "^>[^\n]*\n?", ""), "\\s+", "")
    return F.md5(F.translate(F.upper(plain), "U", "T").cast("binary"))


def search(seeds: DataFrame, reference: DataFrame, source: str) -> DataFrame:
    """Seeds (content) joined to entries (lookup_kind, lookup_key, …); seeds without an entry are dropped."""
    routed = seeds.withColumn("lookup_kind", route(source, F.col("content")))
    key = F.when(F.col("lookup_kind") == "sequence", rna_digest(F.col("content")) if source == "rnacentral" else F.upper(F.regexp_replace(F.regexp_replace("content", "^>[^\n]*\n?", ""), "\\s+", ""))).when(F.col("lookup_kind") == "keyword", F.lower(F.trim("content"))).otherwise(F.trim("content"))
    return routed.withColumn("lookup_key", key).join(reference, ["lookup_kind", "lookup_key"]).withColumn("data_source", F.lit(source)).withColumnRenamed("content", "_search_query")
