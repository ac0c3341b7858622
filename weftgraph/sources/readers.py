"""Readers: one DataFrame per format with type, content and path columns."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as tx
from weftgraph.sources import rdf

TYPES = ("text", "image", "table", "equation", "protein", "dna", "rna")
SUFFIXES = ("jsonl", "json", "txt", "csv", "md", "pdf", "parquet", "pickle", "rdf", "owl", "ttl", "nt")


def validate(df: DataFrame, text_column: str = "content") -> DataFrame:
    """Known types only (an unknown one is an error); text rows need text that isn't blank."""
    if "type" not in df.columns:
        raise ValueError("the column type is required")
    known = F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown document type: "), F.coalesce("type", F.lit("null")))).cast("string"))
    body = F.col(text_column) if text_column in df.columns else F.lit(None).cast("string")
    return df.withColumn("type", known).filter((F.col("type") != "text") | (F.trim(F.coalesce(body.cast("string"), F.lit(""))) != ""))


def _path(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("path"))


def read_csv(spark: SparkSession, path: str | list[str], text_column: str = "content") -> DataFrame:
    return validate(_path(spark.read.option("recursiveFileLookup", True).csv(path, header=True, multiLine=True, escape='"')), text_column)


def read_json(spark: SparkSession, path: str | list[str], text_column: str = "content", *, lines: bool = True) -> DataFrame:
    """JSON lines, or whole-file arrays; an object as content becomes its JSON text."""
    df = _path(spark.read.option("recursiveFileLookup", True).json(path, multiLine=not lines))
    if text_column in df.columns and df.schema[text_column].dataType.typeName() in ("struct", "map", "array"):
        df = df.withColumn(text_column, F.to_json(text_column))
    return validate(df, text_column)


def read_parquet(spark: SparkSession, path: str | list[str], text_column: str = "content") -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return validate(_path(spark.read.option("recursiveFileLookup", True).parquet(*paths)), text_column)


def read_text(spark: SparkSession, path: str | list[str], text_column: str = "content") -> DataFrame:
    """Each file is one document."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("value").alias(text_column), F.lit("text").alias("type"), F.col("_metadata.file_path").alias("path"))
    return validate(raw, text_column)


def read_pickle(spark: SparkSession, path: str | list[str], schema: str, text_column: str = "content", *, trusted: bool = False) -> DataFrame:
    """Lists of dicts; files that can't be read are skipped. Unpickling runs code, so the caller has to vouch for the files."""
    if not trusted:
        raise PermissionError("pickle files execute code when read; pass trusted=True for files of your own")
    names = [f.split()[0] for f in schema.split(",")]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        for batch in batches:
            for body in batch["content"]:
                try:
                    rows = pickle.loads(body)
                except Exception:
                    continue
                if isinstance(rows, list):
                    yield pd.DataFrame([{k: r.get(k) for k in names} for r in rows if isinstance(r, dict)], columns=names)

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return validate(raw.select("content").mapInPandas(load, schema), text_column)


def read_rdf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One text document per subject of Turtle, N-Triples, RDF/XML and OWL files, whatever their suffix."""
    return rdf.subjects(rdf.read_triples(spark, path))


def read_pdf(spark: SparkSession, path: str | list[str], convert: Callable[[bytes], list[dict]] | None = None) -> DataFrame:
    """PDF through a converter that the caller brings: bytes to (type, content, img_path) parts; page geometry is dropped."""
    if convert is None:
        raise RuntimeError("reading PDF needs a converter function; none is bundled")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, body in zip(batch["path"], batch["content"], strict=True):
                folder = os.path.dirname(file)
                rows = [(p["type"], p.get("content"), os.path.join(folder, p["img_path"]) if p.get("img_path") else None, file) for p in convert(body)]
                yield pd.DataFrame(rows, columns=["type", "content", "img_path", "path"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return validate(raw.select("path", "content").mapInPandas(load, "type string, content string, img_path string, path string"))


def read_exported_dataset(spark: SparkSession, uri: str, root: str, text_column: str = "content", limit: int | None = None) -> DataFrame:
    """``hub://name:subset:split`` below a folder of exported Parquet; the limit comes before anything else."""
    name, subset, split, *_ = [*uri.split("://", 1)[-1].split(":"), "", ""]
    path = "/".join(x for x in (root.rstrip("/"), name, subset, split or "train") if x)
    df = spark.read.parquet(path)
    df = df.limit(limit) if limit is not None else df
    return df.withColumnRenamed(text_column, "content").withColumn("type", F.lit("text"))


def scan_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, *, modified_after: str | None = None) -> DataFrame:
    """(path, suffix, size, modified) of files below a path; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("modifiedAfter", modified_after) if modified_after else reader
    out = reader.load(path).select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.filter(F.col("suffix").isin(*suffixes))


def scan_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("suffix").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": read_csv, "jsonl": read_json, "json": lambda s, p, c="content": read_json(s, p, c, lines=False), "parquet": read_parquet, "txt": read_text, "md": read_text, "nt": lambda s, p, c="content": read_rdf(s, p), "rdf": lambda s, p, c="content": read_rdf(s, p), "owl": lambda s, p, c="content": read_rdf(s, p), "ttl": lambda s, p, c="content": read_rdf(s, p), "pdf": lambda s, p, c="content": read_pdf(s, p),
}


def read(spark: SparkSession, path: str, *, allowed: tuple[str, ...] | None = None, text_column: str = "content", limit: int | None = None, convert: Callable[[bytes], list[dict]] | None = None, pickle_schema: str | None = None) -> DataFrame:
    """Every readable file below ``path``, grouped by suffix, united, with ``_trace_id``.

    ``convert`` turns PDF files into parts. ``pickle_schema`` vouches for pickles
    and names their columns; without it a pickle file is an error, as is a PDF
    file without ``convert``. Only the suffixes that occur reach the driver.
    """
    found = scan_files(spark, path, allowed or SUFFIXES)
    there = sorted(r.suffix for r in found.select("suffix").distinct().collect())
    more = {"pdf": lambda s, p, c: read_pdf(s, p, convert)}
    if pickle_schema is not None:
        more |= dict.fromkeys(("pkl", "pickle"), lambda s, p, c: read_pickle(s, p, pickle_schema, c, trusted=True))
    if not there:
        raise FileNotFoundError(f"no file with a known suffix below {path}")
    if unknown := [x for x in there if x not in READERS | more]:
        raise ValueError(f"files of these kinds can't be read as they are: {', '.join(unknown)}; name them in allowed without these, or pass pickle_schema for pickles")
    out: DataFrame | None = None
    for suffix in there:
        # Spark lists the files of a kind itself, in either case of the suffix
        pattern = "*." + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)
        part = (READERS | more)[suffix](_Globbed(spark, pattern), path, text_column)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    assert out is not None
    if limit is not None:
        out = out.limit(limit)
    return out.withColumn("_trace_id", tx.trace_id("read-", *out.columns))


class _Globbed:
    """A session whose readers only take files of one name pattern."""

    def __init__(self, spark: SparkSession, pattern: str):
        self._spark, self._pattern = spark, pattern

    @property
    def read(self):
        return self._spark.read.option("pathGlobFilter", self._pattern).option("recursiveFileLookup", True)

    def __getattr__(self, name: str):
        return getattr(self._spark, name)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of GraphML files, attributes by their declared names."""
    from xml.etree import ElementTree

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for body in batch["content"]:
                root = ElementTree.fromstring(body)
                ns = root.tag.partition("}")[0] + "}" if "}" in root.tag else ""
                names = {k.get("id"): k.get("attr.name") for k in root.iter(f"{ns}key")}
                rows = []
                for kind in ("node", "edge"):
                    for x in root.iter(ns + kind):
                        data = {names.get(d.get("key"), d.get("key")): d.text or "" for d in x.findall(f"{ns}data")}
                        rows.append((kind, x.get("id"), x.get("source"), x.get("target"), data))
                yield pd.DataFrame(rows, columns=["kind", "id", "src", "dst", "data"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "kind string, id string, src string, dst string, data map<string,string>")
    at = lambda k, t: F.try_element_at("data", F.lit(k)).try_cast(t).alias(k)
    common = [at("description", "string"), at("source_id", "string"), at("length", "int"), at("loss", "double")]
    nodes = raw.filter("kind = 'node'").select("id", at("entity_type", "string"), *common)
    edges = raw.filter("kind = 'edge'").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *common)
    return nodes, edges


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML parts (one header, many bodies) as text lines; meant for graphs that are looked at."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda names: F.concat(*[F.concat(F.lit(f'<data key="{n}">'), esc(n), F.lit("</data>")) for n in names])
    n_names, e_names = ([c for c in f.columns if c not in ("id", "src", "dst")] for f in (nodes, edges))
    keys = "".join(f'<key id="{k}" for="all" attr.name="{k}" attr.type="string"/>' for k in sorted({*n_names, *e_names}))
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, "", f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">')], "part int, k string, value string")
    tail = spark.createDataFrame([(3, "", "</graph></graphml>")], "part int, k string, value string")
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("k"), F.concat(F.lit('<node id="'), esc("id"), F.lit('">'), data(n_names) if n_names else F.lit(""), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("|", "src", "dst").alias("k"), F.concat(F.lit('<edge source="'), esc("src"), F.lit('" target="'), esc("dst"), F.lit('">'), data(e_names) if e_names else F.lit(""), F.lit("</edge>")).alias("value"))
    head.unionByName(n).unionByName(e).unionByName(tail).orderBy("part", "k").coalesce(1).select("value").write.mode("overwrite").text(path)
