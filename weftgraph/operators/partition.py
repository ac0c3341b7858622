"""Communities of a graph: growth from seeds, around anchors, and by modularity.

All methods take nodes(id, ...) and undirected edges(src, dst, ...) and give
(community_id, nodes array<string>, edges array<struct<src, dst>>). Order is by
hash of seed and unit, or by loss, so results don't depend on partitioning. No
step gathers a giant component; see :mod:`growth`, which takes ``block_units``
too, and :mod:`leiden`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators import graph, leiden as modularity
from weftgraph.operators.growth import Rule, around_anchors, grow
from weftgraph.sources.storage import cut_lineage

ORDERS = ("random", "min_loss", "max_loss")
#: Entity types that are modalities of their own.
SHOWN = ("image", "table", "video")


def bfs(nodes: DataFrame, edges: DataFrame, *, max_units: int = 1, seed: int = 42, **blocks) -> DataFrame:
    """Breadth first: all unused edges of a node are next."""
    return grow(nodes, edges, Rule("bfs", max_units, seed=seed), **blocks)


def dfs(nodes: DataFrame, edges: DataFrame, *, max_units: int = 1, seed: int = 42, **blocks) -> DataFrame:
    """Depth first: the first unused edge of a node is next."""
    return grow(nodes, edges, Rule("dfs", max_units, seed=seed), **blocks)


def ece(nodes: DataFrame, edges: DataFrame, *, max_units: int = 10, min_units: int = 1, max_tokens: int = 10240, order: str = "random", seed: int = 42, **blocks) -> DataFrame:
    """Units by loss; a community stops at ``max_units`` units or once it holds ``max_tokens`` tokens."""
    if order not in ORDERS:
        raise ValueError(f"unknown order {order}")
    return grow(nodes, edges, Rule("ece", max_units, min_units, max_tokens, order, seed), **blocks)


def leiden(nodes: DataFrame, edges: DataFrame, *, max_size: int | None = 20, use_lcc: bool = False, seed: int = 42) -> DataFrame:
    """Modularity communities of linked nodes, cut to ``max_size`` members in the order of their ids (None or 0: not cut)."""
    if use_lcc:
        nodes, edges = graph.largest_component(nodes, edges)
    ids = nodes.select(F.col("id").cast("string").alias("id")).distinct()
    pairs = graph.canonical(edges.select(F.col("src").cast("string"), F.col("dst").cast("string"))).filter("src != dst").distinct()
    pairs = cut_lineage(pairs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    members = modularity.communities(pairs, seed=seed)
    members = cut_lineage(graph.split_large(members, max_size) if max_size else members.withColumn("part", F.lit(0).cast("bigint")))
    name = F.concat_ws("#", "community", F.col("part").cast("string")).alias("community_id")
    at = lambda c: members.select(F.col("id").alias(c), F.struct("community", "part").alias(f"at_{c}"))
    inside = pairs.join(at("src"), "src").join(at("dst"), "dst").filter("at_src = at_dst").select("at_src.*", "src", "dst")
    held = inside.groupBy("community", "part").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    grouped = members.groupBy("community", "part").agg(F.array_sort(F.collect_list("id")).alias("nodes"))
    empty = F.array().cast("array<struct<src:string,dst:string>>")
    return grouped.join(held, ["community", "part"], "left").select(name, "nodes", F.coalesce("edges", empty).alias("edges"))


def _anchors(nodes: DataFrame, types: tuple[str, ...], ids: tuple[str, ...]) -> Column:
    if ids:
        return F.col("id").cast("string").isin(*ids)
    kind = F.lower("entity_type") if "entity_type" in nodes.columns else F.lit(None).cast("string")
    wanted = F.lit(False)
    for t in types:
        wanted = wanted | F.coalesce(kind.contains(t.strip().lower()), F.lit(False))
    return wanted


def anchor_bfs(nodes: DataFrame, edges: DataFrame, *, max_units: int = 1, types: tuple[str, ...] = ("image",), ids: tuple[str, ...] = (), seed: int = 42, **blocks) -> DataFrame:
    """Breadth first from anchor nodes alone; other units are only pulled in."""
    return grow(nodes, edges, Rule("bfs", max_units, seed=seed), anchor=_anchors(nodes, types, ids), **blocks)


def metadata(nodes: DataFrame, key: str) -> Column:
    """A value of a node's ``metadata``, which may be a struct, a map or JSON; null where there is none."""
    none = F.lit(None).cast("string")
    if "metadata" not in nodes.columns:
        return none
    kind = nodes.schema["metadata"].dataType
    if isinstance(kind, T.StructType):
        return F.col("metadata")[key].cast("string") if key in kind.names else none
    if isinstance(kind, T.MapType):
        return F.element_at("metadata", F.lit(key)).cast("string")
    return F.get_json_object(F.col("metadata").cast("string"), f"$.{key}")


def section(nodes: DataFrame) -> Column:
    """The section of a node: the path in its metadata, else its ``path``, else its ``section``; empty where there is none."""
    full = lambda c: F.when(F.trim(c) != "", F.trim(c))
    own = [full(F.col(c).cast("string")) for c in ("path", "section") if c in nodes.columns]
    return F.coalesce(full(metadata(nodes, "path")), *own, F.lit(""))


def modality(nodes: DataFrame) -> Column:
    """``image``, ``table`` or ``video`` by the entity type; else text, but for nodes without a type that of the metadata."""
    kind = F.coalesce(F.lower("entity_type"), F.lit("")) if "entity_type" in nodes.columns else F.lit("")
    out = F.when(kind != "", F.lit("text")).otherwise(F.coalesce(F.lower(F.nullif(metadata(nodes, "modality"), F.lit(""))), F.lit("text")))
    for m in reversed(SHOWN):
        out = F.when(kind.contains(m), m).otherwise(out)
    return out


def aggregated_vqa(nodes: DataFrame, edges: DataFrame, *, max_units: int = 12, min_units: int = 6, section_scoped: bool = True, modalities: tuple[str, ...] = ("image", "text"), types: tuple[str, ...] = ("image",), ids: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """Communities around anchors in their sections, which hold all ``modalities`` (or entity types of such names)."""
    kind = F.coalesce(F.lower("entity_type"), F.lit("")) if "entity_type" in nodes.columns else F.lit("")
    return around_anchors(
        nodes, edges, anchor=_anchors(nodes, types, ids), section=section(nodes) if section_scoped else F.lit(""), kinds=F.array(modality(nodes), kind),
        required=tuple(m.strip().lower() for m in modalities), most=max_units, least=min_units, seed=seed,
    )


METHODS = {"bfs": bfs, "dfs": dfs, "ece": ece, "leiden": leiden, "anchor_bfs": anchor_bfs, "aggregated_vqa_anchor_bfs": aggregated_vqa}


def partition(nodes: DataFrame, edges: DataFrame, method: str, **params) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown partition method {method}; known: {', '.join(METHODS)}")
    return METHODS[method](nodes, edges, **params)
