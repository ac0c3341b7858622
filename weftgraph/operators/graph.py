"""Property graphs as two tables: nodes(id, ...) and undirected edges(src, dst, ...).

Everything is a join or an aggregate; ``components`` alternates grouped minima
until labels are stable, writing each round to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.sources.storage import cut_lineage, release


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with src <= dst; direction is not kept."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest)


#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
PLACE_BITS = 33


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with ``name``, the row's number from 0 in the given order, which should have no ties.

    Rows are sorted across partitions; a row's number is its place in its
    partition plus the rows of the partitions before. Only these counts, one for
    each shuffle partition, reach the driver.
    """
    held = cut_lineage(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", PLACE_BITS).cast("int")
    offsets, before = [], 0
    for p, n in sorted((r.part, r.n) for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((p, before))
        before += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part int, __before bigint"))
    number = F.col("__before") + F.col("__place").bitwiseAND((1 << PLACE_BITS) - 1)
    out = cut_lineage(held.withColumn("__part", part).join(offsets, "__part").withColumn(name, number).select(*df.columns, name))
    release(held)
    return out


def symmetric(edges: DataFrame) -> DataFrame:
    """(id, other): every edge from both ends; a self-loop counts from both."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of all nodes; isolated ones have 0."""
    d = symmetric(edges).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def edge_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, degree): the sum of the ends' degrees."""
    d = degrees(nodes, edges)
    return edges.select("src", "dst").join(d.select(F.col("id").alias("src"), F.col("degree").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("b")), "dst").select("src", "dst", (F.col("a") + F.col("b")).alias("degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(symmetric(edges).select("id"), "id", "left_anti")


def neighbors(edges: DataFrame) -> DataFrame:
    """Distinct (id, other)."""
    return symmetric(edges).distinct()


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end in ``ids`` (id)."""
    a = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    b = edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return a.unionByName(b).distinct()


#: Neighbours of a hub that meet its frontier in one task.
SHARE = 4096


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, id, distance) within ``hops`` of each seed (seed); only the frontier is joined each hop.

    A node with one neighbour is reached in one way alone, through that one, so
    its rows are neither compared nor shuffled: they leave the join, in which a
    hub's such neighbours are dealt over tasks. Others are made distinct. The
    last hop isn't stored.
    """
    sides = symmetric(edges).filter(~F.col("id").eqNullSafe(F.col("other"))).repartition("id").distinct()
    alone = (F.count("*").over(Window.partitionBy("id")) == 1) & F.col("id").isNotNull()
    near = cut_lineage(sides.withColumn("alone", alone).select(F.col("other").alias("id"), F.col("id").alias("other"), "alone"))
    ends, inner = near.filter("alone").drop("alone"), near.filter("NOT alone").drop("alone")
    parts = ends.groupBy("id").agg(F.expr(f"count(*) div {SHARE} + 1").alias("parts"))
    dealt = ends.join(parts, "id").select("id", "other", F.pmod(F.xxhash64("other"), "parts").alias("part"))
    found = frontier = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("distance"))
    for hop in range(1, hops + 1):
        step = frontier.select("seed", "id").join(inner, "id").select("seed", F.col("other").alias("id")).distinct()
        step = step.join(found.select("seed", "id"), ["seed", "id"], "left_anti")
        asked = frontier.select("seed", "id").distinct().join(parts, "id").select("seed", "id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
        last = asked.join(dealt, ["id", "part"]).filter("seed != other").select("seed", F.col("other").alias("id"))
        frontier = step.unionByName(last).withColumn("distance", F.lit(hop))
        if hop < hops:
            frontier = cut_lineage(frontier)
        found = found.unionByName(frontier)
    return found


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component), the component named by its smallest node id; isolated nodes are their own."""
    links = cut_lineage(edges.filter("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        pairs = up.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        links = cut_lineage(pairs.select("e.u", "e.v").filter("u != v").distinct())
        unsettled = links.groupBy("u").count().filter("count > 1").select("u").unionByName(links.select(F.col("v").alias("u")).join(links.select("u"), "u", "left_semi"))
        if unsettled.isEmpty():
            break
    return nodes.select("id").distinct().join(links.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the largest component (ties: smallest name), ids unescaped and upper-cased, edges sorted."""
    from weftgraph.functions.text import strip, unescape

    parts = components(nodes, edges)
    top = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    kept = parts.join(F.broadcast(top), "component", "left_semi").select("id")
    stable = lambda c: F.upper(strip(unescape(F.col(c))))
    n = nodes.join(kept, "id", "left_semi").withColumn("id", stable("id"))
    e = edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").withColumn("src", stable("src")).withColumn("dst", stable("dst"))
    return n.orderBy("id"), canonical(e).orderBy("src", "dst")


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same id."""
    return nodes.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """As for nodes; new edges without both end points are refused."""
    ids = nodes.select("id")
    ok = canonical(new).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.join(ok.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(ok, allowMissingColumns=True)


def update_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Columns of ``changes`` overwrite those of existing nodes; other ids are ignored."""
    given = [c for c in changes.columns if c != "id"]
    named = changes.select("id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in given])
    joined = nodes.join(named, "id", "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in nodes.columns])


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the listed nodes (id) and every edge at them."""
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(canonical(gone).select("src", "dst"), ["src", "dst"], "left_anti").select(*edges.columns)


def community_payloads(communities: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Communities (community_id, nodes array<string>, edges array<struct<src,dst>>) with the rows behind the ids.

    Unknown ids, self-loops and malformed edges are dropped; edges are found in
    either direction; the order of the lists is kept.
    """
    rest_n, rest_e = ([c for c in f.columns if c not in ("id", "src", "dst")] for f in (nodes, edges))
    n = communities.select("community_id", F.posexplode("nodes").alias("at", "id")).join(nodes, "id")
    n = n.groupBy("community_id").agg(F.sort_array(F.collect_list(F.struct("at", "id", *rest_n))).alias("nodes"))
    e = communities.select("community_id", F.posexplode("edges").alias("at", "e")).filter("e.src IS NOT NULL AND e.dst IS NOT NULL AND e.src != e.dst")
    e = e.select("community_id", "at", F.least("e.src", "e.dst").alias("src"), F.greatest("e.src", "e.dst").alias("dst")).join(canonical(edges), ["src", "dst"])
    e = e.groupBy("community_id").agg(F.sort_array(F.collect_list(F.struct("at", "src", "dst", *rest_e))).alias("edges"))
    ids = communities.select("community_id")
    return ids.join(n, "community_id", "left").join(e, "community_id", "left").select("community_id", F.coalesce("nodes", F.array()).alias("nodes"), F.coalesce("edges", F.array()).alias("edges"))


def structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of structure metrics; nulls for an empty graph."""
    d = degrees(nodes, edges)
    base = d.agg(F.count("*").alias("total_nodes"), F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).alias("isolated"), F.avg("degree").alias("avg_degree"))
    biggest = components(nodes, edges).groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n").alias("lcc"))
    row = base.crossJoin(edges.agg(F.count("*").alias("total_edges"))).crossJoin(biggest).crossJoin(powerlaw_r2(d))
    ratio = lambda x: F.when(F.col("total_nodes") > 0, F.col(x) / F.col("total_nodes"))
    row = row.select("total_nodes", "total_edges", ratio("isolated").alias("noise_ratio"), ratio("lcc").alias("largest_cc_ratio"), "avg_degree", "powerlaw_r2")
    robust = (F.col("noise_ratio") < 0.15) & (F.col("largest_cc_ratio") > 0.90) & F.col("avg_degree").between(2, 5) & (F.col("powerlaw_r2") > 0.75)
    return row.withColumn("is_robust", F.coalesce(robust, F.lit(False)))


def powerlaw_r2(degree: DataFrame) -> DataFrame:
    """r squared of ln(frequency) on ln(degree); null under ten linked nodes or three degrees."""
    freq = degree.filter("degree > 0").groupBy("degree").agg(F.count("*").alias("freq"))
    fit = freq.agg(F.sum("freq").alias("n"), F.count("*").alias("k"), F.expr("regr_r2(ln(freq), ln(degree))").alias("r2"))
    return fit.select(F.when((F.col("n") >= 10) & (F.col("k") >= 3), F.col("r2")).alias("powerlaw_r2"))


def split_large(members: DataFrame, most: int) -> DataFrame:
    """(community, id) with communities over ``most`` members cut in member order.

    Members are ranked inside ranges of (community, id) and moved by the counts
    of the ranges before, so a giant community is not one task.
    """
    ranged = cut_lineage(cut_lineage(members).repartitionByRange("community", "id").withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("community", "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("community").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("community").alias("__community"), F.col("__range").alias("__at"), before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("community", "__range").orderBy("id")) - 1
    ranked = ranged.withColumn("__rank", rank).join(starts, F.col("community").eqNullSafe(F.col("__community")) & (F.col("__range") == F.col("__at")))
    return ranked.select(*members.columns, F.floor((F.col("__rank") + F.col("__before")) / most).alias("part"))
