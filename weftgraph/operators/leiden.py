"""Communities by modularity, Leiden's way, as rounds of joins and grouped sums.

A level moves nodes between communities, refines the communities into
well-connected parts, and contracts each part to a node of the next level.

* Moving is synchronous: links of each node to the communities around it are a
  grouped sum, totals of the communities a table, and a hashed share of the nodes
  that would gain moves at once. Nodes that move together can spoil each other's
  gain, so a round counts only if modularity rises; else the next one moves a
  smaller share, down to a few nodes whose moves hardly meet.
* Refinement starts from single nodes inside each community. In a round a coin
  of each part says whether it may be joined or may join; a single node joins the
  part where it gains most, if both are well connected to their community. So
  parts are joined along edges only, and no two joins of a round hang together.
* Contraction sums edges by the parts of their ends.

A level that contraction has made small (at most ``small`` nodes and edges) is
finished on the driver, node by node: a bounded number of rows.

At the end each community is cut into its connected parts, which can only raise
modularity. Sums are combined on the map side, so a hub is no large group, and
no step gathers a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import graph
from weftgraph.sources.storage import cut_lineage, release

#: Shares of the gaining nodes that move in a round: one in so many, from first to last.
SHARES = (2, 4)
#: A round that raises modularity by less ends the moving at its share.
LEAST_GAIN = 5e-4
#: A contracted graph of so few nodes and edges is finished on the driver, node by node.
SMALL = 20_000


def _sides(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("n"), F.col("v").alias("other"), "w").unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("other"), "w"))


def _coin(sides: int, turn: int, *columns: str):
    return F.pmod(F.xxhash64(*columns, F.lit(turn)), F.lit(sides))


def _quality(nodes: DataFrame, edges: DataFrame, total: float) -> float:
    """Modularity less the part of the self-loops, which no move changes."""
    c = nodes.select("n", "c")
    inside = edges.join(c.select(F.col("n").alias("u"), F.col("c").alias("cu")), "u").join(c.select(F.col("n").alias("v"), F.col("c").alias("cv")), "v").filter("cu = cv").agg(F.sum("w")).first()[0] or 0.0
    squares = nodes.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return 2 * inside / total - squares / total**2


def _tried(nodes: DataFrame, sides: DataFrame, total: float) -> DataFrame:
    """(n, k, c, w, to, would): each node's links to its own community, its best community, and whether it would gain there."""
    totals = nodes.groupBy("c").agg(F.sum("k").alias("t"))
    links = sides.join(nodes.select(F.col("n").alias("other"), F.col("c").alias("to")), "other").groupBy("n", "to").agg(F.sum("w").alias("w"))
    own = nodes.join(totals, "c").select("n", "k", "c", (F.col("t") - F.col("k")).alias("rest"))
    found = links.join(own, "n").join(totals.withColumnRenamed("c", "to"), "to")
    here = F.col("to") == F.col("c")
    gain = F.col("w") - F.col("k") * F.when(here, F.col("rest")).otherwise(F.col("t")) / total
    best = found.withColumn("gain", gain).groupBy("n").agg(F.max(F.struct("gain", (-F.col("to")).alias("minus"))).alias("best"), F.max(F.when(here, F.col("w"))).alias("w"))
    stay = F.coalesce("w", F.lit(0.0)) - F.col("k") * F.col("rest") / total
    would = F.coalesce(F.col("best.gain") > stay + 1e-12, F.lit(False))
    return own.join(best, "n", "left").select("n", "k", "c", F.coalesce("w", F.lit(0.0)).alias("w"), (-F.col("best.minus")).alias("to"), would.alias("would"))


def _move(nodes: DataFrame, edges: DataFrame, total: float, seed: int) -> tuple[DataFrame, bool]:
    """``nodes`` (n, k, c) with communities that no share of moves makes better, and whether any node moved."""
    sides, turn, at, moved = _sides(edges), 0, 0, False
    best, quality = None, 0.0
    while True:
        tried = cut_lineage(_tried(nodes, sides, total))
        inside, any_ = tried.agg(F.sum("w"), F.max("would")).first()
        squares = tried.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
        now = inside / total - squares / total**2
        if best is None or now > quality + LEAST_GAIN:
            moved, quality = best is not None, now
            if best is not None:
                release(best)
            best = tried
            if not any_:
                break
        else:  # the moves spoiled each other: fewer from where they started
            release(tried)
            at += 1
            if at == len(SHARES):
                break
        turn += 1
        go = F.col("would") & (_coin(SHARES[at], seed + turn, "n") == 0)
        nodes = best.select("n", "k", F.when(go, F.col("to")).otherwise(F.col("c")).alias("c"))
    return best.select("n", "k", "c"), moved


def _moved_one_by_one(rows: list, links: list, total: float) -> dict[int, int]:
    """Communities of a small graph: nodes (n, k, c) move one by one and are merged, until nothing moves; {n: community}."""
    home, weight = {r.n: r.c for r in rows}, {r.n: r.k for r in rows}
    near: dict[int, dict[int, float]] = {n: {} for n in home}
    for e in links:
        near[e.u][e.v] = near[e.v][e.u] = e.w
    of = {n: n for n in home}
    while True:
        totals: dict[int, float] = {}
        for n, c in home.items():
            totals[c] = totals.get(c, 0.0) + weight[n]
        changed = moved = False
        while changed or not moved:
            changed, moved = False, True
            for n in sorted(home):
                around: dict[int, float] = {}
                for x, w in near[n].items():
                    around[home[x]] = around.get(home[x], 0.0) + w
                k, own = weight[n], home[n]
                totals[own] -= k
                gain = {c: around.get(c, 0.0) - k * totals[c] / total for c in (*around, own)}
                best = min(gain, key=lambda c: (-gain[c], c != own, c))
                if gain[best] > gain[own] + 1e-12:
                    home[n], changed = best, True
                totals[home[n]] += k
        if len(set(home.values())) == len(home):
            return {n: home[x] for n, x in of.items()}
        of = {n: home[x] for n, x in of.items()}
        merged: dict[int, dict[int, float]] = {c: {} for c in home.values()}
        for n, held in near.items():
            for x, w in held.items():
                if home[n] != home[x]:
                    merged[home[n]][home[x]] = merged[home[n]].get(home[x], 0.0) + w
        weight, near = {c: t for c, t in totals.items() if c in merged}, merged
        home = {c: c for c in merged}


def _refine(nodes: DataFrame, edges: DataFrame, total: float, seed: int, rounds: int = 4) -> DataFrame:
    """(n, k, c, part): well-connected parts of each community, named by one of their nodes."""
    c = nodes.select("n", "c")
    inner = edges.join(c.select(F.col("n").alias("u"), F.col("c").alias("cu")), "u").join(c.select(F.col("n").alias("v"), F.col("c").alias("cv")), "v").filter("cu = cv").select("u", "v", "w")
    sides = cut_lineage(_sides(inner))
    whole = nodes.groupBy("c").agg(F.sum("k").alias("t"))
    strength = sides.groupBy("n").agg(F.sum("w").alias("inside"))
    parts = cut_lineage(nodes.join(whole, "c").join(strength, "n", "left").select("n", "k", "c", "t", F.coalesce("inside", F.lit(0.0)).alias("inside"), F.col("n").alias("part")))
    idle = 0
    for turn in range(rounds):
        of = parts.select("n", "part")
        between = sides.join(of, "n").join(of.select(F.col("n").alias("other"), F.col("part").alias("to")), "other").filter("part != to")
        outside = between.groupBy("part").agg(F.sum("w").alias("out"))
        held = parts.groupBy("part").agg(F.sum("k").alias("tk"), F.count("*").alias("size"), F.first("t").alias("t"))
        # a part is well connected if its links to the rest of its community are as many as chance would give
        held = held.join(outside, "part").filter(F.col("out") >= F.col("tk") * (F.col("t") - F.col("tk")) / total)
        lone = held.filter((F.col("size") == 1) & (_coin(2, seed + turn, "part") == 0)).select("part", "tk")
        open_ = held.filter(_coin(2, seed + turn, "part") == 1).select(F.col("part").alias("to"), F.col("tk").alias("to_k"))
        links = between.groupBy("part", "to").agg(F.sum("w").alias("w")).join(lone, "part").join(open_, "to")
        gain = F.col("w") - F.col("tk") * F.col("to_k") / total
        joins = links.withColumn("gain", gain).filter("gain > 0").groupBy("part").agg(F.max(F.struct("gain", (-F.col("to")).alias("minus"))).alias("best")).select("part", (-F.col("best.minus")).alias("to"))
        joins = cut_lineage(joins)
        idle = idle + 1 if joins.isEmpty() else 0
        if idle == 2:
            break
        if not idle:
            now = cut_lineage(parts.join(joins, "part", "left").select("n", "k", "c", "t", "inside", F.coalesce("to", "part").alias("part")))
            release(parts)
            parts = now
        release(joins)
    release(sides)
    return parts.select("n", "k", "c", "part")


def communities(edges: DataFrame, *, seed: int = 42, levels: int = 12, small: int = SMALL) -> DataFrame:
    """(id, community) of the nodes that have edges; a community is named by its smallest id."""
    pairs = graph.canonical(edges.select(F.col("src").cast("string"), F.col("dst").cast("string"))).filter("src != dst").distinct()
    ids = graph.symmetric(pairs).select("id").distinct()
    # numbers in hashed order, so that ties, which go to the smaller number, favour no names
    ids = graph.ranked(ids, "n", F.md5(F.concat(F.lit(f"{seed}|"), "id")), F.col("id"))
    end = lambda c, x: ids.select(F.col("id").alias(c), F.col("n").alias(x))
    numbered = pairs.join(end("src", "a"), "src").join(end("dst", "b"), "dst")
    numbered = cut_lineage(numbered.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.lit(1.0).alias("w")))
    now = numbered
    nodes = cut_lineage(_sides(numbered).groupBy("n").agg(F.sum("w").alias("k")).select("n", "k", F.col("n").alias("c")))
    total = nodes.agg(F.sum("k")).first()[0]
    member = nodes.select(F.col("n").alias("first"), "n", "c")
    if total:
        member = cut_lineage(member)
        for level in range(levels):
            if max(nodes.count(), now.count()) <= small:
                labels = _moved_one_by_one(nodes.collect(), now.collect(), total)
                labels = edges.sparkSession.createDataFrame(list(labels.items()), "n bigint, c bigint")
                member = cut_lineage(member.select("first", "n").join(labels, "n").select("first", "n", "c"))
                break
            nodes, moved = _move(nodes, now, total, seed + 1000 * level)
            labelled = cut_lineage(member.select("first", "n").join(nodes.select("n", "c"), "n").select("first", "n", "c"))
            release(member)
            member = labelled
            if not moved:
                break
            parts = _refine(nodes, now, total, seed + 1000 * level + 500)
            smaller = parts.groupBy("part").agg(F.sum("k").alias("k"), F.first("c").alias("c")).select(F.col("part").alias("n"), "k", "c")
            smaller = cut_lineage(smaller)
            if smaller.count() == nodes.count():
                break
            of = parts.select("n", "part")
            merged = now.join(of.select(F.col("n").alias("u"), F.col("part").alias("pu")), "u").join(of.select(F.col("n").alias("v"), F.col("part").alias("pv")), "v").filter("pu != pv")
            merged = cut_lineage(merged.groupBy(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).agg(F.sum("w").alias("w")))
            mapped = cut_lineage(member.join(of, "n").select("first", F.col("part").alias("n"), "c"))
            release(member, nodes, parts)
            member, nodes, now = mapped, smaller, merged
    of = member.select(F.col("first").alias("n"), "c")
    inner = numbered.join(of.select(F.col("n").alias("u"), F.col("c").alias("cu")), "u").join(of.select(F.col("n").alias("v"), F.col("c").alias("cv")), "v").filter("cu = cv")
    parts = graph.components(of.select(F.col("n").alias("id")), inner.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    named = parts.join(ids.select(F.col("n").alias("id"), F.col("id").alias("name")), "id")
    least = named.groupBy("component").agg(F.min("name").alias("community"))
    return named.join(least, "component").select(F.col("name").alias("id"), "community")


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of the partition ``labels`` (id, community) over undirected edges."""
    pairs = graph.canonical(edges.select("src", "dst")).filter("src != dst").distinct()
    nodes = graph.symmetric(pairs).groupBy("id").agg(F.count("*").cast("double").alias("k")).join(labels, "id").select(F.col("id").alias("n"), "k", F.col("community").alias("c"))
    return _quality(nodes, pairs.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1.0).alias("w")), nodes.agg(F.sum("k")).first()[0])
