"""Paths of four different nodes on graphs with hubs: counted and drawn without listing them.

A path a-b-c-d has the middle edge b-c. With n(x) neighbours of x there are
(n(b) - 1) (n(c) - 1) ways to add a and d, those with a = d included, so walks
are numbered by middle edges in order and, within one, by the places of a and d
in sorted neighbour lists. A number leads back to its walk by lookups, so work
grows with edges and draws, never with the paths.

Loops, edges with a null end and repeated edges are left out; a graph without
paths gives an empty sample and counts of 0.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.graph import canonical, ranked, symmetric
from weftgraph.sources.storage import cut_lineage, release

#: Rows of a block of prefix sums, and draws that one row generates at a time.
BLOCK = 4096


def simple(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) with src < dst."""
    return canonical(edges.select("src", "dst").filter("src != dst")).distinct()


def prefix_sums(df: DataFrame, number: str, weight: str, name: str, size: int) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` over smaller numbers, which are distinct and below ``size``.

    Sums run within blocks of 4096 numbers; the totals of blocks are summed the
    same way, so no group is larger than a block.
    """
    before = Window.partitionBy("__block").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("__block", F.expr(f"{number} div {BLOCK}"))
    inside = F.coalesce(F.sum(weight).over(before), F.lit(0).cast("bigint"))
    if size <= BLOCK:
        return out.withColumn(name, inside).drop("__block")
    totals = out.groupBy(F.col("__block").alias("__number")).agg(F.sum(weight).alias("__weight"))
    bases = prefix_sums(totals, "__number", "__weight", "__base", size // BLOCK + 1).select(F.col("__number").alias("__block"), "__base")
    return out.withColumn("__inside", inside).join(bases, "__block").select(*df.columns, (F.col("__base") + F.col("__inside")).alias(name))


def path_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_paths): paths of four different nodes that start at each node.

    Walks a-b-c-d that don't turn back are summed over neighbours; those with
    d = a go round a triangle and are taken off. Triangles are found from their
    end with the fewest neighbours, which has at most sqrt(2 edges) later ones.
    """
    e = cut_lineage(simple(edges))
    arcs = symmetric(e)
    n = cut_lineage(arcs.groupBy("id").agg(F.count("*").alias("n")))
    at = n.select(F.col("id").alias("other"), F.col("n").alias("m"))
    ahead = arcs.join(at, "other").groupBy("id").agg(F.sum(F.col("m") - 1).alias("ahead"))
    walks = arcs.join(ahead.select(F.col("id").alias("other"), "ahead"), "other").groupBy("id").agg(F.sum("ahead").alias("walks"))

    ends = e.join(n.select(F.col("id").alias("src"), F.col("n").alias("n_src")), "src").join(n.select(F.col("id").alias("dst"), F.col("n").alias("n_dst")), "dst")
    low, high = F.struct(F.col("n_src").alias("n"), F.col("src").alias("id")), F.struct(F.col("n_dst").alias("n"), F.col("dst").alias("id"))
    later = cut_lineage(ends.select(F.least(low, high).alias("x"), F.greatest(low, high).alias("y")).select(F.col("x.id").alias("x"), "y"))
    wedges = later.join(later.select("x", F.col("y").alias("z")), "x").filter("y < z").select("x", F.col("y.id").alias("y"), F.col("z.id").alias("z"))
    corners = wedges.join(later.select(F.col("x").alias("y"), F.col("y.id").alias("z")), ["y", "z"])
    turns = corners.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))

    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    out = nodes.select("id").join(n, "id", "left").join(walks, "id", "left").join(turns, "id", "left")
    return out.select("id", (zero("walks") - zero("n") * (zero("n") - 1) - 2 * zero("triangles")).alias("n_paths"))


class PathIndex(NamedTuple):
    """Numbered arcs (id, other, number), middle edges with the walks before each, and the number of walks."""

    arcs: DataFrame
    middles: DataFrame
    walks: int


def path_index(edges: DataFrame) -> PathIndex:
    """The tables that turn numbers of walks into walks; only their number reaches the driver.

    Each join is written by itself, so that no more than its own shuffle is on disk.
    """
    arcs = ranked(symmetric(simple(edges)), "number", F.col("id"), F.col("other"))
    lists = cut_lineage(arcs.groupBy("id").agg(F.min("number").alias("at"), F.count("*").alias("n")))
    listed = cut_lineage(arcs.join(lists, "id").filter("n > 1"))
    release(lists)
    side = lambda x, y: listed.select(F.col("id").alias(x), F.col("other").alias(y), F.col("number").alias(f"to_{y}"), F.col("at").alias(f"at_{x}"), (F.col("n") - 1).alias(f"n_{x}"))
    there, back = side("b", "c").filter("b < c"), side("c", "b").filter("c > b")
    held = cut_lineage(there.join(back, ["b", "c"]).withColumn("w", F.col("n_b") * F.col("n_c")))
    release(listed)
    size = (arcs.agg(F.max("number")).first()[0] or 0) + 1
    middles = cut_lineage(prefix_sums(held, "to_c", "w", "before", size))
    release(held)
    return PathIndex(arcs, middles, middles.agg(F.sum("w")).first()[0] or 0)


def _skip(place: Column, left_out: Column) -> Column:
    """The place in a whole list of the ``place``-th of those beside ``left_out``."""
    return place + (place >= left_out).cast("bigint")


def sample_paths(edges: DataFrame, draws: int | None = None, *, seed: int = 0, index: PathIndex | None = None) -> DataFrame:
    """(draw, a, b, c, d) with b < c: paths drawn evenly from all paths of four different nodes.

    Draw i takes a walk from the i-th of ``draws`` equal shares of the numbered
    walks, by a hash of seed and i; every walk is expected draws / walks times.
    A draw that returns to its start (a = d) is dropped, which leaves paths
    equally likely. Without ``draws``, or with as many as there are walks, each
    path comes exactly once. A middle edge generates its own draws, in blocks;
    only edges with draws in several blocks are shuffled, so that a hub's draws
    spread over tasks.
    """
    arcs, middles, walks = index or path_index(edges)
    n = walks if draws is None else draws
    wide = lambda x, digits=19: f"CAST({x} AS DECIMAL({digits},0))"
    total, shares = wide(max(walks, 1)), wide(max(n, 1), 18)
    first, last = f"{wide('before')} * {shares} div {total}", f"({wide('before + w')} * {shares} - 1) div {total}"
    hit = middles.filter(F.lit(n > 0)).withColumn("first", F.expr(first)).withColumn("last", F.expr(last))
    low, high = F.expr(f"first div {BLOCK}"), F.expr(f"last div {BLOCK}")
    many = hit.filter(low != high).withColumn("block", F.explode(F.sequence(low, high))).repartition("to_c", "block")
    hit = hit.filter(low == high).withColumn("block", low).unionByName(many)
    hit = hit.withColumn("draw", F.explode(F.expr(f"sequence(greatest(first, block * {BLOCK}), least(last, block * {BLOCK} + {BLOCK - 1}))")))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    hit = hit.withColumn("r", hashed % F.lit(max(walks, 1)).cast("bigint")).withColumn("p", F.expr(f"({wide('draw', 18)} * {total} + r) div {shares}"))
    hit = hit.filter("p >= before AND p < before + w").withColumn("o", F.col("p") - F.col("before"))
    hit = hit.withColumn("to_a", F.col("at_b") + _skip(F.expr("o div n_c"), F.col("to_c") - F.col("at_b")))
    hit = hit.withColumn("to_d", F.col("at_c") + _skip(F.col("o") % F.col("n_c"), F.col("to_b") - F.col("at_c")))
    end = lambda x: arcs.select(F.col("number").alias(f"to_{x}"), F.col("other").alias(x))
    half = cut_lineage(hit.select("draw", "b", "c", "to_a", "to_d").join(end("a"), "to_a").drop("to_a"))
    if index is None:
        release(middles)
    return half.join(end("d"), "to_d").filter("a != d").select("draw", "a", "b", "c", "d")
