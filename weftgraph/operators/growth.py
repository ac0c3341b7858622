"""Communities that grow from seeds: in blocks of bounded size, or around anchors.

Sequential growth takes the units of a graph (nodes and edges) in a fixed order;
each unit that no earlier community has used starts one, which uses up to
``most`` free units around it. What one community uses matters only where others
can come, so growth goes block by block, all blocks at once:

* A connected component of at most ``block_units`` units is one block, and
  there the result is that of sequential growth over the whole graph.
* A larger component is cut into blocks: hashed centres take the nodes around
  them in rounds of grouped minima, and areas are cut to size. An edge belongs to
  the end with fewer edges, so a hub's edges spread over the blocks of its
  neighbours. Growth doesn't leave its block, every unit is in one community, and
  no task holds more than a block.

Blocks are rows of one sorted stream, so that many small components cost no more
than their rows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import graph
from weftgraph.sources.storage import cut_lineage, release

DEFAULT_LOSS = "-ln(0.1D)"
#: Units of a block at most, and rounds in which centres of a giant component take the nodes around them.
BLOCK_UNITS, AREA_ROUNDS = 20_000, 6
OUT = "community_id string, nodes array<string>, edges array<struct<src:string,dst:string>>"
_ARROW = pa.schema([("community_id", pa.string()), ("nodes", pa.list_(pa.string())), ("edges", pa.list_(pa.struct([("src", pa.string()), ("dst", pa.string())])))])


@dataclass
class Block:
    """Units by number: nodes in the order of their names, then edges in that of their ends; an end outside is no unit here."""

    nodes: list[str] = field(default_factory=list)
    edges: list[tuple[str, str]] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    starts: list[bool] = field(default_factory=list)
    around: list[list[int]] = field(default_factory=list)

    def add(self, src: str, dst: str | None, length: int, loss: float, starts: bool) -> None:
        if dst is None:
            self.nodes.append(src)
        else:
            self.edges.append((src, dst))
        self.lengths.append(length)
        self.losses.append(loss)
        self.starts.append(starts)

    def close(self) -> None:
        """What is around each unit. Edges come by (src, dst) with src < dst, so those of a node lie in the order of their other ends."""
        at = {x: i for i, x in enumerate(self.nodes)}
        self.around = [[] for _ in self.nodes]
        for e, pair in enumerate(self.edges, len(self.nodes)):
            held = [at[x] for x in pair if x in at]
            for i in held:
                self.around[i].append(e)
            self.around.append(held)

    def names(self) -> list[str]:
        return [*self.nodes, *map("|".join, self.edges)]


@dataclass(frozen=True)
class Rule:
    """How communities grow: ``bfs`` queues all free edges of a node, ``dfs`` goes on with the first; ``ece`` adds units as it sees them, up to ``tokens``."""

    mode: str
    most: int
    least: int = 1
    tokens: int = (1 << 63) - 1
    order: str = "random"
    seed: int = 42

    def sort(self, block: Block, names: list[str]) -> list[int]:
        """All units; equal losses in hashed order. Each is hashed once."""
        sign = {"random": 0, "min_loss": 1, "max_loss": -1}[self.order]
        keys = [hashlib.md5(f"{self.seed}|{x}".encode()).digest() + x.encode() for x in names]
        if sign:
            return sorted(range(len(keys)), key=lambda u: (sign * block.losses[u], keys[u]))
        return sorted(range(len(keys)), key=keys.__getitem__)

    def grow(self, block: Block, names: list[str]) -> Iterator[list[int]]:
        """Communities as their units in the order of use."""
        order, used = self.sort(block, names), bytearray(len(names))
        if self.mode == "ece":
            rank = [0] * len(order)
            for i, u in enumerate(order):
                rank[u] = i
            one = lambda start: self._discover(block, rank, start, used)
        else:
            one = lambda start: self._pop(block, start, used)
        for start in order:
            if block.starts[start] and not used[start] and len(found := one(start)) >= self.least:
                yield found

    def _pop(self, block: Block, start: int, used: bytearray) -> list[int]:
        found: list[int] = []
        todo, around, n = deque([start]), block.around, len(block.nodes)
        while todo and len(found) < self.most:
            unit = todo.popleft() if self.mode == "bfs" else todo.pop()
            if used[unit]:
                continue
            used[unit] = 1
            found.append(unit)
            if self.mode == "dfs" and unit < n:
                todo.extend([u for u in [next((u for u in around[unit] if not used[u]), None)] if u is not None])
            elif len(found) < self.most:
                todo.extend([u for u in around[unit] if not used[u]])
        return found

    def _discover(self, block: Block, rank: list[int], start: int, used: bytearray) -> list[int]:
        found, total, todo = [start], block.lengths[start], deque([start])
        used[start] = 1
        while todo:
            for unit in sorted([u for u in block.around[todo.popleft()] if not used[u]], key=rank.__getitem__):
                if len(found) >= self.most or total >= self.tokens:
                    return found
                used[unit] = 1
                found.append(unit)
                total += block.lengths[unit]
                todo.append(unit)
            if len(found) >= self.most or total >= self.tokens:
                return found
        return found


class _Found:
    """Communities as flat columns."""

    def __init__(self) -> None:
        self.ids, self.nodes, self.src, self.dst, self.node_at, self.edge_at = [], [], [], [], [0], [0]

    def add(self, block: Block, names: list[str], units: list[int]) -> None:
        n = len(block.nodes)
        self.ids.append(names[units[0]])
        for u in units:
            if u < n:
                self.nodes.append(names[u])
            else:
                a, b = block.edges[u - n]
                self.src.append(a)
                self.dst.append(b)
        self.node_at.append(len(self.nodes))
        self.edge_at.append(len(self.src))

    def batch(self) -> pa.RecordBatch:
        text = lambda x: pa.array(x, pa.string())
        at = lambda x: pa.array(x, pa.int32())
        edges = pa.StructArray.from_arrays([text(self.src), text(self.dst)], ["src", "dst"])
        columns = [text(self.ids), pa.ListArray.from_arrays(at(self.node_at), text(self.nodes)), pa.ListArray.from_arrays(at(self.edge_at), edges)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _streamed(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Communities of the blocks of a stream of units sorted by block, nodes before edges, both by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now, out = Block(), None, _Found()

        def grown() -> Iterator[pa.RecordBatch]:
            nonlocal out
            block.close()
            names = block.names()
            for units in rule.grow(block, names):
                out.add(block, names, units)
                if len(out.ids) == 10_000:
                    yield out.batch()
                    out = _Found()

        for batch in batches:
            for at, *unit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now:
                    yield from grown()
                    block, now = Block(), at
                block.add(*unit)
        yield from grown()
        yield out.batch()

    return run


def areas(nodes: DataFrame, edges: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """(id, area): the nodes (id, name) of giant components in connected areas of about ``most`` nodes each.

    Nodes are centres by a hash of the name that about one in ``most`` passes. In
    each round a node without area takes the first of its neighbours' in the
    order of the hashes; only nodes reached in the round before have new
    neighbours. Nodes that no area has reached in the end are their own.
    """
    hashed = F.md5(F.concat(F.lit(f"{seed}|area|"), "name"))
    centres = nodes.select("id", hashed.alias("hash")).filter(F.pmod(F.xxhash64("hash"), F.lit(max(1, most))) == 0)
    centres = graph.ranked(centres, "area", F.col("hash"), F.col("id"))
    held = cut_lineage(nodes.select("id").join(centres.select("id", "area"), "id", "left"))
    sides, last = graph.symmetric(edges), held.filter("area IS NOT NULL")
    for _ in range(AREA_ROUNDS):
        reached = sides.join(last.select(F.col("id").alias("other"), F.col("area").alias("near")), "other").groupBy("id").agg(F.min("near").alias("area"))
        fresh = cut_lineage(reached.join(held.filter("area IS NULL").select("id"), "id", "left_semi"))
        if fresh.isEmpty():
            break
        more = cut_lineage(held.join(fresh.withColumnRenamed("area", "near"), "id", "left").select("id", F.coalesce("area", "near").alias("area")))
        release(held)
        held, last = more, fresh
    return held.select("id", F.coalesce("area", -1 - F.col("id")).alias("area"))


def blocked(nodes: DataFrame, edges: DataFrame, *, most: int, seed: int) -> DataFrame:
    """(block, src, dst, length, loss, starts) of all units; ``nodes`` and ``edges`` have these columns but the block.

    Edges need both ends among the nodes, others are left out. Steps over the
    graph compare and shuffle the nodes' numbers, which have the order of the names.
    """
    ids = graph.ranked(nodes.select(F.col("src").alias("name")), "id", F.col("name"))
    end = lambda c, x: ids.select(F.col("name").alias(c), F.col("id").alias(x))
    held = cut_lineage(edges.join(end("src", "u"), "src").join(end("dst", "v"), "dst"))
    pairs = held.select(F.col("u").alias("src"), F.col("v").alias("dst"))
    label = cut_lineage(graph.components(ids, pairs))
    at = lambda c, x="component": label.select(F.col("id").alias(c), x)
    size = label.groupBy("component").agg(F.count("*").alias("n")).unionByName(pairs.join(at("src"), "src").groupBy("component").agg(F.count("*").alias("n")))
    giant = cut_lineage(size.groupBy("component").agg(F.sum("n").alias("n")).filter(F.col("n") > most))
    own = label.select("id", F.concat(F.lit("c|"), F.col("component").cast("string")).alias("block"))
    if not giant.isEmpty():
        # nodes of a block by the units there are for each node
        inside = cut_lineage(label.join(giant.select("component"), "component", "left_semi").join(ids, "id").select("id", "name"))
        linked = cut_lineage(pairs.join(inside.select(F.col("id").alias("src")), "src", "left_semi"))
        n, m = inside.count(), linked.count()
        share = max(1, most * n // (n + m))
        cut = graph.split_large(areas(inside, linked, share, seed).select(F.col("area").alias("community"), "id"), share)
        small = own.join(inside, "id", "left_anti")
        own = small.unionByName(cut.select("id", F.concat_ws("|", F.lit("a"), F.col("community").cast("string"), F.col("part").cast("string")).alias("block")))
    degree = graph.symmetric(pairs).groupBy("id").agg(F.count("*").alias("degree"))
    own = cut_lineage(own.join(degree, "id", "left").select("id", "block", F.coalesce("degree", F.lit(0)).alias("degree")))
    of = lambda x: own.select(F.col("id").alias(x), F.struct("degree", F.col("id").alias("id"), "block").alias(f"of_{x}"))
    placed = held.join(of("u"), "u").join(of("v"), "v").withColumn("block", F.least("of_u", "of_v")["block"])
    # a dense block keeps as many edges as it may have units, the others are blocks of edges
    turn = F.row_number().over(Window.partitionBy("block", F.pmod(F.xxhash64("src", "dst"), F.lit(64))).orderBy("u", "v"))
    over = F.floor((turn - 1) * 64 / most)
    placed = placed.withColumn("block", F.when(over > 0, F.concat_ws("|", "block", F.lit("more"), over.cast("string"))).otherwise(F.col("block")))
    columns = ["block", "src", "dst", "length", "loss", "starts"]
    named = ids.join(own, "id").select(F.col("name").alias("src"), "block")
    return nodes.join(named, "src").select(*columns).unionByName(placed.select(*columns))


def grow(nodes: DataFrame, edges: DataFrame, rule: Rule, *, anchor: Column | None = None, block_units: int = BLOCK_UNITS) -> DataFrame:
    """(community_id, nodes, edges) by ``rule``; with ``anchor`` only such nodes start communities."""
    value = lambda f, c, kind, default: F.coalesce(F.col(c).cast(kind), F.expr(default)) if c in f.columns else F.expr(default)
    data = lambda f: (value(f, "length", "bigint", "0L").alias("length"), value(f, "loss", "double", DEFAULT_LOSS).alias("loss"))
    starts = F.lit(True) if anchor is None else F.coalesce(anchor, F.lit(False))
    n = nodes.select(F.col("id").cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), *data(nodes), starts.alias("starts")).dropDuplicates(["src"])
    e = edges.withColumns({c: F.col(c).cast("string") for c in ("src", "dst")})
    e = graph.canonical(e).filter("src != dst").dropDuplicates(["src", "dst"])
    e = e.select("src", "dst", *data(e), F.lit(anchor is None).alias("starts"))
    units = blocked(cut_lineage(n), e, most=block_units, seed=rule.seed)
    # nodes before edges, both by name, so that a block is read in one order wherever it lies
    sorted_ = units.repartition("block").sortWithinPartitions("block", F.col("dst").isNotNull(), "src", "dst")
    return sorted_.mapInArrow(_streamed(rule), OUT)


#: Rows of a view: what a row is.
START, KNOWN, LISTED = range(3)


def _views(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Breadth-first growth of each seed over what was read of the graph for it, from rows sorted by (seed, kind, node, other)."""

    def grown(seed: int, known: set[int], lists: dict[int, list[tuple[int, int]]]) -> Iterator[tuple[int, int, int, bool, bool]]:
        ends = {e: sorted((x, y)) for x, held in lists.items() for y, e in held}
        used: set[int] = set()
        todo = deque([seed])
        found: list[int] = []
        while todo and len(found) < most:
            unit = todo.popleft()
            if unit in used:
                continue
            used.add(unit)
            found.append(unit)
            todo.extend([e for _, e in lists.get(unit, ())] if unit >= 0 else ends[unit])
        complete = all(u in known for u in found if u >= 0)
        return ((u, seed, at, u >= 0, complete) for at, u in enumerate(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, lists, out = None, set(), {}, []
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["unit", "owner", "at", "is_node", "complete"])

        for batch in batches:
            for seed, kind, node, other, edge in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seed != now:
                    if now is not None:
                        out.extend(grown(now, known, lists))
                    now, known, lists = seed, set(), {}
                if kind == KNOWN:
                    known.add(node)
                elif kind == LISTED:
                    lists.setdefault(node, []).append((other, edge))
            if len(out) > 50_000:
                yield flush()
        if now is not None:
            out.extend(grown(now, known, lists))
        yield flush()

    return run


def _first(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """The first ``most`` rows of each group in the order of ``other``; tasks cut their groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("other"))
    return rows.withColumn("__n", place).filter(F.col("__n") <= most).drop("__n")


def around_anchors(nodes: DataFrame, edges: DataFrame, *, anchor: Column, section: Column, kinds: Column, required: tuple[str, ...], most: int, least: int, seed: int = 42) -> DataFrame:
    """Communities around anchor nodes, which may overlap: (community_id, nodes, edges).

    Growth is breadth first over whatever is in the anchor's section or in none
    (``section`` is empty there). A community counts if it has ``least`` units
    and the ``required`` ones among its nodes' ``kinds`` (an array); an anchor
    inside a community that counts and comes earlier in hashed order starts none.

    Anchors grow independently, all at once. A node's edges are cut to the first
    few for each section at its other ends, so hubs stay small.
    """
    n = nodes.select(F.col("id").cast("string").alias("id"), F.coalesce(section, F.lit("")).alias("section"), kinds.alias("kinds"), F.coalesce(anchor, F.lit(False)).alias("anchor")).dropDuplicates(["id"])
    n = graph.ranked(n, "node", F.col("id"))
    e = graph.canonical(edges.select(F.col("src").cast("string"), F.col("dst").cast("string"))).filter("src != dst").distinct()
    end = lambda c, x: n.select(F.col("id").alias(c), F.col("node").alias(x), F.col("section").alias(f"at_{x}"))
    e = graph.ranked(e.join(end("src", "a"), "src").join(end("dst", "b"), "dst"), "edge", F.col("src"), F.col("dst"))
    # edges have numbers below zero, so that no edge is taken for a node
    sides = [e.select(F.col(x).alias("node"), F.col(y).alias("other"), F.col(f"at_{y}").alias("key"), (-1 - F.col("edge")).alias("edge")) for x, y in ("ab", "ba")]
    sides = cut_lineage(sides[0].unionByName(sides[1]))
    lists = cut_lineage(_first(sides, 2 * most, "node", "key").unionByName(_first(sides, 2 * most, "node").withColumn("key", F.lit(None).cast("string"))))
    release(sides)
    starts = cut_lineage(n.filter("anchor").select(F.col("node").alias("seed"), "section", "id", F.md5(F.concat(F.lit(f"{seed}|"), "id")).alias("turn")))
    seen = cut_lineage(starts.select("seed", "section", F.col("seed").alias("node")))
    none = F.lit(None).cast("bigint")
    while True:
        keys = F.when(F.col("section") == "", F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit(""), "section"))
        wanted = seen.select("seed", "node", F.explode(keys).alias("wanted"))
        found = wanted.join(lists, (wanted.node == lists.node) & wanted.wanted.eqNullSafe(lists.key)).select("seed", wanted.node.alias("node"), "other", "edge")
        listed = _first(found, 2 * most, "seed", "node").select("seed", F.lit(LISTED).alias("kind"), "node", "other", "edge")
        first = starts.select("seed", F.lit(START).alias("kind"), F.col("seed").alias("node"), none.alias("other"), none.alias("edge"))
        known = seen.select("seed", F.lit(KNOWN).alias("kind"), "node", none.alias("other"), none.alias("edge"))
        rows = listed.unionByName(first).unionByName(known).repartition("seed").sortWithinPartitions("seed", "kind", "node", "other")
        claims = cut_lineage(rows.mapInArrow(_views(most), "unit bigint, owner bigint, at int, is_node boolean, complete boolean"))
        fresh = claims.filter("is_node").select(F.col("owner").alias("seed"), F.col("unit").alias("node")).join(seen, ["seed", "node"], "left_anti")
        fresh = cut_lineage(fresh.join(starts.select("seed", "section"), "seed").select("seed", "section", "node"))
        if fresh.isEmpty():
            break
        release(claims)
        more = cut_lineage(seen.unionByName(fresh))
        release(seen, fresh)
        seen = more
    inside = claims.filter("is_node").join(n.select(F.col("node").alias("unit"), "kinds"), "unit")
    has = [F.max(F.array_contains("kinds", k)).alias(f"has_{i}") for i, k in enumerate(required)]
    good = claims.groupBy("owner").agg(F.count("*").alias("n")).join(inside.groupBy("owner").agg(F.first("unit").alias("any"), *has), "owner")
    good = good.filter((F.col("n") >= least) & F.expr(" AND ".join(["true", *[f"has_{i}" for i in range(len(required))]])))
    good = cut_lineage(good.select("owner").join(starts.select(F.col("seed").alias("owner"), "turn"), "owner"))
    kept = _earliest(good, claims)
    named = claims.join(kept, "owner")
    node_names, edge_names = n.select(F.col("node").alias("unit"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst")), e.select((-1 - F.col("edge")).alias("unit"), "src", "dst")
    named = named.join(node_names.unionByName(edge_names), "unit")
    out = named.groupBy("owner").agg(F.min_by("src", "at").alias("community_id"), F.sort_array(F.collect_list(F.struct("at", "src", "dst"))).alias("used"))
    return out.select("community_id", F.transform(F.filter("used", lambda x: x["dst"].isNull()), lambda x: x["src"]).alias("nodes"), F.transform(F.filter("used", lambda x: x["dst"].isNotNull()), lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst"))).alias("edges"))


def _earliest(good: DataFrame, claims: DataFrame) -> DataFrame:
    """(owner) of the communities that stand: those whose anchor is in no earlier one that stands.

    In each round the ones without an earlier rival stand, and what they hold falls.
    """
    over = claims.filter("is_node AND unit != owner").select("owner", "unit").join(good, "owner").join(good.select(F.col("owner").alias("unit"), F.col("turn").alias("turn_under")), "unit").filter("turn < turn_under").select("owner", "unit")
    over, left, kept = cut_lineage(over), good.select("owner"), None
    while True:
        stand = cut_lineage(left.join(over.select(F.col("unit").alias("owner")), "owner", "left_anti"))
        kept = stand if kept is None else kept.unionByName(stand)
        fall = cut_lineage(over.join(stand, "owner", "left_semi").select(F.col("unit").alias("owner")).distinct())
        left = cut_lineage(left.join(stand, "owner", "left_anti").join(fall, "owner", "left_anti"))
        if left.isEmpty():
            return kept
        done = stand.unionByName(fall)
        over = cut_lineage(over.join(done, "owner", "left_anti").join(done.withColumnRenamed("owner", "unit"), "unit", "left_anti").select("owner", "unit"))
