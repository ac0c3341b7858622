"""Subgraph selection around image seeds: neighbourhoods, scores, gates, sessions.

Ranking and scoring are joins and expressions. The session with a selector and
a judge is sequential per seed by nature: one grouped Arrow call per seed runs
it on the seed's neighbourhood, which is joined beforehand.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as tx
from weftgraph.operators import graph

#: Terms that mark technical content, by subject.
KEYWORDS = {
    "timing": ["timing", "latency", "trcd", "trp", "tras", "cas", "activate", "precharge", "read", "write", "cycle", "delay"],
    "architecture": ["bank", "channel", "rank", "row", "column", "array", "controller", "path", "topology", "architecture", "organization", "block"],
    "performance": ["bandwidth", "throughput", "performance", "speed", "faster", "slower", "improve", "penalty", "efficiency"],
    "comparison": ["compare", "difference", "versus", "higher", "lower", "better", "worse", "tradeoff"],
    "constraint": ["constraint", "depends", "requires", "limit", "before", "after", "impact", "cause", "affect"],
}
#: What counts as a word where two nodes are compared.
WORD = r"[a-zA-Z][a-zA-Z0-9_\-/]{2,}"
#: Thresholds of the judge's gate; ``hallucination_risk`` is an upper bound.
GATE = {"image_indispensability": 0.65, "answer_stability": 0.6, "evidence_closure": 0.6, "technical_relevance": 0.6, "hallucination_risk": 0.45, "overall_score": 0.68}
FAMILIES = ("atomic", "aggregated", "multi_hop")


def image_seeds(nodes: DataFrame) -> DataFrame:
    """Nodes whose type holds IMAGE or whose metadata names an image."""
    m = tx.metadata_map(F.col("metadata"))
    path = F.coalesce(F.nullif(m["img_path"], F.lit("")), F.nullif(m["image_path"], F.lit("")))
    return nodes.filter(F.contains(F.upper("entity_type"), F.lit("IMAGE")) | path.isNotNull())


def scopes(nodes: DataFrame) -> DataFrame:
    """(id, scope): source ids and the trace ids of the metadata."""
    m = tx.metadata_map(F.col("metadata"))
    extra = F.filter(F.array(m["source_trace_id"], m["chunk_id"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return nodes.select("id", F.array_distinct(F.concat(tx.source_ids(F.coalesce("source_id", F.lit(""))), extra)).alias("scope"))


def neighborhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 4) -> DataFrame:
    """(seed, id, distance) up to four hops; from the second hop on nodes share the seed's scope."""
    hops = min(hops, 4)
    found = graph.k_hop(edges, seeds, 1)
    if hops == 1:
        return found
    s = scopes(nodes)
    near = graph.neighbors(edges)
    frontier = found.filter("distance = 1")
    for hop in range(2, hops + 1):
        step = frontier.select("seed", "id").join(near, "id").select("seed", F.col("other").alias("id")).distinct().join(found.select("seed", "id"), ["seed", "id"], "left_anti")
        step = step.join(s.select(F.col("id").alias("seed"), F.col("scope").alias("seed_scope")), "seed").join(s, "id").filter(F.arrays_overlap("seed_scope", "scope"))
        frontier = graph.cut_lineage(step.select("seed", "id", F.lit(hop).alias("distance")))
        found = found.unionByName(frontier)
    return found


def keyword_hits(text: Column) -> Column:
    """The number of technical terms that occur in the text, as words or inside of some."""
    low = F.lower(text)
    terms = F.array(*[F.lit(w) for held in KEYWORDS.values() for w in held])
    return F.size(F.filter(terms, lambda w: F.contains(low, w)))


def node_words(name: Column, description: Column, evidence: Column) -> Column:
    said = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (name, description, evidence)])
    return F.array_distinct(F.regexp_extract_all(F.lower(said), F.lit(WORD), F.lit(0)))


def rank_nodes(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, id, score, rank): the seed first, then by evidence, closeness and technical terms; by score then id, both descending."""
    joined = near.join(nodes.select("id", "evidence_span", "description"), "id")
    score = F.when(F.trim(F.coalesce("evidence_span", F.lit(""))) != "", 1.0).otherwise(0.0) + F.greatest(F.lit(0.0), 0.6 - 0.1 * F.col("distance")) + 0.15 * keyword_hits(F.concat_ws("\n", "description", F.col("id").cast("string")))
    out = joined.withColumn("score", F.round(score, 6))
    order = (F.when(F.col("id") == F.col("seed"), 0).otherwise(1), F.desc("score"), F.desc("id"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(*order))).select("seed", "id", "distance", "score", "rank")


def candidates(selected: DataFrame, nodes: DataFrame, edges: DataFrame, *, max_depth: int = 3) -> DataFrame:
    """Unselected neighbours of selected nodes (seed, id, depth) with uid, depth and score, in order.

    A candidate shares the seed's scope, or neither node nor edge has one. The
    score is 0.12 for each word that it shares with the node it hangs on, 0.12 if
    their edge has a relation and 0.08 if it has evidence, rounded to four digits.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "relation_type", F.col("evidence_span").alias("edge_evidence"), F.col("source_id").alias("edge_source"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "relation_type", "edge_evidence", "edge_source"))
    out = selected.select("seed", F.col("id").alias("a"), "depth").join(both, "a").join(selected.select("seed", F.col("id").alias("b")), ["seed", "b"], "left_anti")
    s = scopes(nodes)
    out = out.join(s.select(F.col("id").alias("seed"), F.col("scope").alias("seed_scope")), "seed").join(s.select(F.col("id").alias("b"), "scope"), "b")
    said = nodes.select("id", node_words(F.col("id").cast("string"), F.col("description"), F.col("evidence_span")).alias("words"))
    out = out.join(said.select(F.col("id").alias("a"), F.col("words").alias("words_a")), "a").join(said.select(F.col("id").alias("b"), F.col("words").alias("words_b")), "b")
    edge_scope = tx.source_ids(F.coalesce("edge_source", F.lit("")))
    free = (F.size("scope") == 0) & (F.size(edge_scope) == 0)
    out = out.filter(free | F.arrays_overlap("seed_scope", F.concat("scope", edge_scope))).withColumn("depth", F.col("depth") + 1).filter(F.col("depth") <= max_depth)
    shared = F.size(F.array_intersect("words_a", "words_b"))
    score = 0.12 * shared + F.when(F.coalesce("relation_type", F.lit("")) != "", 0.12).otherwise(0.0) + F.when(F.coalesce("edge_evidence", F.lit("")) != "", 0.08).otherwise(0.0)
    out = out.select("seed", F.concat_ws("|", F.least("a", "b"), F.greatest("a", "b"), "b").alias("uid"), F.col("a").alias("parent"), F.col("b").alias("id"), "depth", F.round(score, 4).alias("score"), "relation_type")
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("seed").orderBy("depth", F.desc("score"), "uid")))


def cap_prompt(cands: DataFrame, most: int, salt: str) -> DataFrame:
    """At most ``most`` candidates a seed: those of its document by rank, the rest by salted hash."""
    order = Window.partitionBy("seed").orderBy(F.when(F.col("same_doc"), 0).otherwise(1), F.when(F.col("same_doc"), F.col("ord")), F.sha2(F.concat(F.lit(salt + ":"), "uid"), 256))
    return cands.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")


def runtime_schema(near: DataFrame, nodes: DataFrame, preview: int = 8) -> DataFrame:
    """(seed, type, n, rank): the commonest node types, four to twelve of them."""
    most = max(4, min(12, preview))
    n = near.join(nodes.select("id", "entity_type"), "id").groupBy("seed", F.col("entity_type").alias("type")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("n"), "type"))).filter(F.col("rank") <= most)


def passes_gate(scores: Column) -> Column:
    """The judge's thresholds on a map of scores; a missing score fails."""
    value = lambda k: F.try_element_at(scores, F.lit(k))
    tests = [value(k) <= t if k == "hallucination_risk" else value(k) >= t for k, t in GATE.items()]
    out = tests[0]
    for test in tests[1:]:
        out &= test
    return F.coalesce(out, F.lit(False))


def diverse_themes(options: Column, most: int = 3) -> Column:
    """Greedy choice from array<struct<score,focus,nodes>> by falling score.

    One joins the chosen if its nodes overlap each by a Jaccard of at most 0.55
    and its focus differs or its score is 0.18 or more away.
    """
    empty = F.slice(options, 1, 0)

    def add(chosen: Column, x: Column) -> Column:
        def apart(y: Column) -> Column:
            union = F.size(F.array_union(x["nodes"], y["nodes"]))
            near = F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x["nodes"], y["nodes"])) / union)
            return (near <= 0.55) & ((x["focus"] != y["focus"]) | (F.abs(x["score"] - y["score"]) >= 0.18))

        return F.when((F.size(chosen) < most) & F.forall(chosen, apart), F.concat(chosen, F.array(x))).otherwise(chosen)

    return F.aggregate(F.reverse(F.array_sort(options)), empty, add)


@dataclass
class Session:
    """The selection of one family around one seed; pure given the model's replies."""

    seed: str
    family: str
    near: dict[str, list[dict]]
    ask: Callable[[str, dict], dict]
    max_steps: int = 4
    max_rollbacks: int = 1
    max_errors: int = 2
    nodes: list[str] = field(default_factory=list)
    edges: list[tuple[str, str]] = field(default_factory=list)

    LEAST = {"atomic": 1, "aggregated": 2, "multi_hop": 2}

    def pool(self, blocked: set[str]) -> list[dict]:
        held, ends = set(self.nodes), [self.nodes[-1]] if self.family == "multi_hop" else self.nodes
        out = {c["id"]: c for n in ends for c in self.near.get(n, []) if c["id"] not in held and c["id"] not in blocked}
        return sorted(out.values(), key=lambda c: (-c["score"], c["id"]))

    def complete(self) -> bool:
        grown = len(self.nodes) - 1
        return grown == 1 if self.family == "atomic" else grown >= self.LEAST[self.family]

    def run(self) -> dict:
        self.nodes, self.edges = [self.seed], []
        intent = self.ask("bootstrap", {"seed": self.seed, "family": self.family})
        if not isinstance(intent.get("forbidden_patterns"), list) or not intent.get("intent"):
            return self.end("abstained", "bootstrap_invalid")
        forbidden = [str(p).lower() for p in intent["forbidden_patterns"][:8]]
        blocked = {c["id"] for held in self.near.values() for c in held if any(p and p in f"{c['id']} {c.get('text', '')}".lower() for p in forbidden)}
        first = self.pool(set())
        if not first:
            return self.end("abstained", "bootstrap_empty")
        if not self.pool(blocked):
            if self.family != "atomic":
                return self.end("abstained", "candidate_pool_exhausted")
            at = int(hashlib.sha256(f"{self.seed}:{self.family}".encode()).hexdigest(), 16) % len(first)
            self.take(first[at])
            return self.end("accepted", "fallback")
        steps = rollbacks = errors = 0
        while steps < self.max_steps:
            pool = self.pool(blocked)
            if not pool:
                return self.end("abstained", "candidate_pool_exhausted")
            pick = self.ask("select", {"pool": [c["id"] for c in pool], "nodes": list(self.nodes), "family": self.family})
            if pick.get("decision") == "stop_selection":
                return self.end("abstained", "selector_stop_requested")
            chosen = next((c for c in pool if c["id"] == pick.get("node_id")), None)
            if pick.get("decision") != "select_candidate" or chosen is None:
                errors += 1
                if errors >= self.max_errors:
                    return self.end("abstained", "invalid_selection_repeated" if pick.get("decision") == "select_candidate" else "selector_protocol_error")
                continue
            before = list(self.nodes), list(self.edges)
            steps += 1
            self.take(chosen)
            verdict = self.ask("judge", {"nodes": list(self.nodes), "edges": list(self.edges), "family": self.family})
            decision, scores = verdict.get("decision"), verdict.get("scores")
            if decision == "accept" and self.gate(scores) and self.complete():
                return self.end("accepted", verdict.get("termination_reason") or "accepted")
            if decision in ("accept", "continue") and isinstance(scores, dict):
                continue
            if decision == "reject":
                return self.end("rejected", verdict.get("termination_reason") or "rejected")
            if rollbacks >= self.max_rollbacks:
                return self.end("abstained", "max_rollbacks_reached" if decision == "rollback_last_step" else "judge_protocol_error")
            rollbacks += 1
            self.nodes, self.edges = before
            blocked.add(chosen["id"])
        return self.end("abstained", "max_steps_reached")

    def take(self, candidate: dict) -> None:
        self.nodes.append(candidate["id"])
        self.edges.append((candidate["parent"], candidate["id"]))

    @staticmethod
    def gate(scores: object) -> bool:
        if not isinstance(scores, dict):
            return False
        return all(k in scores and (scores[k] <= t if k == "hallucination_risk" else scores[k] >= t) for k, t in GATE.items())

    def end(self, status: str, reason: str) -> dict:
        ok = status == "accepted"
        return {"seed": self.seed, "qa_family": self.family, "status": status, "reason": reason, "nodes": self.nodes if ok else [], "edges": self.edges if ok else []}


SESSION_OUT = "seed string, qa_family string, status string, reason string, nodes array<string>, edges array<struct<src:string,dst:string>>"


def sample_families(pairs: DataFrame, ask: Callable[[str, dict], dict], *, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """One row per seed and family from candidate pairs (seed, parent, id, score, text)."""

    def per_seed(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[dict]] = {}
        for r in pdf.to_dict("records"):
            near.setdefault(r["parent"], []).append(r)
        rows = [Session(str(pdf["seed"].iloc[0]), f, near, ask).run() for f in families]
        for r in rows:
            r["edges"] = [{"src": a, "dst": b} for a, b in r["edges"]]
        return pd.DataFrame(rows)

    return pairs.groupBy("seed").applyInPandas(per_seed, SESSION_OUT)


def stub_ask(kind: str, state: dict) -> dict:
    """Deterministic replies: select the best candidate and accept a complete selection."""
    if kind == "bootstrap":
        return {"intent": f"{state['family']} question", "forbidden_patterns": []}
    if kind == "select":
        return {"decision": "select_candidate", "node_id": state["pool"][0]}
    scores = {k: 0.3 if k == "hallucination_risk" else 0.9 for k in GATE}
    return {"decision": "accept", "scores": scores, "termination_reason": "accepted"}


def model_ask(model) -> Callable[[str, dict], dict]:
    """Session replies from a language model's JSON."""

    def ask(kind: str, state: dict) -> dict:
        reply = model.answer(f"Task: {kind}. State: {json.dumps(state)}. Reply with one JSON object.")
        start, end = reply.find("{"), reply.rfind("}")
        try:
            return dict(json.loads(reply[start : end + 1]))
        except ValueError:
            return {}

    return ask


def materialize(selected: DataFrame, nodes: DataFrame, edges: DataFrame, *, virtual: bool = False) -> DataFrame:
    """Node and edge rows behind accepted selections; ``virtual`` adds an image root that copies the seed."""
    ok = selected.filter("status = 'accepted'").withColumn("community_id", F.concat_ws("#", "seed", "qa_family"))
    out = graph.community_payloads(ok.select("community_id", "nodes", "edges"), nodes, edges).join(ok.select("community_id", "seed", "qa_family"), "community_id")
    return out.withColumn("virtual_root", F.concat("seed", F.lit("::virtual_image"))) if virtual else out
