"""Pipelines from a configuration: nodes, their order, and running them as DataFrames.

A registered operator is ``f(inputs: DataFrame, **params) -> DataFrame``; a
source gets the session instead of inputs. Several dependencies are united by
name. Spark plans the whole chain; only ``save_output`` cuts it with a file.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from weftgraph.sources import storage

KINDS = ("source", "map", "filter", "flatmap", "aggregate", "map_batch")


@dataclass(frozen=True)
class Node:
    id: str
    op_name: str
    type: str
    params: dict[str, Any] = field(default_factory=dict)
    dependencies: tuple[str, ...] = ()
    execution_params: dict[str, Any] = field(default_factory=dict)
    save_output: bool = False

    def __post_init__(self) -> None:
        if self.type not in KINDS:
            raise ValueError(f"node {self.id}: unknown type {self.type}; known: {', '.join(KINDS)}")


@dataclass(frozen=True)
class Config:
    nodes: tuple[Node, ...]
    global_params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.nodes:
            raise ValueError("a configuration needs at least one node")
        ids = [n.id for n in self.nodes]
        if twice := sorted({i for i in ids if ids.count(i) > 1}):
            raise ValueError(f"node ids occur twice: {', '.join(twice)}")

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> Config:
        nodes = tuple(Node(**{k: tuple(v) if k == "dependencies" else v for k, v in n.items()}) for n in raw.get("nodes", []))
        return cls(nodes, raw.get("global_params", {}))

    def ordered(self) -> list[Node]:
        """Dependencies first; unknown ones and cycles are errors."""
        by_id = {n.id: n for n in self.nodes}
        if unknown := sorted({d for n in self.nodes for d in n.dependencies} - by_id.keys()):
            raise ValueError(f"unknown dependencies: {', '.join(unknown)}")
        out: list[Node] = []
        done: set[str] = set()
        while len(out) < len(self.nodes):
            ready = [n for n in self.nodes if n.id not in done and done.issuperset(n.dependencies)]
            if not ready:
                raise ValueError("the dependencies form a cycle")
            out += ready
            done.update(n.id for n in ready)
        return out


class Registry:
    def __init__(self) -> None:
        self.operators: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, f: Callable[..., DataFrame]) -> None:
        self.operators[name] = f

    def call(self, name: str, given: Any, params: dict[str, Any]) -> DataFrame:
        """Parameters are matched by name; those that the operator doesn't take are left out."""
        if name not in self.operators:
            raise KeyError(f"no operator {name}; known: {', '.join(sorted(self.operators))}")
        f = self.operators[name]
        names = inspect.signature(f).parameters
        open_ = any(p.kind is inspect.Parameter.VAR_KEYWORD for p in names.values())
        return f(given, **{k: v for k, v in params.items() if open_ or k in names})


def run(spark: SparkSession, config: Config, registry: Registry, *, output: str | None = None) -> dict[str, DataFrame]:
    """The result of every node; nodes with ``save_output`` are written below ``output`` and go on from there."""
    if output:
        storage.save_config(spark, {"global_params": config.global_params, "nodes": [n.__dict__ for n in config.nodes]}, output)
    results: dict[str, DataFrame] = {}
    for node in config.ordered():
        params = config.global_params | node.params
        if node.type == "source":
            given: Any = spark
        else:
            given = results[node.dependencies[0]]
            for other in node.dependencies[1:]:
                given = given.unionByName(results[other], allowMissingColumns=True)
            if replicas := node.execution_params.get("replicas"):
                given = given.repartition(int(replicas))
        out = registry.call(node.op_name, given, params)
        if node.save_output and output:
            out = storage.save_jsonl(out, output, node.id)
        results[node.id] = out
    return results
