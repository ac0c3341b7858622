"""The stream of blocks in one worker, without Spark."""

from __future__ import annotations

import pyarrow as pa
import pytest

from weftgraph.operators import growth


def stream(rows, size=3):
    names = ("block", "src", "dst", "length", "loss", "starts")
    return iter([pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows[k : k + size]], pa.string() if i < 3 else None) for i, n in enumerate(names)}) for k in range(0, len(rows), size)])


@pytest.mark.parametrize("mode", ["bfs", "dfs", "ece"])
def test_a_unit_is_hashed_once(mode, monkeypatch):
    calls = []
    real = growth.hashlib.md5
    monkeypatch.setattr(growth.hashlib, "md5", lambda x: calls.append(x) or real(x))
    nodes = sorted(["hub", *[f"n{i:02d}" for i in range(20)]])
    edges = sorted({tuple(sorted(p)) for i in range(20) for p in (("hub", f"n{i:02d}"), (f"n{i:02d}", f"n{(i + 1) % 20:02d}"))})
    rows = [("x", n, None, 1, 0.5, True) for n in nodes] + [("x", a, b, 1, 0.5, True) for a, b in edges] + [("y", "lone", None, 1, 0.5, True), ("y", "far", "lone", 1, 0.5, True)]
    out = [r for b in growth._streamed(growth.Rule(mode, 5))(stream(rows)) for r in b.to_pylist()]
    assert sorted(n for r in out for n in r["nodes"]) == sorted([*nodes, "lone"])
    assert sorted((e["src"], e["dst"]) for r in out for e in r["edges"]) == sorted([*edges, ("far", "lone")])
    assert len(calls) == len(rows)


def test_areas_end_when_nothing_new_is_reached(spark, monkeypatch):
    cuts = []
    real = growth.cut_lineage
    monkeypatch.setattr(growth, "cut_lineage", lambda df: cuts.append(1) or real(df))
    monkeypatch.setattr(growth, "AREA_ROUNDS", 50)
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(12)], "id bigint, name string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src bigint, dst bigint")
    found = {r.id: r.area for r in growth.areas(nodes, edges, 1).collect()}
    assert sorted(set(found.values())) == list(range(12)) and len(cuts) <= 4
