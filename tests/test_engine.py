from __future__ import annotations

import json
import pickle

import pytest
from pyspark.sql import functions as F

from weftgraph.plans import dag
from weftgraph.sources import readers, storage
from weftgraph.streaming import incremental


def test_read_mixed_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("type,content\ntext,from csv\ntext,\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.jsonl").write_text('{"type": "text", "content": "from jsonl"}\n')
    (tmp_path / "c.json").write_text('[{"type": "text", "content": "from json"}]')
    (tmp_path / "d.md").write_text("# whole\nfile")
    (tmp_path / "e.bin").write_text("ignored")
    spark.range(1).select(F.lit("text").alias("type"), F.lit("from parquet").alias("content")).write.parquet(str(tmp_path / "f"))
    out = readers.read(spark, str(tmp_path)).collect()
    assert sorted(r.content for r in out) == ["# whole\nfile", "from csv", "from json", "from jsonl", "from parquet"]
    assert len({r._trace_id for r in out}) == 5
    assert {r.suffix: r.n_files for r in readers.scan_stats(readers.scan_files(spark, str(tmp_path))).collect()}["csv"] == 1


def test_unknown_type_is_an_error(spark):
    with pytest.raises(Exception, match="unknown document type"):
        readers.validate(spark.createDataFrame([("movie", "x")], "type string, content string")).collect()


def test_pickle_needs_trust(spark, tmp_path):
    (tmp_path / "x.pickle").write_bytes(pickle.dumps([{"type": "text", "content": "p"}]))
    (tmp_path / "y.pickle").write_bytes(b"broken")
    with pytest.raises(PermissionError):
        readers.read_pickle(spark, str(tmp_path), "type string, content string")
    assert [r.content for r in readers.read_pickle(spark, str(tmp_path), "type string, content string", trusted=True).collect()] == ["p"]


def test_ntriples_and_graphml(spark, tmp_path):
    (tmp_path / "g.nt").write_text('<http://x/a> <http://p/name> "Ann"@en .\n<http://x/a> <http://p/knows> <http://x/b> .\n# note\n')
    [row] = readers.read_rdf(spark, str(tmp_path / "g.nt")).collect()
    assert row.content == "Ann" and row.properties["http://p/knows"] == ["http://x/b"]
    nodes = spark.createDataFrame([("A", "T", "d & <x>", "c", 4, 0.5)], "id string, entity_type string, description string, source_id string, length int, loss double")
    edges = spark.createDataFrame([("A", "A2", "e", "c", 1, 0.1)], "src string, dst string, description string, source_id string, length int, loss double")
    readers.write_graphml(nodes, edges, str(tmp_path / "out"))
    n, e = readers.read_graphml(spark, str(tmp_path / "out" / "part-*"))
    assert [tuple(r) for r in n.collect()] == [("A", "T", "d & <x>", "c", 4, 0.5)]
    assert [(r.src, r.dst, r.length) for r in e.collect()] == [("A", "A2", 1)]


def test_missing_libraries_say_so(spark):
    with pytest.raises(RuntimeError, match="converter"):
        readers.read_pdf(spark, "x.pdf")


def nodes(*edges):
    ids = dict.fromkeys(x for e in edges for x in e)
    return [{"id": i, "op_name": "op", "type": "map", "dependencies": [a for a, b in edges if b == i]} for i in ids]


def test_order_and_config_errors():
    assert [n.id for n in dag.Config.from_dict({"nodes": nodes(("a", "c"), ("b", "c"))}).ordered()] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        dag.Config.from_dict({"nodes": nodes(("a", "b"), ("b", "a"))}).ordered()
    with pytest.raises(ValueError, match="unknown dependencies"):
        dag.Config.from_dict({"nodes": [{"id": "a", "op_name": "x", "type": "map", "dependencies": ["zz"]}]}).ordered()
    with pytest.raises(ValueError, match="at least one"):
        dag.Config.from_dict({"nodes": []})
    with pytest.raises(ValueError, match="twice"):
        dag.Config.from_dict({"nodes": [{"id": "a", "op_name": "x", "type": "map"}] * 2})
    with pytest.raises(ValueError, match="unknown type"):
        dag.Node("a", "x", "banana")


def test_run_pipeline(spark, tmp_path):
    r = dag.Registry()
    r.register("numbers", lambda session, n: session.range(n))
    r.register("add", lambda rows, by: rows.withColumn("id", F.col("id") + by))
    config = dag.Config.from_dict({"global_params": {"by": 10, "other": 1}, "nodes": [{"id": "s", "op_name": "numbers", "type": "source", "params": {"n": 3}}, {"id": "m", "op_name": "add", "type": "map", "dependencies": ["s"]}, {"id": "u", "op_name": "add", "type": "aggregate", "dependencies": ["s", "m"], "params": {"by": 0}, "save_output": True}]})
    out = dag.run(spark, config, r, output=str(tmp_path))
    assert sorted(x.id for x in out["u"].collect()) == [0, 1, 2, 10, 11, 12]
    [saved] = (tmp_path / "config").glob("part-*")
    assert json.loads(saved.read_text())["global_params"]["by"] == 10


def test_kv_operations(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "_trace_id string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "_trace_id string, v int")
    as_dict = lambda df: {r._trace_id: r.v for r in df.collect()}
    assert as_dict(storage.upsert_if_absent(t, new)) == {"a": 1, "b": 2, "c": 3}
    assert as_dict(storage.update(t, new)) == {"a": 1, "b": 9, "c": 3}
    assert as_dict(storage.delete(t, new)) == {"a": 1}
    ids = spark.createDataFrame([(0, "b"), (1, "x"), (2, "a")], "ord int, _trace_id string")
    assert [r.v for r in storage.get_by_ids(t, ids, ["v"]).collect()] == [2, None, 1]


def test_ledger_processes_new_rows_once(spark, tmp_path):
    seen = []

    def operator(rows):
        seen.append(rows.count())
        return rows.select(F.concat(F.lit("o-"), "_trace_id").alias("_trace_id"), F.upper("content").alias("content"), F.col("_trace_id").alias("source_trace_id"))

    ledger = incremental.Ledger(spark, str(tmp_path / "l"), "up", "_trace_id string, content string")
    first = spark.createDataFrame([("1", "a"), ("2", "b")], "_trace_id string, content string")
    assert sorted(r.content for r in ledger.run(first, operator).collect()) == ["A", "B"]
    more = first.unionByName(spark.createDataFrame([("3", "c")], first.schema))
    assert sorted(r.content for r in ledger.run(more, operator).collect()) == ["A", "B", "C"]
    assert seen == [2, 1]
    more.write.parquet(str(tmp_path / "in"))
    docs = incremental.stream_documents(spark, str(tmp_path / "in"), "_trace_id string, content string")
    incremental.run_stream(docs, ledger, operator, str(tmp_path / "cp")).awaitTermination()
    assert ledger.outputs().count() == 3
