from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from brute import contamination, near_components
from weftgraph.llm import packing, toxicity


def test_stages_match_brute_force(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf001}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").select("item_id", "text").collect()]
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).filter("predicted = 1").collect()}
    kept = [d for d in rows if d not in toxic]
    groups = defaultdict(list)
    for d in kept:
        groups[rows[d].text].append(d)
    kept = [max(g) for g in groups.values()]
    kept = sorted({c for _, c in near_components([(d, rows[d].text) for d in kept]).values()})
    hit = {d for d, _, n, _ in contamination([(d, rows[d].text) for d in kept], items) if n}
    kept = [d for d in kept if d not in hit]
    found = corpus_pipeline.run(spark, sf001).collect()
    assert {r.doc_id for r in found} == set(kept)
    counts = Counter(r.length for r in found)
    windows = 1 + max(x.window + (x.count - 1) // x.each for x in packing.plan(counts, 2048))
    assert len({r.sequence_id for r in found}) == windows


def test_stages_keep_the_columns(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf001)
        assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert corpus_pipeline.ORACLE_SQL is None


LONG_A, LONG_B = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
LEAK = " ".join(f"leak{i}" for i in range(15))


def folder(spark, path, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_null_ids_repeated_rows_and_null_texts(spark, tmp_path):
    texts = [(None, LONG_A), (None, LONG_A), (1, LONG_B), (1, LONG_B), (2, None), (3, ""), (4, "one"), (4, "other words"), (5, f"x {LEAK} y"), (6, "only copy"), (7, "only copy")]
    d = folder(spark, tmp_path, [(i, t, None, "s", None) for i, t in texts], [(1, LEAK), (2, None)])
    found = corpus_pipeline.run(spark, d).collect()
    rows = Counter((r.doc_id, r.doc_tokens) for r in found)
    # of equal texts one row stays, whatever its id; an id with two texts keeps both; the leak goes
    assert sorted((i is None, i or 0) for i, _ in rows) == sorted([(True, 0), (False, 1), (False, 3), (False, 4), (False, 4), (False, 7)])
    assert set(rows.values()) == {1} and all(r.length == r.doc_tokens for r in found)


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], [(1, LEAK)])).collect() == []


def test_stages_delete_what_no_later_step_reads(spark, sf001):
    from pathlib import Path

    from weftgraph.llm.common import shared_folder

    root = Path(shared_folder(spark), "weftgraph")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        before = set(root.glob("*/*"))
        stage(spark, spark.read.parquet(f"{sf001}/documents.parquet"), sf001)
        left = {p.name.rsplit("-", 1)[0] for p in set(root.glob("*/*")) - before}
        assert left - {"windows"} <= {"gone", "once"}, name
