from __future__ import annotations

import random

import numpy as np
import pytest

from brute import near_components
from weftgraph.llm import ngram_join


def result(frame, **kw):
    rows = ngram_join.link_documents(frame, **kw).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}, len(rows)


def corpus(seed, groups, copies):
    """Random texts, near copies of them with few edits, exact copies, shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=40)
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(3, 120))
        texts.append(base)
        for _ in range(rng.randint(0, copies)):
            near = list(base)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(near)
        if rng.random() < 0.3:
            texts.append(passage + base[:10])
    out = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed, groups, copies, short", [(1, 60, 3, 32), (2, 8, 60, 3), (3, 30, 12, 2), (4, 3, 150, 32)])
def test_matches_brute_force(spark, monkeypatch, seed, groups, copies, short):
    docs = corpus(seed, groups, copies)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    found, n = result(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert n == len(docs)
    assert found == near_components(docs)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "A  B\tC"), (6, "a b c d"), (7, "x"), (8, "one two three four five six"), (9, "ONE two three four five six"), (10, "É é")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, cls int")
    assert result(frame)[0] == near_components(docs)


def test_repeated_rows_and_empty_table(spark):
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f")]
    found = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 2, 1), (2, 2, 1), (2, 2, 1)]
    assert ngram_join.link_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_matches_brute_force(spark, sf001):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op6_ngram_jaccard_join(spark, sf001).collect()}
    assert found == near_components(docs)


def test_removal_keeps_one_of_each_component(spark):
    docs = corpus(5, 20, 3)
    frame = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, source string")
    kept = ngram_join.remove_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in near_components(docs).values()})


def test_frequent_shingles_ask_for_more_matches():
    assert ngram_join.choose_matches(np.zeros(40), 10, 4) == 1
    assert ngram_join.choose_matches(np.full(40, 1000.0), 10, 4) > 1


def test_signatures_never_exceed_the_shingles_apart():
    rng = np.random.default_rng(3)
    for n in (1, 100, 130, 3000, 9000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n * 4 // 5], rng.integers(0, 1 << 63, n // 4).astype(np.uint64)]))
        x, y = ngram_join.signature(a), ngram_join.signature(b)
        if len(x) != len(y):
            x, y = (v if len(v) == min(len(x), len(y)) else v[: len(v) // 2] ^ v[len(v) // 2 :] for v in (x, y))
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_null_ids_and_one_id_with_two_texts(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w3 ", "other ")
    rows = [(None, base), (7, near), (9, base), (4, "quite another text of some words here"), (4, near), (None, "x y"), (None, "x y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in ngram_join.link_documents(frame).collect()), key=str)
    assert found == sorted([(None, 56, 4), (7, 56, 4), (9, 56, 4), (4, 3, 4), (4, 56, 4), (None, 1, None), (None, 1, None)], key=str)
    kept = sorted((tuple(r) for r in ngram_join.remove_near_duplicates(frame).collect()), key=str)
    assert kept == sorted([(4, near), (4, "quite another text of some words here"), (None, "x y")], key=str)


def test_removal_of_repeated_rows_clashing_names_and_very_long_texts(spark):
    long_ = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, long_, "a", 1), (1, long_, "b", 2), (2, long_ + " end", "c", 3), (3, None, "d", 4), (3, None, "d", 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string, cls int")
    kept = ngram_join.remove_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.cls) for r in kept.collect() if r.doc_id != 3) in ([(1, 1)], [(1, 2)])
    assert kept.filter("doc_id = 3").count() == 2
    assert ngram_join.remove_near_duplicates(frame.limit(0)).collect() == []
