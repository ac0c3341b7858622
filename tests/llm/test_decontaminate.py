from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from brute import contamination
from weftgraph.llm import decontaminate


def rows_of(docs, items, window):
    return Counter((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in contamination(docs, items, window))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of"] * 5 + [f"w{i}" for i in range(25)] + ["Été", "ÉTÉ", "x1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 20)))) for i in range(12)]
    items += [(50, None), (51, "!!"), (52, items[0][1]), (53, "the the the the the the")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(2)]
        if rng.random() < 0.5:
            words = (rng.choice(items)[1] or "").split()
            parts.insert(1, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.5 and w.isascii() else w for w in words[rng.randint(0, 3) :]))
        docs.append((i, " - ".join(parts)))
    return docs + [(100, None), (101, ""), (102, "the " * 40), (3, docs[3][1]), (None, items[0][1])], items


@pytest.mark.parametrize("seed, window", [(1, 5), (2, 10), (3, 3)])
def test_matches_brute_force(spark, seed, window):
    docs, items = corpus(seed)
    frame = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, words string").repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, seq int")
    found = decontaminate.find_contamination(frame, bench, window=window)
    assert Counter(tuple(r) for r in found.collect()) == rows_of(docs, items, window)
    kept = decontaminate.remove_contaminated(frame, bench, window=window)
    assert kept.columns == frame.columns
    clean = Counter(d for d, _, h, _ in contamination(docs, items, window) if not h)
    assert Counter(r.doc_id for r in kept.collect()) == clean


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.find_contamination(docs, none).collect()] == [False]
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.find_contamination(docs.limit(0), items).collect() == []


def test_proximity(spark):
    docs = [(1, "a x x b a"), (2, "b x x x a"), (3, "a")]
    found = decontaminate.near_terms(spark.createDataFrame(docs, "doc_id long, text string"), "a", "b", 3)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 3), (1, 4, 3)]


def test_query_matches_brute_force(spark, sf001):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf001}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert Counter(tuple(r) for r in decontaminate.op9_benchmark_decontamination(spark, sf001).collect()) == rows_of(docs, items, 10)


def test_rows_are_judged_by_their_own_text(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    leak = "so One two three four five six seven eight nine ten " + "filler " * 20_000
    docs = [(4, "clean"), (4, leak), (None, "one two three four five six seven eight nine ten"), (None, "clean"), (4, "clean")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = Counter((r.doc_id, r.n_words, r.n_hit) for r in decontaminate.find_contamination(frame, items).collect())
    assert found == Counter([(4, 1, 0), (4, 20_011, 10), (None, 10, 10), (None, 1, 0), (4, 1, 0)])
    kept = Counter((r.doc_id, r.text) for r in decontaminate.remove_contaminated(frame, items).collect())
    assert kept == Counter([(4, "clean"), (4, "clean"), (None, "clean")])


def test_windows_are_indexed_by_their_pairs_of_words(spark):
    items = spark.createDataFrame([(1, "one two three four"), (2, "five six"), (3, "one"), (4, None)], "item_id long, text string")
    docs = [(1, "x One two three, four five"), (2, "four three two four three"), (3, "five five six"), (4, "two three four one"), (5, "six")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.find_contamination(frame, items, window=3)
    assert Counter(tuple(r) for r in found.collect()) == rows_of(docs, [(1, "one two three four"), (2, "five six"), (3, "one"), (4, None)], 3)
    index, _, hits = decontaminate._lookup(frame, items.filter("item_id < 3"), 3)
    # of the second text all words occur in an item, but none of its pairs
    assert sorted((r.term, r.pos) for r in index.postings.collect()) == sorted([("one two", 1), ("two three", 2), ("three four", 3), ("five six", 1), ("two three", 0), ("three four", 1)])
    assert hits.count() == 4
