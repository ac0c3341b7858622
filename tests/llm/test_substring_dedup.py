from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from brute import repeats
from weftgraph.llm import substring_dedup


def expected(docs, length):
    return Counter((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in repeats(docs, length))


def corpus(seed, length):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "Σ"]
    passages = [rng.choices(vocabulary, k=rng.randint(length - 2, 3 * length)) for _ in range(6)]
    docs = []
    for i in range(70):
        parts = [rng.choices(vocabulary, k=rng.randint(0, 2 * length)) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        docs.append((i * 7 % 71, rng.choice([" ", "  ", "\n"]).join(w for p in parts for w in p)))
    docs += [(200, docs[3][1]), (201, docs[3][1]), (201, docs[3][1]), (202, "same " * 4 * length), (203, "same " * 3 * length)]
    docs += [(300, None), (301, ""), (None, docs[3][1]), (302, " \t ")]
    return docs


@pytest.mark.parametrize("seed, length", [(1, 8), (2, 10), (3, 50), (4, 4)])
def test_matches_brute_force(spark, seed, length):
    docs = corpus(seed, length)
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, at int").repartition(3)
    rows = substring_dedup.find_repeats(frame, length=length).collect()
    assert Counter(tuple(r) for r in rows) == expected(docs, length)


def test_removal(spark):
    docs = [(d, t) for d, t in corpus(5, 10) if d is not None and t]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, source string")
    out = substring_dedup.remove_repeats(frame, length=10)
    assert out.columns == frame.columns
    assert Counter((r.doc_id, " ".join(r.text.split())) for r in out.collect()) == Counter((d, t) for d, _, _, t in repeats(docs, 10))


def test_empty_table(spark):
    assert substring_dedup.find_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_winnowing_picks_equal_windows_in_equal_runs():
    rng = np.random.default_rng(1)
    run = rng.integers(0, 5, 30).astype(np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(0, 5, rng.integers(0, 20)).astype(np.uint64), run, rng.integers(0, 5, 9).astype(np.uint64)]) for _ in range(2))
        found = [{p - (len(x) - 39) for p in substring_dedup.winnow(x, 8)} for x in (a, b)]
        for start in range(30 - 8 + 1):
            assert any(start <= p < start + 8 for p in found[0] & found[1])


def test_query_matches_brute_force(spark, sf001):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in substring_dedup.op10_substring_dedup(spark, sf001).collect()) == expected(docs, 50)


def test_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(20))
    frame = spark.createDataFrame([(1, text, 5, "r", 7), (2, f"a {text}", 6, "s", 8)], "doc_id long, text string, cut int, row_id string, key int")
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(frame, length=10).collect()}
    assert (out[1].text, out[1].cut, out[1].row_id, out[1].key) == (text, 5, "r", 7)
    assert (out[2].text.strip(), out[2].cut, out[2].row_id, out[2].key) == ("a", 6, "s", 8)
