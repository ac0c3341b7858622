from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup as ed
from weftgraph.llm.common import Workspace, components


def brute(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[t or ""].append(d)
    out = Counter()
    for d, t in docs:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        out[d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


def corpus():
    rng = random.Random(2)
    docs = [(i, rng.choice(["hot"] * 5 + [f"text {rng.randrange(60)}", "é " * 30])) for i in range(400)]
    return docs + [(500, None), (501, ""), (502, " "), (None, "hot"), (None, "alone"), (7, docs[7][1]), (600, "x" * 300_000), (601, "x" * 300_000)]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ed, "TASK_KEYS", 10)
    frame = spark.createDataFrame([(d, t, 1) for d, t in corpus()], "doc_id long, text string, n int").repartition(4)
    assert Counter(tuple(r) for r in ed.find_duplicates(frame).collect()) == brute(corpus())


def test_removal_keeps_one_row_of_each_text(spark):
    frame = spark.createDataFrame([(d, t, "s") for d, t in corpus() if d is not None], "doc_id long, text string, source string").repartition(3)
    kept = ed.remove_duplicates(frame)
    assert kept.columns == frame.columns
    rows = kept.collect()
    expected = {t or "": max(d for d, u in corpus() if d is not None and (u or "") == (t or "")) for d, t in corpus() if d is not None}
    assert Counter((r.text or "", r.doc_id) for r in rows) == Counter(expected.items())


def test_empty_table(spark):
    assert ed.find_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_filter_inserts_deletes_and_resizes():
    index = ed.DigestIndex(buckets=2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.add(k, i, 1)
    assert index.resized and index.size == 3000
    assert all(index.find(k)[1] == i for i, k in enumerate(keys))
    for k in keys[::2]:
        index.remove(k, 1)
    assert all((index.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))
    assert index.size == 1500
    false = sum(hashlib.sha256(f"no{i}".encode()).digest() in index.filter for i in range(5000))
    assert false < 50


def test_failed_insert_leaves_the_filter_as_it_was():
    f = ed.CuckooFilter(1)
    keys = [hashlib.sha256(bytes([i])).digest() for i in range(9)]
    held = [k for k in keys if f.insert(k)]
    assert len(held) == 4 and all(k in f for k in held)


def test_changes_to_a_live_index(spark):
    rows = lambda *r: ed.digests(spark.createDataFrame(r, "doc_id long, text string"))
    live = rows((1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "e"), (6, "e"), (6, "e"))
    index = ed.build_index(live)
    after = ed.apply_changes(index, live, rows((9, "b"), (10, "d"), (11, "c")), rows((2, "a"), (4, "c"), (6, "e"), (8, "never there")))
    text = {hashlib.sha256(t.encode()).digest(): t for t in "abcde"}
    assert {(text[bytes(r.sha)], r.top_id, r.n) for r in after.collect()} == {("a", 1, 1), ("b", 9, 2), ("c", 11, 1), ("d", 10, 1), ("e", 6, 2)}


def test_groups_are_verified_on_their_texts(spark):
    frame = spark.createDataFrame(corpus(), "doc_id long, text string")
    found = ed.find_duplicates(frame, short=lambda full: F.substring(full, 1, 1))
    assert Counter(tuple(r) for r in found.collect()) == brute(corpus())


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(500, i) for i in range(400, 499)]
    root = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if (root[a], root[b]) != (low, low):
                root[a] = root[b] = low
                changed = True
    found = {r.node: r.root for r in components(Workspace(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {k: v for k, v in found.items() if k != v} == {k: root[k] for k in linked if root[k] != k}


def test_removal_goes_by_row_where_ids_repeat_or_are_null(spark):
    docs = [(5, "A"), (5, "B"), (9, "B"), (None, "A"), (None, "C"), (None, "C"), (None, "D")]
    kept = ed.remove_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert Counter(tuple(r) for r in kept.collect()) == Counter([(5, "A"), (9, "B"), (None, "C"), (None, "D")])


def test_removal_of_null_and_empty_texts_repeats_and_clashing_names(spark):
    docs = [(1, None, 1), (1, "", 2), (1, "", 3), (2, "x", 4), (2, "x", 5), (3, "y", 6)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, key int")
    kept = ed.remove_duplicates(frame)
    assert kept.columns == frame.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter([(1, ""), (2, "x"), (3, "y")])
    assert ed.remove_duplicates(frame.limit(0)).collect() == []
