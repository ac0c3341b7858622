from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

from brute import folded_words

from weftgraph.llm.resample import ImportanceResampler, op11_importance_resampling


def grams(text, most=2):
    w = folded_words(text or "")
    return w, [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=25, least=20, buckets=10_000, most=2):
    """[(doc_id, n_features, weight, score, rank)] in the order of the input."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    described = [(d, *grams(t, most)) for d, t in docs]
    s, t = Counter(bucket(g) for _, _, gs in described for g in gs), Counter(bucket(g) for x in target for g in grams(x, most)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for d, w, gs in described:
        weight = sum(gain[bucket(g)] for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    eligible = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_query_matches_brute_force(spark, sf001):
    read = lambda t, i: [(r[i], r.text) for r in spark.read.parquet(f"{sf001}/{t}.parquet").collect()]
    docs, target = read("documents", "doc_id"), [t for _, t in read("benchmark", "item_id")]
    same(op11_importance_resampling(spark, sf001).collect(), brute(docs, target))


LONG = "Alpha beta, GAMMA delta é über 漢字 " * 4


def test_nulls_ties_repeats_and_clashing_names(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, LONG), (5, LONG), (5, LONG + "more"), (None, LONG), (None, "two words"), (6, "x " * 20), (7, "x " * 19), (8, "Straße ſ É"), (9, "tab\tnew\nline " * 10)]
    docs += [(i, f"{LONG} {i % 5}") for i in range(20, 60)]
    target = [(1, "alpha beta gamma"), (2, None), (3, "")]
    frame = spark.createDataFrame([(d, t, "r", 1, 2.0) for d, t in docs], "doc_id long, text string, row string, bucket int, gain double")
    other = spark.createDataFrame([(i, t, 4) for i, t in target], "item_id long, text string, doc_id long")
    same(ImportanceResampler(frame, other).draw().collect(), brute(docs, [t for _, t in target]))
    same(ImportanceResampler(frame, other, grams=3, buckets=50).draw(percent=70, least_words=2).collect(), brute(docs, [t for _, t in target], 70, 2, 50, 3))


def test_ranks_run_over_partitions(spark):
    docs = [(i, f"w{i % 7} " * 25) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    rows = ImportanceResampler(frame, spark.createDataFrame([], "item_id long, text string")).draw().collect()
    same(rows, brute(docs, []))
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 101))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ImportanceResampler(none, none).draw().collect() == []
    same(ImportanceResampler(spark.createDataFrame([(1, None)], "doc_id long, text string"), none).draw().collect(), brute([(1, None)], []))


def test_very_long_text(spark):
    docs = [(1, "long text here " * 200_000), (2, "short one")]
    same(ImportanceResampler(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "long one")], "i long, text string")).draw().collect(), brute(docs, ["long one"]))
