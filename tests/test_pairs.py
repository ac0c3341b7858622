"""Entity pairs: every pair of a document takes part in the ranking."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from itertools import combinations

import duckdb

from weftgraph.operators import baselines
from weftgraph.plans.catalogue import ORACLES, QUERIES


def best_pairs(words, most=10):
    ranked = sorted((hashlib.md5(f"{a}|{b}".encode()).hexdigest(), a, b) for a, b in combinations(sorted(set(words)), 2))
    return [(a, b) for _, a, b in ranked[:most]]


def drawn_word(rng):
    return "".join(rng.choices("abcdefgh", k=10))


def test_the_best_of_all_pairs_stay(spark):
    rng = random.Random(3)
    # up to 700 entities: several blocks, 244,650 pairs; with 64 draws other pairs stayed
    held = {doc: [drawn_word(rng) for _ in range(n)] for doc, n in enumerate((0, 1, 2, 6, 12, 13, 40, 256, 257, 700))}
    held[None] = ["nullnullnull", "othersother", "thirdsthird"]
    rows = [(doc, w) for doc, words in held.items() for w in words + words[:2]]
    found = defaultdict(list)
    for r in baselines.entity_pairs(spark.createDataFrame(rows, "doc_id long, entity string")).collect():
        found[r.doc_id].append((r.one, r.two))
    assert {doc: sorted(p) for doc, p in found.items()} == {doc: sorted(p) for doc, words in held.items() if (p := best_pairs(words))}


def test_query_ranks_all_pairs_of_all_languages(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "en" if i % 2 else "de", " ".join(drawn_word(rng).upper() if k % 3 else drawn_word(rng) for k in range(4 * i)) + " short") for i in range(12)]
    rows += [(3, "fr", "repeatedid againagain"), (None, "en", "withoutany identifier"), (None, None, "identifier different"), (20, "en", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = defaultdict(list)
    for doc, _, text in rows:
        words[doc] += [w for w in (text or "").lower().split() if len(w) >= 9]
    brute = sorted((str(doc), *p) for doc, w in words.items() for p in best_pairs(w))
    assert sorted((str(r.doc_id), r.one, r.two) for r in QUERIES["entity_pairs_topk"](spark, str(tmp_path)).collect()) == brute
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted((str(a), b, c) for a, b, c in con.execute(ORACLES["entity_pairs_topk"]).fetchall()) == brute
