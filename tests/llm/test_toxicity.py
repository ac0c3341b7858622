from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from brute import lower
from weftgraph.llm import toxicity as tox


@pytest.fixture(scope="module")
def scored(spark):
    """Documents in which an insult is toxic only beside a group's mention."""
    rng = random.Random(1)
    plain = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(900):
        text = rng.choices(plain, k=rng.randint(5, 40))
        kind = i % 4
        if kind in (1, 3):
            text.insert(rng.randrange(len(text)), "Idiots,")
        if kind in (2, 3):
            text.insert(rng.randrange(len(text)), "foreigners")
        docs.append((i, " ".join(text), 0))
        labels.append((i, int(kind == 3)))
    docs += [(2000, None, 0), (2001, "", 0), (2002, "!!! ...", 0), (None, "word1", 0), (5, docs[5][1], 0), (2003, "foreigners idiots " * 20_000, 0)]
    labels += [(7, None), (None, 1), (4000, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score int").repartition(3)
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    return frame, labelled, tox.score(frame, tox.train(frame, labelled)).collect(), dict(labels)


def test_every_row_is_scored(scored):
    frame, _, rows, _ = scored
    assert len(rows) == frame.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_interaction_is_learned_on_held_out_rows(scored):
    rows = [r for r in scored[2] if r.held_out and r.doc_id < 900]
    right = sum(r.predicted == scored[3][r.doc_id] for r in rows)
    assert right >= 0.9 * len(rows)


def test_long_and_empty_texts(scored):
    by_id = {r.doc_id: r for r in scored[2]}
    assert by_id[2003].predicted == 1
    assert by_id[2000].score == by_id[2001].score == by_id[2002].score


def test_removal_keeps_columns_and_clean_rows(scored):
    frame, labels, rows, _ = scored
    kept = tox.remove_toxic(frame, labels)
    assert kept.columns == frame.columns
    assert kept.count() == sum(not r.predicted for r in rows)


def test_no_labels_and_empty_table(spark, scored):
    none = scored[1].limit(0)
    assert {r.score for r in tox.score(scored[0], tox.train(scored[0], none)).collect()} == {0.0}
    assert tox.score(scored[0].limit(0), None).collect() == []


def test_labels_of_held_out_rows_are_not_read(spark, scored):
    frame, labels, _, _ = scored
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = tox.train(frame, labels), tox.train(frame, flipped)
    assert np.array_equal(a.w, b.w) and a.bias == b.bias


def test_accuracy_on_the_driver_tables(spark):
    folder = "/root/testdata/sf0.01"
    rows = tox.op4_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    train = [r for r in rows if not r.held_out]
    assert sum(r.predicted == r.toxic for r in train) >= 0.97 * len(train)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)


def test_query_matches_the_naive_sum_over_all_pairs(spark, sf001):
    docs, labels = spark.read.parquet(f"{sf001}/documents.parquet"), spark.read.parquet(f"{sf001}/labels.parquet")
    model = tox.train(docs, labels)
    found = {r.doc_id: r for r in tox.op4_toxicity(spark, sf001).collect()}
    assert len(found) == docs.count()
    for doc_id, text in docs.select("doc_id", "text").collect():
        slots = {s for word in lower(text).encode().split() for s in model.word_slots(word)}
        active = sorted(slots)
        logit = model.bias + sum(model.w[i] for i in active) + sum(float(model.v[i] @ model.v[j]) for k, i in enumerate(active) for j in active[k + 1 :])
        assert abs(found[doc_id].score - 1 / (1 + np.exp(-np.clip(logit, -30, 30)))) < 1e-9
        assert found[doc_id].predicted == int(found[doc_id].score >= 0.7)


def test_choice_counts_terms_that_tell_only_beside_others():
    rng, rows = np.random.default_rng(0), []
    for _ in range(6000):
        insult, group = rng.random() < 0.3, rng.random() < 0.03
        toxic = group or rng.random() < 0.55 if insult else not group and rng.random() < 0.2
        rows.append((int(toxic), np.array([1] * insult + [2] * group + [int(rng.integers(10, 400))], np.int32)))
    y, of = np.array([r[0] for r in rows], float), np.repeat(np.arange(6000), [len(r[1]) for r in rows])
    buckets = np.concatenate([r[1] for r in rows])
    assert tox._chi_squared(buckets, y, of)[0][2] < 10.8
    assert {1, 2} <= set(tox.choose(buckets, y, of, least=3, level=10.8).tolist())
