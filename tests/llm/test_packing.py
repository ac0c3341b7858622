from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import packing

PATH = packing.tokenizer_path()


def brute_plan(lengths, window):
    """Best fit decreasing, one piece at a time: remaining capacities of the windows."""
    rooms = []
    for s in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(window - s)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    used = defaultdict(list)
    seen = Counter()
    for r in packing.plan(Counter(lengths), 32):
        assert r.first == seen[r.length]
        seen[r.length] += r.count
        for i in range(r.count):
            used[r.window + i // r.each].append((r.offset + i % r.each * r.length, r.length))
    assert seen == Counter(lengths)
    rooms = []
    for held in used.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 32
        rooms.append(32 - at)
    assert sorted(used) == list(range(len(used)))
    assert sorted(rooms) == brute_plan(lengths, 32)


TEXTS = ["", None, "One  two\tthree.", "It's 42% été <|endoftext|> naïve x", "A" * 500, "\n\n", "ΣΑΣ é", "don't you're \x00 \x1f ok", " line \u0085next", "\U0001f600\U0001f600 hi"]


def test_ids_match_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    own = packing.WordTokenizer(PATH)
    for _ in range(2):
        ids, ends = own.encode(pa.array(TEXTS), 1)
        for text, a, b in zip(TEXTS, ends[:-1], ends[1:]):
            assert ids[a:b].tolist() == plain.encode(text or "", add_special_tokens=False).ids + [1]


def test_corpus_ids_match_the_tokenizer(spark, sf001):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    rows = spark.read.parquet(f"{sf001}/documents.parquet").select("text").limit(60).collect()
    ids, ends = packing.WordTokenizer(PATH).encode(pa.array([r.text for r in rows]), 1)
    for r, a, b in zip(rows, ends[:-1], ends[1:]):
        assert ids[a:b].tolist() == plain.encode(r.text, add_special_tokens=False).ids + [1]


def check(rows, docs, window):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    expected = Counter()
    for doc_id, text in docs:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for i in range(0, len(ids), window):
            part = ids[i : i + window]
            expected[doc_id, i, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected
    assert len(held) == len(brute_plan([r.length for r in rows], window))


def test_pack_with_edge_cases(spark):
    rng = random.Random(3)
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id"), (99, "word " * 700)]
    docs += [(100 + i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 90)))) for i in range(80)]
    frame = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, length int").repartition(3)
    check(packing.pack(frame, PATH, window=64).collect(), docs, 64)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_query_packs_every_document(spark, sf001):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    check(packing.op8_packing(spark, sf001).collect(), docs, 2048)


@pytest.mark.parametrize("least, expected", [(1, 4), (4, 4), (5, 9), (10, None)])
def test_capacity_tree(least, expected):
    tree = packing.CapacityTree(16)
    tree.add(4, 2)
    tree.add(9, 1)
    assert tree.tightest(least) == expected
