from __future__ import annotations

import base64
import random
import time

import pytest
import tiktoken
from pyspark.sql import functions as F

from weftgraph.functions import split as sp
from weftgraph.functions import tokens as tk

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TEXTS = ["", " ", "It's a test, isn't it?  Yes\n\n\ttwo", "naïve façade — 12,345 €", "知识图谱 的构建。", "a" * 5000, "🙂🙃 emoji", "\x00\x1f", "x" + " " * 3000 + "y"]


def plain_merge(piece, ranks):
    """The lowest pair merges, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == float("inf"):
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


@pytest.fixture(scope="module")
def tokenizer(spark):
    return tk.Tokenizer.from_file(spark, VOCABULARY)


@pytest.fixture(scope="module")
def ranks():
    with open(VOCABULARY, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_merges_equal_brute_force(ranks):
    rng = random.Random(5)
    for _ in range(300):
        piece = bytes(rng.choice(b"aabbenrst \xc3\xa9") for _ in range(rng.randrange(1, 40)))
        assert tk.merge(piece, ranks) == plain_merge(piece, ranks)
    small = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257, b"ab": 258, b"aab": 259}
    for _ in range(200):
        piece = bytes(rng.choice(b"aab") for _ in range(rng.randrange(1, 20)))
        assert tk.merge(piece, small) == plain_merge(piece, small)


def test_ids_and_round_trip(spark, tokenizer, ranks):
    other = tiktoken.Encoding("own", pat_str=tk.PIECES, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "i int, t string")
    rows = df.select("i", "t", tokenizer.encode("t").alias("ids"), tokenizer.count("t").alias("n")).select("*", tokenizer.decode("ids").alias("back")).collect()
    for r in rows:
        assert list(r.ids) == other.encode_ordinary(r.t or "") and r.n == len(r.ids) and r.back == (r.t or "")


def test_a_long_run_is_not_quadratic(ranks):
    rng, tokens = random.Random(2), {v: k for k, v in ranks.items()}
    piece = bytes(rng.choice(b"abcdefghij") for _ in range(200_000))
    start = time.perf_counter()
    assert b"".join(tokens[x] for x in tk.merge(piece, ranks)) == piece
    assert time.perf_counter() - start < 20


def test_decode_of_cut_characters_and_unknown_ids(spark, tokenizer):
    df = spark.createDataFrame([("cut", [64, 10**6]), ("none", None), ("empty", [])], "k string, ids array<int>")
    found = {r.k: r.t for r in df.select("k", tokenizer.decode("ids").alias("t")).collect()}
    assert found == {"cut": None, "none": None, "empty": ""}
    half = spark.createDataFrame([("é🙂",)], "t string").select(F.slice(tokenizer.encode("t"), 1, 2).alias("ids")).select(tokenizer.decode("ids").alias("t")).first().t
    assert half.startswith("é") and half.endswith("�")


def test_windows(spark, tokenizer):
    words = " ".join(f"word{i}" for i in range(400))
    df = spark.createDataFrame([(1, words, "x"), (2, "", "x"), (3, None, "x")], "doc_id int, text string, ord string")
    ids = df.filter("doc_id = 1").select(tokenizer.encode("text").alias("ids")).first().ids
    rows = sorted(tk.token_chunks(df, tokenizer, most=100, overlap=20).collect(), key=lambda r: r.ord)
    assert {r.doc_id for r in rows} == {1} and [r.ord for r in rows] == list(range(len(rows)))
    assert [r.n_tokens for r in rows] == [min(100, len(ids) - i) for i in range(0, len(ids), 80)]
    assert rows[0].content == words[: len(rows[0].content)]
    with pytest.raises(ValueError):
        tk.token_chunks(df, tokenizer, most=10, overlap=10)


def test_chunk_lengths_may_count_tokens(spark, tokenizer):
    docs = spark.createDataFrame([("d", "text", "some plain words here")], "_trace_id string, type string, content string")
    [row] = sp.chunk(docs, length=tokenizer.count).collect()
    assert row.length == 4


def test_a_vocabulary_needs_all_bytes(spark):
    with pytest.raises(ValueError):
        tk.Tokenizer(spark, {b"a": 0})
