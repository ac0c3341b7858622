"""Byte-pair tokens: encoding, counting and decoding as Arrow functions over a broadcast vocabulary.

A vocabulary is a text file with a base64 token and its rank on each line; its
size is fixed, whatever the corpus. Text is cut into pieces by a pattern and the
bytes of a piece are merged, lowest rank first.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from weftgraph.functions.split import token_windows

#: Fixed value: the published pattern of byte-level vocabularies.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces that a task remembers with their tokens, and the longest such piece in bytes.
REMEMBERED, LONGEST = 100_000, 64


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of the tokens of a piece: of adjacent parts the pair of lowest rank merges, the leftmost of equals first.

    Pairs wait in a heap and parts know where the next one starts, so a piece of
    n bytes takes n log n steps, however long.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that starts here; -1 and n lie outside
    rank_at = lambda i: ranks.get(piece[i : end[end[i]]]) if end[i] < n else None
    heap = [(r, i, end[i], end[end[i]]) for i in range(n) if (r := rank_at(i)) is not None]
    heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, middle, stop = heappop(heap)
        if gone[i] or end[i] != middle or end[middle] != stop:
            continue  # one of both parts has merged since
        gone[middle], end[i] = 1, stop
        if stop < n:
            before[stop] = i
        for j in (before[i], i):
            if j >= 0 and (r := rank_at(j)) is not None:
                heappush(heap, (r, j, end[j], end[end[j]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Tokenizer:
    """Columns of token ids from texts and back.

    ``encode`` and ``count`` take null as an empty text. ``decode`` undoes
    ``encode``; bytes that are no UTF-8, as where a window cuts a character, become
    U+FFFD, and a list with an id that the vocabulary lacks gives null.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str = PIECES) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.pattern, self._ranks = pattern, spark.sparkContext.broadcast(ranks)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, pattern: str = PIECES) -> Tokenizer:
        """From a file that the driver reads through Spark, so any file system will do."""
        lines = spark.read.text(path).filter("value != ''").collect()
        return cls(spark, {base64.b64decode(token): int(rank) for token, rank in (r.value.split() for r in lines)}, pattern)

    def _encoder(self):
        held, pattern = self._ranks, self.pattern
        known: dict[str, list[int]] = {}

        def encode(text: str | None) -> list[int]:
            ranks, out = held.value, []
            for m in regex.finditer(pattern, text or ""):
                piece = m.group()
                tokens = known.get(piece)
                if tokens is None:
                    raw = piece.encode()
                    tokens = merge(raw, ranks)
                    if len(raw) <= LONGEST and len(known) < REMEMBERED:
                        known[piece] = tokens
                out += tokens
            return out

        return encode

    def encode(self, text: Column | str) -> Column:
        encode = self._encoder()

        @pandas_udf("array<int>")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(encode)

        return run(text)

    def count(self, text: Column | str) -> Column:
        """The number of tokens; fits ``chunk(length=...)``."""
        encode = self._encoder()

        @pandas_udf("int")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: len(encode(t))).astype("int32")

        return run(text)

    def decode(self, ids: Column | str) -> Column:
        held = self._ranks
        tokens: dict[int, bytes] = {}

        @pandas_udf("string")
        def run(lists: pd.Series) -> pd.Series:
            if not tokens:
                tokens.update((rank, token) for token, rank in held.value.items())

            def one(xs) -> str | None:
                parts = [] if xs is None else [tokens.get(x) for x in xs]
                return None if xs is None or None in parts else b"".join(parts).decode("utf-8", errors="replace")

            return lists.map(one)

        return run(ids)


def token_chunks(docs: DataFrame, tokenizer: Tokenizer, *, id_column: str = "doc_id", text: str = "text", most: int = 1024, overlap: int = 128) -> DataFrame:
    """(id, ord, n_tokens, content): windows of at most ``most`` tokens that share ``overlap``; none for empty texts."""
    if not 0 <= overlap < most:
        raise ValueError("overlap must lie between 0 and the window's size")
    tokens = docs.select(id_column, tokenizer.encode(text).alias("tokens"))
    windows = tokens.select(id_column, F.explode(token_windows(F.col("tokens"), most, overlap)).alias("w"))
    return windows.select(id_column, "w.ord", F.col("w.n").alias("n_tokens"), F.trim(tokenizer.decode("w.tokens")).alias("content"))
