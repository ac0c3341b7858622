"""Substring deduplication by level-wise doubling.

A window is a run of consecutive words of one document. The first level is the
wanted length halved as long as it is even and 25 or more (50: 25; 400: 25, 50,
100, 200). Only windows that repeat in another document at one level are
extended to twice that length, until the wanted length is reached or no
candidate survives.

The first level doesn't index every window. It takes the windows that are
minimal by hash among those inside some run of twice the length (winnowing):
equal runs pick equal windows, so a repeated run always has a repeated
first-level window at the same place. Each further level reads only documents
with a surviving window and emits the windows around survivors. At the wanted
length, windows whose smallest document is another one mark the words they
cover. There windows are told apart by two independent 64-bit hashes, as words
are removed; at the levels before by one, as a false repeat only costs time.

Repeats are found by grouped minima and maxima with map-side combining. They
are joined back on the hash, frequent ones by broadcast, so a passage that a
third of the corpus holds is never gathered in one place.

Defined cases: a null text has no words; documents shorter than a window lose
nothing; a window counts as repeated only in a document with a smaller id, so
rows repeated with one id don't remove each other, and rows with a null id
neither remove nor lose words; an empty table gives an empty result; further
columns are ignored, or kept by ``remove_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import Workspace, bounded, gram_hashes, join_hot, pieces, restrict, signed, split_words, tidy, word_hashes

#: What tells the rows of documents apart.
ROW = ["row_id", "doc_id"]


def first_level(length: int) -> int:
    """The length halved while it is even and stays 25 or more; once at least."""
    half = length // 2
    while half % 2 == 0 and half >= 50:
        half //= 2
    return half


def _emit(batch: pa.RecordBatch, offsets: np.ndarray, rows: list[np.ndarray], places: list[np.ndarray], grams: np.ndarray, second: np.ndarray | None) -> pa.RecordBatch:
    rows, places = np.concatenate(rows), np.concatenate(places)
    of = pa.array(rows)
    check = pa.nulls(len(rows), pa.int64()) if second is None else pa.array(signed(second[places]))
    return pa.RecordBatch.from_arrays([pa.array(signed(grams[places])), check, batch.column("row_id").take(of), batch.column("doc_id").take(of), pa.array((places - offsets[rows]).astype(np.int32))], ["gram", "check", "row_id", "doc_id", "at"])


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """Positions that hold the (leftmost) minimum of some ``span`` consecutive grams."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    return np.unique(np.argmin(view, axis=1) + np.arange(len(view)))


def _anchors(half: int, least: int):
    """Winnowed windows of ``half`` words, of documents with ``least`` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            offsets, flat = split_words(batch.column("text"), lower=False)
            grams = gram_hashes(word_hashes(flat), half)
            rows, places = [], []
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if b - a >= least:
                    found = winnow(grams[a : b - half + 1], half + 1)
                    places.append(found + a)
                    rows.append(np.full(len(found), row))
            if rows:
                yield _emit(batch, offsets, rows, places, grams, None)

    return run


def _extend(length: int, half: int, last: bool):
    """Windows of ``length`` words that contain a surviving window of ``half`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            offsets, flat = split_words(batch.column("text"), lower=False)
            grams = gram_hashes(word_hashes(flat), length)
            second = gram_hashes(word_hashes(flat, 1), length) if last else None
            rows, places = [], []
            for row, at in enumerate(batch.column("at")):
                a, n = int(offsets[row]), int(offsets[row + 1] - offsets[row])
                if n < length:
                    continue
                at = at.values.to_numpy().astype(np.int64)
                edge = np.zeros(n + 2, np.int32)
                np.add.at(edge, np.maximum(at - (length - half), 0), 1)
                np.add.at(edge, np.minimum(at, n - length) + 1, -1)
                found = np.flatnonzero(np.cumsum(edge[: n - length + 1]) > 0)
                places.append(found + a)
                rows.append(np.full(len(found), row))
            if rows:
                yield _emit(batch, offsets, rows, places, grams, second)

    return run


def _words_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        offsets, flat = split_words(batch.column("text"), lower=False)
        n = np.diff(offsets)
        kept = [hashlib.sha256(t).hexdigest() for t in _joined(flat, offsets, None)]
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(n), pa.array(kept)], ["row_id", "doc_id", "n_words", "kept_sha256"])


def _joined(flat: pa.Array, offsets: np.ndarray, keep: np.ndarray | None) -> Iterator[bytes]:
    words = flat.cast(pa.binary())
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        part = words.slice(a, b - a)
        if keep is not None:
            part = part.filter(pa.array(keep[a:b]))
        yield b" ".join(part.to_pylist())


def _cover(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            offsets, flat = split_words(batch.column("text"), lower=False)
            keep = np.ones(len(flat), bool)
            for row, at in enumerate(batch.column("at")):
                a, n = int(offsets[row]), int(offsets[row + 1] - offsets[row])
                at = at.values.to_numpy()
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                keep[a : a + n] = np.cumsum(edge)[:n] == 0
            sums = np.concatenate([[0], np.cumsum(~keep)])
            removed = sums[offsets[1:]] - sums[offsets[:-1]]
            texts = list(_joined(flat, offsets, keep))
            arrays = [batch.column("row_id"), batch.column("doc_id"), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            names = ["row_id", "doc_id", "n_removed", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array([t.decode("utf-8", "replace") for t in texts])], [*names, "text"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


class SubstringDedup:
    """Repeated windows of ``length`` (even) words over a table of documents."""

    def __init__(self, docs: DataFrame, *, length: int = 50):
        if length < 4 or length % 2:
            raise ValueError("length must be even and at least 4")
        self.ws, self.length = Workspace(docs.sparkSession, "substring-dedup"), length
        self.kind = docs.schema["doc_id"].dataType.simpleString()
        # rows are told apart by their id and a hash of id and text: equal rows have equal results
        self.docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_id"))

    def _places(self, found: DataFrame) -> DataFrame:
        """Documents (row_id, doc_id, text) with the positions ``at`` of ``found``; each is gathered by its own row only."""
        per_row = self.ws.table("places", found.groupBy(*ROW).agg(F.sort_array(F.collect_set("at")).alias("at")))
        texts = restrict(self.docs, per_row.select(*ROW), per_row.count(), ROW).dropDuplicates(ROW)
        return texts.join(per_row, ROW)

    def _repeated(self, level: DataFrame, on: list[str]) -> DataFrame:
        """(on, low, n) of windows that stand in two documents or more: the smallest id and the number of windows."""
        seen = level.groupBy(*on).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
        return self.ws.table("repeated", seen.filter("low != high").select(*on, "low", "n"))

    def windows(self) -> DataFrame:
        """(row_id, at): starts of windows whose words also start in a document with a smaller id."""
        schema = f"gram bigint, check bigint, row_id bigint, doc_id {self.kind}, at int"
        width = first_level(self.length)
        level = self.ws.table("level", self.docs.filter("doc_id IS NOT NULL").mapInArrow(tidy(_anchors(width, 2 * width)), schema))
        while width < self.length:
            survivors = join_hot(level, self._repeated(level, ["gram"]), ["gram"]).select(*ROW, "at")
            held = self._places(survivors)
            self.ws.drop(level)
            last = 2 * width == self.length
            level = self.ws.table("level", held.mapInArrow(tidy(_extend(2 * width, width, last)), schema))
            width *= 2
            if level.isEmpty():
                return level.select(*ROW, "at")
        # ``low`` decides who keeps the words
        window = ["gram", "check"]
        found = join_hot(level, self._repeated(level, window), window).filter("doc_id > low")
        return self.ws.table("found", found.select(*ROW, "at"))

    def report(self) -> DataFrame:
        """Per document: doc_id, n_words, n_removed, kept_sha256."""
        whole = self.docs.mapInArrow(tidy(_words_only), f"row_id bigint, doc_id {self.kind}, n_words bigint, kept_sha256 string")
        cut = self._places(self.windows()).mapInArrow(tidy(_cover(self.length, False)), f"row_id bigint, doc_id {self.kind}, n_removed bigint, kept_sha256 string").withColumnRenamed("kept_sha256", "cut_sha256")
        cut = self.ws.table("cut", cut)
        return whole.join(bounded(cut), ROW, "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"))


def find_repeats(docs: DataFrame, *, length: int = 50) -> DataFrame:
    return SubstringDedup(docs, length=length).report()


def remove_repeats(docs: DataFrame, *, length: int = 50) -> DataFrame:
    """The documents with repeated words cut from their texts; texts without repeats stay as they are."""
    run = SubstringDedup(docs, length=length)
    cut = run._places(run.windows()).mapInArrow(tidy(_cover(length, True)), f"row_id bigint, doc_id {run.kind}, n_removed bigint, kept_sha256 string, text string").select(*ROW, F.col("text").alias("cut"))
    held = docs.select(F.struct("*").alias("doc"), "doc_id", F.xxhash64("doc_id", "text").alias("row_id")).join(cut, ROW, "left")
    return held.select(*[(F.coalesce("cut", "doc.text") if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
