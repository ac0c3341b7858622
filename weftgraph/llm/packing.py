"""Best-fit-decreasing packing of token sequences into fixed windows.

A document's ids are those of the tokenizer plus one end id. Documents longer
than a window are first cut into full windows; what is left is packed best fit
decreasing: pieces by falling length, each into the tightest open window that
holds it, found with a segment tree indexed by remaining capacity.

Pieces of equal length are interchangeable, so the plan needs only how many
pieces there are of each length: at most ``window`` counts, whatever the size of
the corpus. The driver runs the exact best-fit-decreasing order on those counts,
moving whole runs of windows with the same remaining capacity at once, and gets
a list of ranges: the pieces of length s with ranks r0..r1 go to windows
w0.. at an offset. Pieces get their rank among those of their length from counts
per task and length (two levels, no global sort), then their place from the
ranges. Texts are read and tokenized once; nothing but piece descriptions is
shuffled or written.

Defined cases: a null or empty text is the end id alone; every row is packed,
repeated rows and null ids too; an empty table gives an empty result; further
columns are ignored. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import Workspace, pieces, tidy

#: Text bytes that one step encodes at most (one longer text is its own step): two workers share an executor with a full heap.
TEXT_BYTES = 1 << 20
#: Words whose ids a worker remembers before it starts anew.
CACHE_WORDS = 250_000
#: Words that are encoded at once.
TOGETHER = 5000
#: Fixed value: letters whose lower-case form, NFC form and bytes are the same for every tokenizer and library.
LETTERS = "a-zß-öø-ÿ"
#: A word of such letters (either case), and ASCII punctuation behind it, which forms a part of its own; not the apostrophe.
CUT = f"^(?P<word>[{LETTERS}À-ÖØ-Þ]+)(?P<behind>[!-&(-/:-@\\[-`{{-~]*)$"
#: Fixed value: a character that is neither space, letter nor digit, put between words to find their ids again.
MARK = "\x01"


class WordTokenizer:
    """Ids of whole texts from a byte-level tokenizer that drops white space and ignores case.

    Such a tokenizer encodes the parts between white space independently, so
    each distinct part is encoded once and the ids of a text are put together
    by index. Punctuation behind a word of letters is a part of its own, and
    such a word, in lower case, needs neither normalizer nor pattern: the
    tokenizer's model gets it as it is, one id of each carrying the end-of-word
    mark. Other words go through the whole tokenizer, with marks between them.
    Known words are one Arrow array and their ids one vector, of bounded size.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own cost memory only
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = Tokenizer(self.tokenizer.model)  # shares the model
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.mark = self._whole(MARK)
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode_letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each of some lower-case words of ``LETTERS``."""
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(stops, prepend=0)) if len(stops) == len(words) else self._encode_others(words)

    def _encode_others(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each of some words between ASCII white space."""
        texts = [w.decode("utf-8", "replace") for w in words.cast(pa.binary()).to_pylist()]
        ids = self._whole("".join(f"{t} {MARK} " for t in texts))
        marks = ids == self.mark[0]
        if len(self.mark) == 1 and marks.sum() == len(texts):
            return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1
        each = [self._whole(t) for t in texts]  # a text holds the mark itself
        return np.concatenate(each), np.array([len(e) for e in each])

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Encodes new words; the numbers that they get."""
        plain = pc.match_substring_regex(words, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        order, known = np.argsort(~plain, kind="stable"), len(self.words)
        words, n = words.take(pa.array(order)), int(plain.sum())
        parts = [encode(words.slice(i, min(TOGETHER, end - i))) for start, end, encode in ((0, n, self._encode_letters), (n, len(words), self._encode_others)) for i in range(start, end, TOGETHER)]
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, *[ids for ids, _ in parts]])
        self.sizes = np.concatenate([self.sizes, *[sizes for _, sizes in parts]])
        numbers = np.empty(len(words), np.int64)
        numbers[order] = np.arange(known, known + len(words))
        return numbers

    def _encode(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, one behind the other, and their number for each."""
        cut = pc.extract_regex(parts, CUT)
        word = pc.coalesce(pc.utf8_lower(pc.struct_field(cut, "word")), parts)
        both = pa.concat_arrays([word, pc.fill_null(pc.struct_field(cut, "behind"), "")]).dictionary_encode()
        if len(self.words) > CACHE_WORDS:
            self._forget()
        at = pc.fill_null(pc.index_in(both.dictionary, self.words), -1).to_numpy()
        new = np.flatnonzero(at < 0)
        at = at.copy()
        at[new] = self._learn(both.dictionary.take(pa.array(new)))
        at = at[both.indices.to_numpy()].reshape(2, -1)
        return _runs(self.ids, self.sizes, at.T.ravel()), self.sizes[at].sum(0)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by ``end_id``, and the offsets of the texts."""
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        offsets = np.asarray(lists.offsets, np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        ids, sizes = self._encode(coded.dictionary)
        # the end id is one more part behind each text
        ids, sizes = np.append(ids, np.uint32(end_id)), np.append(sizes, 1)
        codes = np.insert(coded.indices.to_numpy(), offsets[1:], len(sizes) - 1)
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        return _runs(ids, sizes, codes), ends[np.concatenate([[0], offsets[1:] + np.arange(1, len(texts) + 1)])]


def _runs(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` numbered by ``codes``, one behind the other, where run i is the next ``sizes[i]`` ids."""
    n = sizes[codes]
    at = np.repeat(((np.cumsum(sizes) - sizes)[codes] - (np.cumsum(n) - n)).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    return ids[at]


class CapacityTree:
    """Segment tree over remaining capacities 0..size: is any window open at a capacity?"""

    def __init__(self, size: int):
        self.n = 1
        while self.n <= size:
            self.n *= 2
        self.open = [0] * (2 * self.n)

    def add(self, capacity: int, windows: int) -> None:
        i = capacity + self.n
        while i:
            self.open[i] += windows
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least at which a window is open."""
        i = least + self.n
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


@dataclass
class Range:
    """Pieces of ``length`` with ranks first.. (count of them): ``each`` per window from ``window`` on, at ``offset``."""

    length: int
    first: int
    count: int
    each: int
    window: int
    offset: int


def plan(counts: dict[int, int], window: int) -> list[Range]:
    """Best-fit-decreasing places for ``counts[length]`` pieces of each length.

    Windows that are filled alike are kept as runs (first number, how many) by
    remaining capacity; a length's pieces take whole runs, so the work follows
    the number of runs, not of pieces.
    """
    tree, runs, out, opened = CapacityTree(window), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                each = window // length
                full, rest = divmod(left, each)
                start, many, room = opened, full + (rest > 0), window
                opened += many
            else:
                each = room // length
                start, many = runs[room].pop()
                tree.add(room, -many)
                if many * each > left:
                    used = -(-left // each)
                    if used < many:
                        runs[room].append((start + used, many - used))
                        tree.add(room, many - used)
                    many = used
                full, rest = divmod(min(left, many * each), each)
            took = full * each + rest
            out.append(Range(length, rank, took, each, start, window - room))
            for first, n, pieces_in in ((start, full, each), (start + full, int(rest > 0), rest)):
                if n and (capacity := room - pieces_in * length):
                    runs.setdefault(capacity, []).append((first, n))
                    tree.add(capacity, n)
            left, rank = left - took, rank + took
    return out


def cut(docs: DataFrame, tokenizer_path: str, *, window: int, end_id: int) -> DataFrame:
    """Pieces of every document, with the task and the rank among the task's pieces of that length."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task bigint, task_rank bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen, task = WordTokenizer(tokenizer_path), Counter(), TaskContext.get().partitionId()
        names = schema.replace(",", "").split()[::2]
        for batch in pieces(batches, "text", TEXT_BYTES):
            ids, ends = tokenizer.encode(batch.column("text"), end_id)
            raw = memoryview(ids).cast("B")
            # each text's pieces: full windows, then what is left
            of = np.repeat(np.arange(batch.num_rows), -(-np.diff(ends) // window))
            start = np.concatenate([np.arange(0, n, window) for n in np.diff(ends)]) if len(of) else of
            size = np.minimum(window, (ends[of + 1] - ends[of]) - start)
            at, rank = 4 * (ends[of] + start), np.empty(len(of), np.int64)
            crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
            for i, n in enumerate(size.tolist()):
                rank[i] = seen[n]
                seen[n] += 1
            columns = (start, size, np.array(crc, np.int64), ends[of + 1] - ends[of], np.full(len(of), task), rank)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), *[pa.array(c.astype(np.int64)) for c in columns]], names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def pack(docs: DataFrame, tokenizer_path: str, *, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces with their sequence and offset there.

    The pieces are written to the shared folder once, so a lost executor never
    changes ranks that a plan relies on.
    """
    spark = docs.sparkSession
    cut_ = Workspace(spark, "packing").table("pieces", cut(docs, tokenizer_path, window=window, end_id=end_id))
    counts = cut_.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    total = {r.length: r.n for r in cut_.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``window`` rows
    ranges = [(r.length, r.first, r.first + r.count - 1, r.each, r.window, r.offset) for r in plan(total, window)]
    # A place is found by the rank of its range's start: ranges are numbered within a length.
    places: dict[int, list[tuple]] = {}
    for r in ranges:
        places.setdefault(r[0], []).append(r)
    held = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in places.items()})
    schema = "doc_id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint".format(docs.schema["doc_id"].dataType.simpleString())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.empty_like(rank), np.empty_like(rank)
            for size in np.unique(length):
                table, of = held.value[int(size)], np.flatnonzero(length == size)
                r = table[np.searchsorted(table[:, 1], rank[of], "right") - 1]
                within = rank[of] - r[:, 1]
                seq[of], off[of] = r[:, 4] + within // r[:, 3], r[:, 5] + within % r[:, 3] * size
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")], pa.array(seq), pa.array(off)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = cut_.join(starts, ["length", "task"]).withColumn("rank", F.col("task_rank") + F.col("before"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
