"""Exact duplicates through a sharded cuckoo-filter index of live digests.

The index holds one live entry per distinct text: its SHA-256, the largest
document id seen and the number of documents. A cuckoo filter of 16-bit
fingerprints answers most new digests without touching the stored keys; a hit
is verified against the full digests kept beside the fingerprint's bucket, and
groups of equal digests are verified on their texts, bucketed by digest. The
filter deletes as well as inserts, so documents can leave the index
(:func:`apply_changes`), and grows by rebuilding from the stored keys when an
insertion overflows.

Two levels bound memory and skew. Every scan task keeps its own index over the
rows it reads and hands on one row per digest it met, so a text that a third of
the corpus repeats reaches the shuffle once per task. Shards of those rows, by
digest, merge them in a second index. Digests (never texts) are written to the
shared folder in between; of the texts only those of repeated digests are shuffled,
one lowest and one highest a task, to verify that they are equal.

Defined cases: a null text equals the empty text; of equal texts the largest id
stays, and a null id stays only in a group of nulls; a row repeated with the
same id and text counts in ``group_size`` and is kept like its twin (removal
keeps one of the two); an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import BROADCAST_ROWS, Workspace, drop_rows, join_hot, row_key, tidy

SLOTS = 4
MAX_KICKS = 200
#: Distinct digests that one shard's index holds on average.
SHARD_KEYS = 500_000
#: Distinct digests of a scan task's own index before it is handed on and emptied.
TASK_KEYS = 200_000


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a power of two of buckets.

    ``insert`` returns False when no slot can be freed; the owner then builds a
    filter of twice the size from its stored keys.
    """

    def __init__(self, buckets: int = 1024):
        self.mask = buckets - 1
        self.slots = [0] * (buckets * SLOTS)
        self._turn = 0

    @staticmethod
    def fingerprint(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") or 1

    def _first(self, digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little") & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark, a = self.fingerprint(digest), self._first(digest)
        return mark, a, self._other(a, mark)

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        return mark in self.slots[a * SLOTS : a * SLOTS + SLOTS] or mark in self.slots[b * SLOTS : b * SLOTS + SLOTS]

    def _put(self, bucket: int, mark: int) -> bool:
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.slots[i]:
                self.slots[i] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        if self._put(a, mark) or self._put(b, mark):
            return True
        path, bucket = [], b
        for _ in range(MAX_KICKS):
            self._turn += 1
            i = bucket * SLOTS + self._turn % SLOTS
            path.append((i, self.slots[i]))
            mark, self.slots[i] = self.slots[i], mark
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark):
                return True
        for i, held in reversed(path):  # leave the filter as it was
            self.slots[i] = held
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        for bucket in (a, b):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[i] == mark:
                    self.slots[i] = 0
                    return True
        return False


class DigestIndex:
    """Live digests: a cuckoo filter in front of the stored keys.

    ``store`` groups the full digests by the 10 bytes that decide a
    fingerprint and its first bucket, so a hit is verified against the few
    digests that share them.
    """

    def __init__(self, buckets: int = 1024):
        self.filter = CuckooFilter(buckets)
        self.store: dict[bytes, list[list]] = {}
        self.size = 0
        self.resized = 0

    def find(self, digest: bytes) -> list | None:
        """The live entry [digest, id, n], or None; the filter answers first."""
        if digest not in self.filter:
            return None
        return next((e for e in self.store.get(digest[:10], ()) if e[0] == digest), None)

    def add(self, digest: bytes, doc_id: int | None, n: int) -> None:
        if (entry := self.find(digest)) is not None:
            entry[2] += n
            if doc_id is not None and (entry[1] is None or doc_id > entry[1]):
                entry[1] = doc_id
            return
        self.store.setdefault(digest[:10], []).append([digest, doc_id, n])
        self.size += 1
        if not self.filter.insert(digest):
            self._resize()

    def remove(self, digest: bytes, n: int) -> None:
        """Takes ``n`` documents from a digest; the last one deletes its fingerprint."""
        if (entry := self.find(digest)) is None:
            return
        entry[2] -= n
        if entry[2] <= 0:
            held = self.store[digest[:10]]
            held.remove(entry)
            if not held:
                del self.store[digest[:10]]
            self.filter.delete(digest)
            self.size -= 1

    def _resize(self) -> None:
        buckets = (self.filter.mask + 1) * 2
        while True:
            self.resized += 1
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(e[0]) for e in self.entries()):
                return
            buckets *= 2

    def entries(self) -> Iterator[list]:
        for held in self.store.values():
            yield from held


def _rows(entries: Iterable[list], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    entries = list(entries)
    for i in range(0, len(entries), 50_000):
        part = entries[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in part], pa.binary()), pa.array([e[1] for e in part], id_type), pa.array([e[2] for e in part], pa.int64())], ["sha", "top_id", "n"])


def _merge(limit: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, id_type = DigestIndex(), pa.int64()
        for batch in batches:
            id_type = batch.schema.field("top_id").type
            for sha, doc_id, n in zip(batch.column("sha").to_pylist(), batch.column("top_id").to_pylist(), batch.column("n").to_pylist(), strict=True):
                index.add(sha, doc_id, n)
            if limit and index.size > limit:
                yield from _rows(index.entries(), id_type)
                index = DigestIndex()
        yield from _rows(index.entries(), id_type)

    return run


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, sha) per row: SHA-256 of the UTF-8 text, null as empty; computed in the JVM."""
    return docs.select("doc_id", _sha(F.col("text")).alias("sha"))


def build_index(rows: DataFrame) -> DataFrame:
    """The live index (sha, top_id, n) of (doc_id, sha) rows, by the two levels of cuckoo indexes."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"sha binary, top_id {kind}, n bigint"
    local = rows.select("sha", F.col("doc_id").alias("top_id"), F.lit(1).cast("bigint").alias("n")).mapInArrow(tidy(_merge(TASK_KEYS)), schema)
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // SHARD_KEYS + 1)
    return local.repartition(shards, "sha").mapInArrow(tidy(_merge(None)), schema)


def apply_changes(index: DataFrame, live: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The index of the ``live`` (doc_id, sha) rows after some were ``added`` and some ``removed``.

    Rows count by id and digest before anything is shuffled by digest. Digests
    that lost a row leave the filter and come back with what is left of them,
    so their largest id is right again; the others only gain. Shards by digest
    replay the live entries, then deletions, then insertions.
    """
    count = lambda df, sign: df.groupBy("doc_id", "sha").agg((sign * F.count("*")).alias("n"))
    touched = removed.select("sha").distinct()
    rows = count(live.join(touched, "sha", "left_semi"), 1).unionByName(count(added, 1)).unionByName(count(removed, -1))
    rest = rows.groupBy("doc_id", "sha").agg(F.sum("n").alias("n")).filter("n > 0").groupBy("sha").agg(F.max("doc_id").alias("top_id"), F.sum("n").alias("n"))
    step = lambda df, k: df.select("sha", "top_id", "n", F.lit(k).alias("step"))
    steps = step(index, 0).unionByName(step(index.join(touched, "sha", "left_semi"), 1)).unionByName(step(rest, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, id_type = DigestIndex(), pa.int64()
        for batch in batches:
            id_type = batch.schema.field("top_id").type
            for sha, doc_id, n, k in zip(*(batch.column(c).to_pylist() for c in ("sha", "top_id", "n", "step")), strict=True):
                if k == 1:
                    held.remove(sha, n)
                else:
                    held.add(sha, doc_id, n)
        yield from _rows(held.entries(), id_type)

    return steps.repartition("sha").sortWithinPartitions("step").mapInArrow(run, index.schema)


def _grouped(ws: Workspace, docs: DataFrame, short: Callable[[Column], Column]) -> DataFrame:
    """(key, doc_id, full, keep_id, n) per row: the group of its text, found by the index and verified on the texts."""
    rows = ws.table("digests", docs.select("doc_id", _sha(F.col("text")).alias("full"), row_key().alias("key"))).withColumn("sha", short(F.col("full")))
    groups = ws.table("groups", build_index(rows).filter("n > 1"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _sha(F.col("text")).alias("full"), row_key().alias("key")).withColumn("sha", short(F.col("full")))
    # all texts of a digest are equal if its lowest and its highest are; while the repeated digests are few, they go to
    # the texts, and only repeated texts are shuffled
    few = groups.count() <= BROADCAST_ROWS
    again = texts.select("sha", "text").join(F.broadcast(groups.select("sha")), "sha", "left_semi") if few else join_hot(texts.select("sha", "text"), groups.select("sha", "n"), "sha")
    content = again.groupBy("sha").agg((F.min("text") != F.max("text")).alias("mixed"))
    mixed = ws.table("mixed", content.filter("mixed").select("sha"))
    group = lambda df: df.select("key", "doc_id", "full", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("n"))
    if mixed.isEmpty():
        return group(join_hot(rows, groups, "sha", "left"))
    apart = texts.join(mixed, "sha", "left_semi")
    by_text = apart.groupBy("text").agg(F.max("doc_id").alias("top_id"), F.count("*").alias("n"))
    return group(join_hot(rows.join(mixed, "sha", "left_anti"), groups, "sha", "left")).unionByName(group(apart.join(by_text, "text")))


def find_duplicates(docs: DataFrame, *, short: Callable[[Column], Column] = lambda full: full) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    Only groups of two or more take part in the join back, and digests of many
    rows are broadcast there. ``short`` may cut the digest that the index works
    on, since groups are verified on their texts.
    """
    rows = _grouped(Workspace(docs.sparkSession, "exact-dedup"), docs, short)
    return rows.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("full")).alias("text_sha256"))


def remove_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns.

    Rows go by their key (id and text), so an id that holds another text too
    keeps it, and copies without an id go like others. Of rows repeated with
    the kept id and text one stays.
    """
    ws = Workspace(docs.sparkSession, "exact-dedup-rows")
    found = ws.table("found", _grouped(ws, docs, lambda full: full).filter("n > 1"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # null and empty texts are equal but have different keys: of the kept rows of a group one key stays
    first = found.filter(kept).groupBy("full").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    first = ws.table("first", first)
    again = ws.table("again", join_hot(found.filter(kept).select("key", "full"), first, "full"))
    gone = ws.table("gone", found.filter(~kept).select("key").union(again.filter("key != first").select("key")).distinct())
    once = ws.table("once", again.filter("key = first").groupBy("key").count().filter("count > 1").select("key"))
    ws.keep("gone", "once")
    return drop_rows(docs, gone, once)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
