"""Helpers shared by the operators: shared-folder tables, Arrow batches, word hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on at most (one longer text is its own step).
CHUNK_BYTES = 4 << 20
#: Rows of a few integers or one digest that may be broadcast; above it joins shuffle.
BROADCAST_ROWS = 250_000
#: Bytes of strings that may be broadcast beside that.
BROADCAST_BYTES = 16 << 20
#: A key is hot from this many rows on, and from this share of all rows on (so at most as many keys are hot).
HOT_ROWS, HOT_KEYS = 1000, 2000

#: Bytes of one Arrow batch between the JVM and a Python worker.
ARROW_BATCH, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark runs on this machine alone."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="weftgraph-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


class Workspace:
    """Tables that one operator call writes to the shared folder.

    Arrow batches are bounded to 2 MB for the whole session, as the operators'
    results run after they return; the README says so.

    Written tables cut the lineage: losing an executor never loses them. They
    are removed by ``drop`` and ``keep`` as soon as no later step needs them, the rest when
    the Python driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/weftgraph/{name}-{uuid.uuid4().hex}"
        self.written: list[tuple[str, str]] = []
        atexit.register(self.remove, self.root)
        # rows are texts of any length: bound Arrow batches by bytes, which the JVM and a worker hold side by side
        now = spark.conf.get(ARROW_BATCH)
        if not now.isdigit() or int(now) > ARROW_BYTES:
            spark.conf.set(ARROW_BATCH, str(ARROW_BYTES))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame, *, compression: str | None = None) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        path = self.path(f"{name}-{uuid.uuid4().hex[:8]}")
        self.written.append((name, path))
        (df.write.option("compression", compression) if compression else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).alias(name)

    def drop(self, df: DataFrame) -> None:
        """Delete the files behind a table of this workspace."""
        for file in df.inputFiles()[:1]:
            self.remove(file.rsplit("/", 1)[0])

    def keep(self, *names: str) -> None:
        """Delete all tables written so far but those of these names, when no later step needs the others."""
        for name, path in self.written:
            if name not in names:
                self.remove(path)
        self.written = [(name, path) for name, path in self.written if name in names]

    def release(self) -> None:
        """Let Spark delete shuffle files of finished steps now, not when the driver next collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def remove(self, path: str) -> None:
        """Delete a folder of the shared file system."""
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the gateway may be gone at exit; the folder belongs to the cluster's cleaner then
            pass


def restrict(df: DataFrame, ids: DataFrame, n: int, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (distinct keys, ``n`` of them).

    The keys are broadcast only when their counted number is within
    ``BROADCAST_ROWS``; beyond it both sides shuffle by the key.
    """
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, on, "left_semi")


def without(df: DataFrame, ids: DataFrame, n: int, on: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids``; broadcast as in ``restrict``."""
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, on, "left_anti")


def bounded(df: DataFrame, *texts: Column) -> DataFrame:
    """``df`` marked for broadcast if its rows and the bytes of ``texts`` were measured to be few, else as it is."""
    size = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0)).cast("bigint")
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and held <= BROADCAST_BYTES else df


def join_hot(rows: DataFrame, keyed: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row per key and the key's number of rows, ``n``.

    Rows of hot keys never meet in one task: those keys are at most
    ``HOT_KEYS``, so they are broadcast to where the rows are. Only the other
    rows shuffle by the key.
    """
    least = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot, cold = keyed.filter(F.col("n") > least), keyed.filter(F.col("n") <= least)
    if hot.isEmpty():
        return rows.join(cold, on, how)
    hot = F.broadcast(hot)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(cold, on, how))


def row_key() -> Column:
    """A 128-bit digest of a document's id and text: equal rows have equal keys, whatever their other columns."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return F.unhex(F.md5(F.concat(part(F.col("doc_id").cast("string")), F.lit("\n"), part(F.col("text")))))


def drop_rows(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone``; of rows with a key in ``once`` one stays.

    Both are written tables of one column ``key`` of distinct row keys. Rows
    travel as one struct, so no column name of theirs can clash.
    """
    held = without(docs.select(F.struct("*").alias("doc"), row_key().alias("key")), gone, gone.count(), "key")
    if once is not None and (n := once.count()):
        held = without(held, once, n, "key").unionByName(restrict(held, once, n, "key").dropDuplicates(["key"]))
    return held.select("doc.*")


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``most`` bytes in ``column``, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; when its task has ended and its caches are gone, their memory goes back to the system."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Return freed memory to the system at a task's end: workers are reused and share the executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (null: none), A-Z lower-cased on request.

    Returns the row offsets (rows + 1) and the flat words.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return before[offsets - offsets[0]], flat.filter(full)


def word_hashes(flat: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    coded = flat.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX2
    return h ^ (h >> np.uint64(33))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, r in (("up", _R), ("down", _R_INV)):
            steps = np.full(size, np.uint64(r))
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``h[i:i+k]`` for every i; the caller drops grams that cross rows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
    return mix((sums[k:] - sums[:n]) * down[:n] + np.uint64(k * 0x2545F4914F6CDD1D % (1 << 64)))


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(h).view(np.int64)


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """Connected components of undirected links ``(a, b)``: rows ``(node, root)``, root the smallest node.

    Alternates large-star and small-star steps (each a grouped minimum with
    map-side combining, so a hot centre is pre-aggregated), writing every round
    to the shared folder. Nodes without links don't appear.
    """
    edges = ws.table("edges", links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = ws.table("large", large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = ws.table("edges", small.select("e.u", "e.v").filter("u != v").distinct())
        ws.drop(large)
        ws.drop(edges)
        edges = small
        # done when every u hangs below one v and no v hangs below another
        open_ = edges.groupBy("u").count().filter("count > 1").select("u").union(edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi"))
        if open_.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
