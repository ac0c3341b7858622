"""Jaccard join on word shingles with adaptive multi-match prefixes.

Two documents link when their sets of five-word shingles have a Jaccard
similarity of 0.75 or more. Shingles are ordered from rare to frequent; two
sets that overlap in ``o`` shingles share at least ``l`` of the first
``size - o + l``. Each document chooses its own ``l``: one for documents of
rare shingles, more where the estimated number of candidates is high. Its
prefix grows by ``l - 1`` shingles, and a pair has to share ``l`` prefix
shingles (the smaller ``l`` of the two) before it is verified.

Steps, each over all documents:

1. One scan gives every document its set size and class (hash of its set) and
   counts all shingles in a sketch of fixed size, which orders them. Documents
   with equal sets are one class; copies cost nothing further.
2. A second scan emits the prefix shingles of every class. Sorted by shingle in
   shuffle partitions that spill, they are read as a stream: lists of two or
   three emit their pairs that pass the size and position bounds, larger lists
   are set aside, one row an entry. So never more rows are made than are read.
3. Verification goes in rounds of one partner per class, as in a minimum
   spanning forest, and after each round only pairs of different components
   remain. A class of small lists first meets the partner that shares most
   prefix shingles. A class of set-aside lists first meets the centre of most of
   its lists: the entry with the smallest position, that is, the class with the
   fewest rarer shingles, which is the likeliest to be close to the others.
   So thousands of near copies cost one pair each.
4. What is left of the set-aside lists is joined list by list, only entries
   outside a list's most frequent component with the others, for longer lists
   with size bands and for long ones a salt in the join key. Shared prefix shingles are
   counted over small and set-aside lists together, and a pair is verified only
   if it has as many as its documents ask for. A pair isn't even counted if the
   signatures of its sets (a bit per hash value, set where an odd number of
   shingles fall) differ in more bits than linked sets have shingles apart.

Pairs are verified on their whole texts, which are smaller than their sets and
are shuffled for candidates only. No link between different components is lost,
as every pair that passes the counts is verified or already connected. Links
inside a component are not all visited, so there is no number of links.

Defined cases: null and empty texts have no shingles and link with nothing;
fewer than five words are one shingle; equal sets link; a row with a null id
takes part like any other, and its component has the smallest id among the
others (null if there is none); rows repeated with one id, with equal texts or
not, are rows of their own; an empty table gives an empty result; further
columns are ignored. Shingles and sets are told apart by 64-bit hashes, and a
pair's texts are checked against their classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import CHUNK_BYTES, Workspace, bounded, components, drop_rows, gram_hashes, join_hot, mix, pieces, row_key, signed, split_words, tidy, word_hashes

#: Counters of the sketch that orders shingles; fixed, so it can be broadcast (4 bytes each).
SKETCH = 1 << 19
SKETCH_PARTS = 64
#: Longest list of classes of one shingle whose pairs are emitted at once: longer lists have more pairs than entries.
SHORT_LIST = 3
MAX_MATCHES = 4
#: Rounds of centres over set-aside lists; the second shifts the size bands by half their width.
CENTRE_TURNS = 2
#: Longest set-aside list whose entries meet without size bands: bands would repeat each entry.
UNBANDED = 64
#: Entries of one set-aside list and size band under one salt.
SALTED = 2000
#: Bits of a set's signature: two or more for each shingle, a power of two within these bounds.
SIGNATURE = (256, 8192)
#: Classes that a scan task remembers to skip the copies it meets.
TASK_CLASSES = 200_000
#: Pair rows that a task gathers before it combines and emits them.
FLUSH = 1_000_000


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    offsets, flat = split_words(texts, lower=True)
    words = word_hashes(flat)
    grams = gram_hashes(words, width)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        else:
            yield gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _class(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes(), 11)


def _bucket(found: np.ndarray) -> np.ndarray:
    return (mix(found) % np.uint64(SKETCH)).astype(np.int64)


def signature(found: np.ndarray) -> np.ndarray:
    """Parities of the shingles by hash value, as 64-bit words; two signatures differ in no more bits than their sets do in shingles."""
    low, high = SIGNATURE
    n = min(high, max(low, 1 << (2 * len(found) - 1).bit_length()))
    odd = np.bincount((mix(found) >> np.uint64(20)).astype(np.int64) & (n - 1), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        id_type, names = pa.int64(), ["key", "doc_id", "n", "cls", "bits", "part", "counts"]
        for batch in pieces(batches, "text"):
            id_type, sizes, classes, bits = batch.schema.field("doc_id").type, [], [], []
            for found in shingle_sets(batch.column("text"), width):
                sizes.append(len(found))
                classes.append(_class(found) if len(found) else None)
                bits.append(signature(found) if len(found) else None)
                np.add.at(counts, _bucket(found), 1)
            classes = pa.array([None if c is None else c - (1 << 64) * (c >> 63) for c in classes], pa.int64())
            nothing = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(sizes, pa.int64()), classes, pa.array(bits, pa.list_(pa.int64())), nothing.cast(pa.int32()), nothing.cast(pa.binary())], names)
        if counts.any():
            parts = [np.ascontiguousarray(x, "<i8").tobytes() for x in np.split(counts, SKETCH_PARTS)]
            empty = pa.nulls(SKETCH_PARTS)
            yield pa.RecordBatch.from_arrays([empty.cast(pa.binary()), empty.cast(id_type), empty.cast(pa.int64()), empty.cast(pa.int64()), empty.cast(pa.list_(pa.int64())), pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], names)

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            found = np.frombuffer(counts.as_buffer(), "<i8")
            total[part] = total[part] + found if part in total else found.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "counts"])


def sketch_counts(profile: DataFrame) -> np.ndarray:
    """The summed sketch: each task's counters are added part by part; the driver gets its fixed size."""
    parts = profile.filter("part IS NOT NULL").select("part", "counts").repartition(SKETCH_PARTS // 4, "part").mapInArrow(_add_counts, "part int, counts binary").collect()
    out = np.zeros((SKETCH_PARTS, SKETCH // SKETCH_PARTS), np.int64)
    for r in parts:
        out[r.part] += np.frombuffer(r.counts, "<i8")
    return out.reshape(-1)


class Bounds:
    """Integer forms of the similarity ``percent / 100``."""

    def __init__(self, percent: int):
        self.t = percent

    def partner(self, a):
        """The smallest set size that can link with size a."""
        return -(-self.t * a // 100)

    def overlap(self, a, b):
        """The smallest intersection with which sizes a and b link."""
        return -(-self.t * (a + b) // (100 + self.t))


def choose_matches(excess: np.ndarray, prefix: int, most: int) -> int:
    """The number of prefix matches with the least estimated cost.

    ``excess`` estimates, shingle by shingle in prefix order, how many other
    sets hold it. With l matches the lists of ``prefix + l - 1`` shingles are
    read, and a candidate uses up l of their entries.
    """
    sums = np.cumsum(excess[: prefix + most - 1])
    costs = [(prefix + m - 1) + sums[min(prefix + m - 1, len(sums)) - 1] * (0.2 + 1 / m) for m in range(1, most + 1)]
    return 1 + int(np.argmin(costs))


def _postings(width: int, bounds: Bounds, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        mean = counts.mean()
        noise = mean + 4 * math.sqrt(mean + 1)
        for batch in pieces(batches, "text"):
            tokens, classes, metas = [], [], []
            for found in shingle_sets(batch.column("text"), width):
                n = len(found)
                if not n or (c := _class(found)) in seen:
                    continue
                if len(seen) >= TASK_CLASSES:
                    seen.clear()
                seen.add(c)
                df = counts[_bucket(found)]
                order = np.argsort(df, kind="stable")
                least = bounds.partner(n)
                matches = choose_matches(np.maximum(df[order] - noise, 0), n - least + 1, min(MAX_MATCHES, least))
                prefix = order[: n - least + matches]
                tokens.append(found[prefix])
                classes.append(np.full(len(prefix), c, np.uint64))
                metas.append((n << 32) + (np.arange(len(prefix), dtype=np.int64) << 4) + matches)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(signed(np.concatenate(classes))), pa.array(np.concatenate(metas))], ["token", "cls", "meta"])

    return run


def _fits(bounds: Bounds, meta_x: np.ndarray, meta_y: np.ndarray) -> np.ndarray:
    a, b = meta_x >> 32, meta_y >> 32
    p, q = meta_x >> 4 & 0xFFFFFFF, meta_y >> 4 & 0xFFFFFFF
    need = np.minimum(meta_x & 15, meta_y & 15)
    short, long_ = np.minimum(a, b), np.maximum(a, b)
    return (100 * short >= bounds.t * long_) & (np.minimum(a - p, b - q) >= bounds.overlap(a, b) - need + 1)


def _pairs(bounds: Bounds):
    """Streams entries sorted by (token, cls): pairs of short lists, entries of long ones."""

    def combined(held: list[np.ndarray]) -> pa.RecordBatch:
        x, y, need = np.concatenate(held, axis=1)
        order = np.lexsort((y, x))
        x, y, need = x[order], y[order], need[order]
        first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        n = np.diff(np.concatenate([first, [len(x)]]))
        return out(x[first], y[first], n, need[first], None)

    def out(x, y, n, need, token) -> pa.RecordBatch:
        none = pa.nulls(len(x), pa.int64())
        arrays = [pa.array(x)] + [none if v is None else pa.array(v) for v in (y, n, need, token)]
        return pa.RecordBatch.from_arrays(arrays, ["x", "y", "n", "need", "token"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        held, size = [], 0
        long_token, last = None, None
        for batch in _with_end(batches):
            done = batch is None
            now = rest if done else [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns, strict=True)]
            token, cls, meta = now
            if not len(token):
                continue
            fresh = np.concatenate([[last is None or (token[0], cls[0]) != last], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])])
            token, cls, meta = token[fresh], cls[fresh], meta[fresh]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate([starts, [len(token)]])).astype(np.int64)
            large = sizes > SHORT_LIST
            if len(starts) and token[starts[0]] == long_token:
                large[0] = True
            keep = len(token)
            if len(starts) and not done and not large[-1]:
                keep = starts[-1]  # the list may go on in the next batch
            of = np.repeat(large, sizes)
            if (deferred := np.flatnonzero(of)).size:
                yield out(cls[deferred], None, None, meta[deferred], token[deferred])
            if len(token) and large[-1]:
                long_token, last = token[-1], (token[-1], cls[-1])
            else:
                last = None
            rest = [v[keep:] for v in (token, cls, meta)]
            short = np.flatnonzero(~of[:keep] & (np.repeat(sizes, sizes)[:keep] > 1))
            t, c, m = token[short], cls[short], meta[short]
            for d in range(1, min(SHORT_LIST, len(t))):
                same = np.flatnonzero(t[:-d] == t[d:])
                if not same.size:
                    break
                same = same[_fits(bounds, m[same], m[same + d])]
                if same.size:
                    held.append(np.stack([c[same], c[same + d], np.minimum(m[same] & 15, m[same + d] & 15)]))
                    size += same.size
            if size >= FLUSH:
                yield combined(held)
                held, size = [], 0
        if held:
            yield combined(held)

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _common(width: int, bounds: Bounds):
    """Pairs of whole texts that link; a text of another class is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text_x", CHUNK_BYTES // 2):
            keep = []
            one, two = (shingle_sets(batch.column(f"text_{k}"), width) for k in "xy")
            for i, (x, y, a, b) in enumerate(zip(one, two, batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                n = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * n >= bounds.t * (len(x) + len(y) - n) and (_class(x) - a) % (1 << 64) == 0 and (_class(y) - b) % (1 << 64) == 0:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in "xy"], ["a", "b"])

    return run


class NgramJaccardJoin:
    """One run of the join over a table of documents (doc_id, text)."""

    def __init__(self, docs: DataFrame, *, width: int = 5, percent: int = 75):
        self.docs, self.width, self.bounds = docs.select("doc_id", "text", row_key().alias("key")), width, Bounds(percent)
        self.ws = Workspace(docs.sparkSession, "ngram-join")

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """The links (a, b) among distinct class pairs (x, y)."""
        pairs = self.ws.table("candidates", pairs.select("x", "y"))
        wanted = pairs.select(F.col("x").alias("cls")).union(pairs.select(F.col("y").alias("cls"))).distinct()
        wanted = self.ws.table("candidate-rows", wanted.join(self.classes, "cls").select("cls", "key"))
        texts = self.ws.table("texts", self.docs.select("key", "text").join(bounded(wanted), "key"))
        if texts.count() > wanted.count():  # repeated rows
            texts = texts.dropDuplicates(["cls"])
        one, two = (texts.select(F.col("cls").alias(k), F.col("text").alias(f"text_{k}")) for k in "xy")
        both = pairs.join(one, "x").join(two, "y").select("x", "y", "text_x", "text_y")
        links = self.ws.table("links", both.mapInArrow(tidy(_common(self.width, self.bounds)), "a bigint, b bigint"))
        for t in (pairs, wanted, texts):
            self.ws.drop(t)
        self.ws.release()
        return links

    def _named(self, links: DataFrame) -> DataFrame:
        """(cls, root) of the classes that have links so far."""
        return self.ws.table("named", components(self.ws, links).select(F.col("node").alias("cls"), "root"))

    def _forest(self, pairs: DataFrame, links: DataFrame | None = None) -> DataFrame:
        """Links with those that candidate pairs (x, y, n shared) add: each class's best partner first, then the pairs that are still apart."""
        pairs = self.ws.table("pairs", pairs)
        both = pairs.select(F.col("x").alias("c"), F.col("y").alias("p"), "n").unionByName(pairs.select(F.col("y").alias("c"), F.col("x").alias("p"), "n"))
        best = both.groupBy("c").agg(F.max_by("p", F.struct("n", "p")).alias("p"))
        best = self.ws.table("best", best.select(F.least("c", "p").alias("x"), F.greatest("c", "p").alias("y")).distinct())
        found = self._verify(best)
        links = found if links is None else links.unionByName(found)
        named = self._named(links)
        one, two = (named.select(F.col("cls").alias(k), F.col("root").alias(f"root_{k}")) for k in "xy")
        apart = pairs.join(one, "x", "left").join(two, "y", "left").filter("coalesce(root_x, x) != coalesce(root_y, y)")
        links = links.unionByName(self._verify(apart.join(best, ["x", "y"], "left_anti")))
        self.ws.drop(named)
        self.ws.drop(pairs)
        return links

    def _rooted(self, links: DataFrame, entries: DataFrame) -> DataFrame:
        """``entries`` with ``root``, the component of their class so far."""
        named = self._named(links)
        rooted = self.ws.table("rooted", entries.join(bounded(named), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
        self.ws.drop(named)
        return rooted

    def _fit(self, a: str, b: str) -> str:
        """SQL: may the classes of two entries of one list link, by their sizes and by their positions there?"""
        t = self.bounds.t
        return (
            f"100 * least({a}.size, {b}.size) >= {t} * greatest({a}.size, {b}.size)"
            f" AND least({a}.size - {a}.p, {b}.size - {b}.p) >= ceil({t} * ({a}.size + {b}.size) / {100 + t}) - least({a}.l, {b}.l) + 1"
        )

    def _near(self, a: str, b: str) -> str:
        """SQL: do the signatures differ in at most as many bits as linked sets of these sizes have shingles apart?"""
        t, halves = self.bounds.t, "zip_with(slice({0}.bits, 1, size({0}.bits) div 2), slice({0}.bits, size({0}.bits) div 2 + 1, size({0}.bits) div 2), (u, v) -> u ^ v)"
        # sizes within the bounds differ by less than a factor of two, so signatures do by one doubling at most
        one, two = (f"CASE WHEN size({x}.bits) > size({y}.bits) THEN {halves.format(x)} ELSE {x}.bits END" for x, y in ((a, b), (b, a)))
        apart = f"aggregate(zip_with({one}, {two}, (u, v) -> bit_count(u ^ v)), 0, (n, m) -> n + m)"
        return f"{apart} <= {a}.size + {b}.size - 2 * ceil({t} * ({a}.size + {b}.size) / {100 + t})"

    def _centres(self, links: DataFrame, entries: DataFrame) -> DataFrame:
        """Links with those of each class to the centre of most of its lists; one pair per class and turn."""
        width = math.log(100 / self.bounds.t)
        one = F.struct("cls", "size", "p", "l", "root")
        for turn in range(CENTRE_TURNS):
            rooted = self._rooted(links, entries.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / width + turn / CENTRE_TURNS)))
            centre = self.ws.table("centre", rooted.groupBy("token", "band").agg(F.min_by(one, F.struct("p", F.xxhash64("cls"))).alias("c")))
            near = rooted.withColumn("e", one).join(bounded(centre), ["token", "band"]).filter(f"e.root != c.root AND {self._fit('e', 'c')}")
            votes = near.groupBy("cls", F.col("c.cls").alias("p")).agg(F.count("*").alias("n")).groupBy("cls").agg(F.max_by("p", F.struct("n", "p")).alias("p"))
            links = links.unionByName(self._verify(votes.select(F.least("cls", "p").alias("x"), F.greatest("cls", "p").alias("y")).distinct()))
            self.ws.drop(rooted)
            self.ws.drop(centre)
        return links

    def _across(self, links: DataFrame, entries: DataFrame, few: DataFrame) -> DataFrame:
        """Candidate pairs (x, y, n) of different components that share set-aside lists.

        ``few`` holds the pairs of small lists whose count is too low by itself.
        """
        rooted, t = self._rooted(links, entries), self.bounds.t
        sizes = rooted.groupBy("token", "root").agg(F.count("*").alias("n"))
        mixed = sizes.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("roots")).filter("roots > 1")
        mixed = self.ws.table("mixed", mixed.select("token", "main", F.ceil(F.col("n") / SALTED).alias("salts"), (F.col("n") > UNBANDED).alias("banded")))
        open_ = rooted.join(bounded(mixed), "token").join(self.classes.select("cls", "bits"), "cls").withColumn("e", F.struct("cls", "size", "p", "l", "root", "bits"))
        width = math.log(1.05)
        band = lambda c: F.floor(F.log(F.greatest(c.cast("double"), F.lit(1.0))) / width)
        size = F.col("size")
        longest = F.least(F.floor(size * 100 / t), F.floor((size - F.col("p") + F.col("l") - 1) * ((100 + t) / t) - size))
        shortest = F.ceil(size * (t / 100))
        index = open_.select("token", F.when(F.col("banded"), band(size)).otherwise(0).alias("band"), F.pmod(F.xxhash64("cls"), "salts").alias("salt"), F.col("e").alias("i"), (F.col("root") == F.col("main")).alias("i_main"))
        probe = open_.filter((F.col("root") != F.col("main")) & (longest >= shortest)).withColumn("band", F.explode(F.when(F.col("banded"), F.sequence(band(shortest), band(longest))).otherwise(F.array(F.lit(0).cast("bigint")))))
        probe = probe.select("token", "band", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.col("e").alias("e"))
        met = probe.join(index, ["token", "band", "salt"]).filter(f"e.root != i.root AND (i_main OR e.cls < i.cls) AND {self._fit('e', 'i')} AND {self._near('e', 'i')}")
        pairs = met.groupBy(F.least("e.cls", "i.cls").alias("x"), F.greatest("e.cls", "i.cls").alias("y")).agg(F.count("*").alias("n"), F.min(F.least("e.l", "i.l")).alias("need"))
        few = few.select("x", "y", F.col("n").alias("more"))
        return pairs.join(few, ["x", "y"], "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0))).filter("n >= need").select("x", "y", "n")

    def run(self) -> DataFrame:
        """Per document: key, doc_id, n, cls and root, the class that names its component (null without shingles)."""
        ws, spark = self.ws, self.docs.sparkSession
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        profile = ws.table("profile", self.docs.mapInArrow(tidy(_profile(self.width)), f"key binary, doc_id {kind}, n bigint, cls bigint, bits array<bigint>, part int, counts binary"))
        sketch = spark.sparkContext.broadcast(sketch_counts(profile))
        sized = profile.filter("part IS NULL").select("key", "doc_id", "n", "cls", "bits")
        self.classes = ws.table("classes", sized.filter("cls IS NOT NULL").groupBy("cls").agg(F.min_by(F.struct("key", "bits"), "key").alias("r")).select("cls", "r.*"))
        sized = ws.table("sized", sized.drop("bits"))
        ws.drop(profile)
        ws.release()
        postings = self.docs.select("text").mapInArrow(tidy(_postings(self.width, self.bounds, sketch)), "token bigint, cls bigint, meta bigint")
        matches = postings.repartition("token").sortWithinPartitions("token", "cls").mapInArrow(tidy(_pairs(self.bounds)), "x bigint, y bigint, n bigint, need bigint, token bigint")
        matches = ws.table("matches", matches)
        small = ws.table("small", matches.filter("token IS NULL").groupBy("x", "y").agg(F.sum("n").alias("n"), F.min("need").alias("need")))
        self.ws.release()
        links = self._forest(small.filter("n >= need").select("x", "y", "n"))
        entries = matches.filter("token IS NOT NULL").select("token", F.col("x").alias("cls"), *[F.expr(f"{e} AS {k}") for k, e in (("size", "shiftright(need, 32)"), ("p", "shiftright(need, 4) & 268435455"), ("l", "need & 15"))])
        if not entries.isEmpty():
            links = self._centres(links, entries)
            links = self._forest(self._across(links, entries, small.filter("n < need")), links)
        return sized.join(bounded(self._named(links)), "cls", "left").select("key", "doc_id", "n", "cls", F.coalesce("root", "cls").alias("root"))


def link_documents(docs: DataFrame, *, width: int = 5, percent: int = 75) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    join = NgramJaccardJoin(docs, width=width, percent=percent)
    rows = join.ws.table("rows", join.run())
    join.ws.keep("rows")
    least = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    joined = join_hot(rows.select("doc_id", F.col("n").alias("n_shingles"), "root"), join.ws.table("least", least), "root", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def remove_near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 75) -> DataFrame:
    """One row of each component stays, with all its columns: the one with the smallest id, null ids last.

    Where that id stands in several rows of the component, the one with the
    smallest key stays; rows without shingles stay all.
    """
    join = NgramJaccardJoin(docs, width=width, percent=percent)
    rows = join.ws.table("rows", join.run().filter("root IS NOT NULL"))
    join.ws.keep("rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = join.ws.table("kept", rows.groupBy("root").agg(F.min(first)["key"].alias("kept"), F.count("*").alias("n")).filter("n > 1"))
    found = join.ws.table("found", join_hot(rows.select("key", "root"), kept, "root"))
    gone = join.ws.table("gone", found.filter("key != kept").select("key").distinct())
    once = join.ws.table("once", found.filter("key = kept").groupBy("key").count().filter("count > 1").select("key"))
    join.ws.keep("gone", "once")
    return drop_rows(docs, gone, once)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
