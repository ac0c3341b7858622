"""URL filter: host and path rules first, then a trained logistic regression.

The model is a logistic regression on hashed character n-grams of host and
path, fitted on the driver from a small labelled URL table (``LABELLED`` or the
caller's). A rule ``host/path`` fits its host and all subdomains when the url's
path starts with the rule's path; the longest fitting rule decides, and only
urls without one get the model's verdict. Host, path and rules are column
expressions; scores come from one pass of Arrow batches, without a shuffle.

Defined cases: host is what stands between the first ``://`` and the next of
``/ ? #`` (A-Z lower-cased), path goes on from there to ``?`` or ``#``; both are
empty for null or without ``://``; an empty host gets the model's verdict on
empty text; repeated rows are judged each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import gram_hashes, mix, pieces

BUCKETS = 1 << 14
LENGTHS = (3, 4, 5)

#: The labelled table: fixed values, one url a line, unwanted ones first.
BLOCKED = """
http://casino-win.example.com/play/slots
https://best-casino.example.org/bonus?ref=9
http://online-poker-cash.example.net/join
https://slots-jackpot.example.com/free-spins
http://spam-farm.example.org/en/101
https://spam-links.example.com/page/7
http://link-farm.example.net/seo/backlinks
https://buy-backlinks.example.org/order
http://ads-track.example.com/click?id=1
https://adserver.example.net/track/pixel.gif
http://track.click-ads.example.org/redirect?u=x
https://popup-ads.example.com/banner/44
http://cheap-pills.example.com/viagra
https://pharma-deals.example.net/cialis/order
http://no-prescription-meds.example.org/buy
https://xxx-videos.example.com/watch/1
http://adult-cams.example.net/live
https://hot-sex-chat.example.org/girls
http://free-money-now.example.com/win
https://win-free-iphone.example.net/claim-prize
http://lottery-winner.example.org/claim
https://crypto-doubler.example.com/invest
http://payday-loan-fast.example.net/apply
https://replica-watches.example.com/sale
http://crack-keygen.example.org/download/warez
https://torrent-warez.example.net/full-crack
http://login-verify-account.example.com/secure/update
https://bank-verify.example.net/signin/confirm
http://download-free-movie.example.org/stream
https://clickbait-viral.example.com/you-wont-believe
"""
ALLOWED = """
https://www.example.com/en/about
http://blog.gardening.example.com/en/320
https://docs.example.org/guide/install.html
http://news.example.net/2021/05/elections
https://library.example.org/catalog/item/88
http://www.university.example.edu/research/physics
https://wiki.example.org/wiki/Main_Page
http://m.thonat.example.com/en/12
https://blog.tiontheer.example.net/fr/455/
http://www.thinges.example.org/de/77.html
https://thererly.example.com/es/640?page=2
http://thaneder.example.org/en/903#top
https://forum.example.net/thread/9921
http://recipes.example.com/soup/tomato
https://museum.example.org/collection/paintings
http://weather.example.net/forecast/city
https://shop.example.com/product/chair
http://www.city-council.example.org/minutes/2019
https://developer.example.com/api/reference
http://history.example.net/articles/rome
https://health.example.org/topics/sleep
http://sports.example.com/football/results
https://travel.example.net/guides/lisbon
http://music.example.org/albums/1972
https://journal.example.edu/volume/12/issue/3
http://support.example.com/help/contact
https://photos.example.net/gallery/2
http://jobs.example.org/openings/engineer
https://school.example.edu/courses/algebra
http://www.theaterou.example.net/en/501
"""


def _char_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


def url_buckets(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of host and path; each is framed and salted by its kind."""
    table, rows, buckets = _char_table(), [], []
    for salt, texts in ((1, host), (2, path)):
        raw = [b"^" + t + b"$" for t in texts.cast(pa.binary()).to_pylist()]
        codes = table[np.frombuffer(b"".join(raw), np.uint8)]
        of = np.repeat(np.arange(len(raw)), [len(t) for t in raw])
        for k in LENGTHS:
            grams = gram_hashes(codes, k)
            inside = of[: len(grams)] == of[k - 1 :][: len(grams)] if len(grams) else np.zeros(0, bool)
            rows.append(of[: len(grams)][inside])
            buckets.append((mix(grams[inside] + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


@dataclass
class UrlModel:
    bias: float
    weights: np.ndarray

    def score(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """Probability of an unwanted url: mean n-gram weight, scaled as in training."""
        rows, buckets = url_buckets(host, path)
        n = np.maximum(np.bincount(rows, minlength=len(host)), 1)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(rows, self.weights[buckets], len(host)) / np.sqrt(n), -30, 30)))


def host_path(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return rest[:cut].lower(), rest[cut:].partition("?")[0].partition("#")[0]


def fit(labelled: Sequence[tuple[str, int]] | None = None, *, rounds: int = 400, l2: float = 1e-3) -> UrlModel:
    """Gradient descent (Adam) on (url, 1 for unwanted) rows; the table is small by contract."""
    if labelled is None:
        labelled = [(u, 1) for u in BLOCKED.split()] + [(u, 0) for u in ALLOWED.split()]
    parts = [host_path(u) for u, _ in labelled]
    rows, buckets = url_buckets(pa.array([h for h, _ in parts]), pa.array([p for _, p in parts]))
    y = np.array([label for _, label in labelled], float)
    value = (1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1)))[rows]
    w, b = np.zeros(BUCKETS), 0.0
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, rounds + 1):
        z = b + np.bincount(rows, value * w[buckets], len(y))
        err = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = np.append(np.bincount(buckets, err[rows] * value, BUCKETS) + l2 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        delta = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - delta[:-1], b - delta[-1]
    return UrlModel(b, w)


#: (rule, verdict), as the driver's contract fixes them.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path columns of a url column."""
    found = F.instr(url, "://")
    rest = F.when(found > 0, url.substr(found + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest fitting rule as struct<rule,verdict>, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, model: UrlModel | None = None, *, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every url."""
    model = model or fit()
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "path"):
            score = held.value.score(batch.column("host"), batch.column("path"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    host, path = url_parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    kind = pages.schema["page_id"].dataType.simpleString()
    scored = split.mapInArrow(run, f"page_id {kind}, host string, path string, score double")
    found = scored.withColumn("found", matching_rule(rules, F.col("host"), F.col("path")))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_model).alias("verdict"), "score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
