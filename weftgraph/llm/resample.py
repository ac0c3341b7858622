"""Importance resampling of documents towards a target distribution, in DataFrame operations only.

Features are the runs of one to ``grams`` consecutive words, hashed into
``buckets`` buckets. A bucket's gain is the scaled log ratio of its smoothed
frequency in the target against that in all documents; a document's weight is
the mean gain of its features. With a Gumbel draw hashed from its id added to
the weight, the highest scores are a sample without replacement in proportion
to the exponentiated weights.

1. One pass over documents and target explodes the n-gram arrays and counts the
   buckets. Counts are combined on the map side, so a task sends at most one row
   a bucket, however frequent a word is.
2. A second pass explodes again, joins the gains (one row a bucket, at most
   ``buckets`` of them, so broadcast) and sums them by row; these sums are
   combined on the map side too, and one row per document is shuffled.
3. The draw sorts the eligible documents across partitions. A row's rank is its
   place in its partition plus the rows of the partitions before; only these
   counts, one per partition, reach the driver.

Defined cases: a null text has no words, and a text without words has weight 0;
a null id is hashed as no characters and comes last among equal scores; repeated
rows are drawn each, those of one id with equal scores in the order of their
number of features; an empty target has no counts, so gains follow from the
documents alone; an empty table gives an empty result; texts of any length are
one array in a row; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import Workspace
from weftgraph.llm.decontaminate import words

#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
PLACE_BITS = 33


def _grams(w: Column, n: int) -> Column:
    """Runs of n consecutive words; each array is evaluated once."""
    out = w
    for k in range(1, n):
        size = F.greatest(F.size(w) - k, F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(1), size), F.slice(w, F.lit(k + 1), size), lambda a, b: F.concat_ws(" ", a, b))
    return out


class ImportanceResampler:
    """Weights and draws of documents (doc_id, text) towards the texts of ``target``."""

    def __init__(self, docs: DataFrame, target: DataFrame, *, grams: int = 2, buckets: int = 10_000):
        self.docs, self.target, self.grams, self.buckets = docs, target, grams, buckets
        self.ws = Workspace(docs.sparkSession, "resample")

    def _exploded(self, texts: DataFrame, *keep: Column) -> DataFrame:
        """``keep``, n_words and bucket: a row for each feature, one with a null bucket where there is none."""
        split = texts.select(*keep, words(F.col("text")).alias("w"))
        flat = split.select(*[c for c in split.columns if c != "w"], F.size("w").alias("n_words"), F.concat(*[_grams(F.col("w"), n + 1) for n in range(self.grams)]).alias("grams"))
        flat = flat.select(*[c for c in flat.columns if c != "grams"], F.explode_outer("grams").alias("gram"))
        return flat.select(*[c for c in flat.columns if c != "gram"], (F.crc32("gram") % self.buckets).alias("bucket"))

    def gains(self) -> DataFrame:
        """(bucket, gain) of the buckets that documents have."""
        both = self._exploded(self.docs, F.lit(0).alias("side")).unionByName(self._exploded(self.target, F.lit(1).alias("side")))
        counts = both.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.when(F.col("side") == 0, 1)).alias("s"), F.count(F.when(F.col("side") == 1, 1)).alias("t"))
        counts = self.ws.table("counts", counts)
        total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
        s, t = (F.col(c).cast("double") + 1 for c in "st")
        smooth = lambda n: F.lit(float((n or 0) + self.buckets))
        return counts.filter("s > 0").select("bucket", F.floor(F.lit(1000.0) * F.log((t * smooth(total.s)) / (s * smooth(total.t)))).alias("gain"))

    def weighed(self) -> DataFrame:
        """(doc_id, n_words, n_features, weight) per row of the documents."""
        rows = self._exploded(self.docs, F.monotonically_increasing_id().alias("row"), F.col("doc_id"))
        held = rows.join(F.broadcast(self.gains()), "bucket", "left")
        sums = held.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").cast("bigint").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0).cast("bigint")).alias("total"))
        mean = F.expr("CASE WHEN n_features > 0 THEN (total - pmod(total, n_features)) div n_features ELSE 0L END")
        return sums.select("doc_id", "n_words", "n_features", mean.alias("weight"))

    def draw(self, *, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
        """Per document: doc_id, n_features, weight, score, rank (null where not drawn)."""
        digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
        h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
        gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
        scored = self.ws.table("scored", self.weighed().withColumn("score", F.col("weight") + gumbel))
        eligible = scored.filter(F.col("n_words") >= least_words)
        place = F.monotonically_increasing_id()
        ordered = self.ws.table("ordered", eligible.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight").withColumn("place", place))
        part = F.shiftright("place", PLACE_BITS).cast("int")
        sizes = sorted((r.part, r.n) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
        offsets, before = [], 0
        for p, n in sizes:
            offsets.append((p, before))
            before += n
        most = before * percent // 100
        offsets = F.broadcast(self.docs.sparkSession.createDataFrame(offsets, "part int, before bigint"))
        rank = F.col("before") + F.col("place").bitwiseAND((1 << PLACE_BITS) - 1) + 1
        ranked = ordered.withColumn("part", part).join(offsets, "part").withColumn("rank", F.when(rank <= most, rank))
        rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
        columns = ("doc_id", "n_features", "weight", "score", "rank")
        return ranked.select(*columns).unionByName(rest.select(*columns))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ImportanceResampler(docs, benchmark).draw()


ORACLE = r"""
WITH crc AS (  -- the bytewise table of CRC-32, from its polynomial
  SELECT list(c ORDER BY i) AS tab
  FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), w AS (
  SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM texts
), f AS (
  SELECT side, id, unnest(w) AS gram FROM w
  UNION ALL
  SELECT side, id, w[i] || ' ' || w[i + 1] FROM (SELECT side, id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1)
), g AS (SELECT side, id, gram, count(*) AS n FROM f GROUP BY ALL
), b AS (
  SELECT gram, xor(list_reduce(list_transform(range(1, 1 + octet_length(encode(gram))), lambda i: CAST('0x' || substr(hex(encode(gram)), 2 * i - 1, 2) AS BIGINT)),
                               lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT gram FROM g), crc
), h AS (SELECT side, id, bucket, sum(n) AS n FROM g JOIN b USING (gram) GROUP BY ALL
), c AS (SELECT bucket, CAST(sum(n) FILTER (side = 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS DOUBLE) AS t FROM h GROUP BY bucket
), total AS (SELECT sum(s) AS s, sum(t) AS t FROM c
), gain AS (
  SELECT bucket, CAST(floor(1000.0::DOUBLE * ln(((c.t + 1) * (total.s + 10000)) / ((c.s + 1) * (total.t + 10000)))) AS BIGINT) AS gain FROM c, total WHERE c.s > 0
), sums AS (SELECT id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM h JOIN gain USING (bucket) WHERE side = 0 GROUP BY id
), scored AS (
  SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n, 0) AS n_features,
         CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
         CAST('0x' || substr(sha256('7:' || CAST(w.id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN sums USING (id) WHERE side = 0
), drawn AS (
  SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM drawn WHERE n_words >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN r <= 25 * n // 100 THEN CAST(r AS BIGINT) END AS rank
FROM drawn LEFT JOIN ranked USING (doc_id)
"""
