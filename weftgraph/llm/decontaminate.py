"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z. One pass
over the documents splits them into words and writes the index: postings (term,
row, position) of every term that occurs in a benchmark item, and one closing
posting per row, which carries its number of words. A term is a word or two
consecutive words; windows are made of their pairs of words, as nearly all words
of a text occur in some item, but few of its pairs. All that follows reads the
index, never a text.

A phrase is looked up from its rarest terms. The posting lists of the two
rarest, each shifted by the term's offset in the phrase, are intersected on
(row, start); the lists of the other terms, restricted to the rows that are
left, are intersected with that in one step, and only starts that all terms
reach are matches. Rows are told apart by a 128-bit key of id and text.

The benchmark's terms and the probed terms of its phrases are the small side:
they are broadcast while their measured rows and bytes are within bounds, and
joined by a shuffle beyond, where adaptive execution splits frequent terms.
Posting lists are never gathered: they meet on (phrase, row, start).

Defined cases: null texts and items have no words; an item shorter than a
window, but not empty, is one window; equal windows of several items are looked
up once; a row is judged by its own text, whatever its id, null ids too;
repeated rows are judged each; an empty table on either side gives no hits;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import Workspace, bounded, drop_rows, row_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; ``lower`` serves pure ASCII, where it changes A-Z alone."""
    text = F.coalesce(text, F.lit(""))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(folded, SEPARATORS), "")


#: The term of a row's closing posting; no word is empty.
END = ""


def pairs_of(seq: str) -> Column:
    """Each word of a column of words, a space and the next word; null at the last."""
    return F.transform(seq, lambda w, i: F.concat(w, F.lit(" "), F.get(seq, i + 1)))


def terms_of(seq: str) -> Column:
    """The terms that a phrase is looked up by: its pairs of consecutive words, or its only word."""
    return F.when(F.size(seq) > 1, F.slice(pairs_of(seq), 1, F.greatest(F.size(seq) - 1, F.lit(0)))).otherwise(F.col(seq))


class PositionalIndex:
    """Postings (term, key, pos) of training documents for the listed terms, as a table.

    A listed term is a word, or two joined by a space: then ``pos`` is the first's.
    The closing posting of each row has the term ``END``, its number of words
    as position, and its ``doc_id``.
    """

    def __init__(self, docs: DataFrame, terms: DataFrame):
        self.ws = Workspace(docs.sparkSession, "positional-index")
        known = self.ws.table("terms", terms.select("term").union(docs.sparkSession.range(1).select(F.lit(END))).distinct())
        paired = F.contains("term", F.lit(" "))
        pairs, singles = not known.filter(paired).isEmpty(), not known.filter(~paired & (F.col("term") != END)).isEmpty()
        # key and words are made before the words are dealt out, once a row
        split = docs.select(row_key().alias("key"), "doc_id", words(F.col("text")).alias("words"))
        closing = F.array(F.lit(END))
        if pairs and singles:
            both = F.concat(F.arrays_zip(F.col("words").alias("a"), pairs_of("words").alias("b")), F.array(F.struct(F.lit(END).alias("a"), F.lit(None).cast("string").alias("b"))))
            flat = split.select("key", "doc_id", F.posexplode(both).alias("pos", "at")).select("key", "doc_id", "pos", F.explode(F.array("at.a", "at.b")).alias("term"))
        else:
            flat = split.select("key", "doc_id", F.posexplode(F.concat(pairs_of("words") if pairs else F.col("words"), closing)).alias("pos", "term"))
        held = flat.join(bounded(known, F.col("term")), "term", "left_semi")
        self.table = self.ws.table("postings", held.select("term", "key", "pos", F.when(F.col("term") == END, F.col("doc_id")).alias("doc_id")))
        self.postings = self.table.filter(F.col("term") != END).select("term", "key", "pos")
        self.rows = self.table.filter(F.col("term") == END).select("key", "doc_id", F.col("pos").cast("bigint").alias("n_words"))

    def phrases(self, wanted: DataFrame) -> DataFrame:
        """Exact matches (phrase_id, key, start, len) of ``wanted`` (phrase_id, seq array<string>); all of ``terms_of`` its phrases have to be listed."""
        df = self.ws.table("frequencies", self.postings.groupBy("term").agg(F.count("*").alias("df")))
        flat = wanted.select("phrase_id", F.size("seq").alias("len"), F.posexplode(terms_of("seq")).alias("at", "term")).join(bounded(df, F.col("term")), "term", "left")
        by_phrase = Window.partitionBy("phrase_id")
        flat = flat.withColumn("rank", F.row_number().over(by_phrase.orderBy("df", "term", "at"))).withColumn("absent", F.max(F.col("df").isNull()).over(by_phrase))
        # a phrase with a term that occurs nowhere has no match
        flat = self.ws.table("terms-of-phrases", flat.filter("NOT absent").drop("absent", "df"))
        probes = self.ws.table("probes", flat.filter("rank <= 2").select("phrase_id", "term", "at", "len", F.expr("shiftleft(1, rank - 1)").alias("bit")))
        lists = self.postings.join(bounded(probes, F.col("term"), F.col("phrase_id")), "term").select("phrase_id", "key", "len", (F.col("pos") - F.col("at")).alias("start"), "bit").filter("start >= 0")
        met = lists.groupBy("phrase_id", "key", "start", "len").agg(F.bit_or("bit").alias("bits")).filter("bits = if(len <= 2, 1, 3)")
        met = self.ws.table("met", met.select("phrase_id", "key", "start", "len"))
        rest = self.ws.table("rest", flat.filter("rank > 2").select("phrase_id", "at", "term"))
        due = met.join(bounded(rest, F.col("term"), F.col("phrase_id")), "phrase_id").select("phrase_id", "key", "start", (F.col("start") + F.col("at")).alias("pos"), "term")
        ids = self.ws.table("ids", met.select("key").distinct())
        near = self.postings.join(bounded(ids), "key", "left_semi")
        found = due.join(near, ["key", "pos", "term"], "left_semi").groupBy("phrase_id", "key", "start").agg(F.count("*").alias("n"))
        return met.join(found, ["phrase_id", "key", "start"], "left").filter("coalesce(n, 0) = greatest(len - 3, 0)").select("phrase_id", "key", "start", "len")

    def near(self, first: str, second: str, within: int) -> DataFrame:
        """Proximity: (key, pos, other) where two listed terms stand at most ``within`` words apart.

        Posting lists meet on (row, block of positions): each posting of the
        first term probes its own block and the two beside it.
        """
        held = self.postings.withColumn("block", F.floor(F.col("pos") / max(1, within)))
        a = held.filter(F.col("term") == first).select("key", "pos", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"))
        b = held.filter(F.col("term") == second).select("key", F.col("pos").alias("other"), "block")
        return a.join(b, ["key", "block"]).filter((F.abs(F.col("pos") - F.col("other")) <= within) & (F.col("pos") != F.col("other"))).select("key", "pos", "other").distinct()


def near_terms(docs: DataFrame, first: str, second: str, within: int) -> DataFrame:
    """(doc_id, pos, other) of the places where the two terms stand at most ``within`` words apart."""
    index = PositionalIndex(docs, docs.sparkSession.createDataFrame([(first,), (second,)], "term string"))
    return index.near(first, second, within).join(index.rows.select("key", "doc_id").distinct(), "key").select("doc_id", "pos", "other")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, seq): every run of ``window`` words of an item; all words of a shorter one."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("seq"))


def _lookup(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[PositionalIndex, DataFrame, DataFrame]:
    """The index for the benchmark's terms, its windows (item_id, phrase_id, seq) and their matches."""
    windows = Workspace(docs.sparkSession, "benchmark").table("windows", item_windows(benchmark, window).select("item_id", F.md5(F.concat_ws(" ", "seq")).alias("phrase_id"), "seq").distinct())
    index = PositionalIndex(docs, windows.select(F.explode(terms_of("seq")).alias("term")))
    hits = index.phrases(windows.select("phrase_id", "seq").dropDuplicates(["phrase_id"]))
    return index, windows, index.ws.table("hits", hits)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    index, windows, hits = _lookup(docs, benchmark, window)
    # covered words: each start covers up to the next start of the document or its own end
    spans = hits.groupBy("key", "start").agg(F.max("len").alias("len"))
    reach = F.max(F.col("start") + F.col("len")).over(Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("before", F.coalesce(reach, F.lit(0))).select("key", F.greatest(F.col("start") + F.col("len") - F.greatest("start", "before"), F.lit(0)).alias("new")).groupBy("key").agg(F.sum("new").alias("n_hit"))
    pairs = hits.select("key", "phrase_id").distinct().join(windows.select("phrase_id", F.col("item_id").cast("string").alias("item")), "phrase_id").select("key", "item").distinct()
    items = pairs.groupBy("key").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    found = index.ws.table("found", covered.join(items, "key", "left"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return index.rows.join(bounded(found), "key", "left").select("doc_id", "n_words", n_hit.cast("bigint").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """The rows without a hit word, with all their columns."""
    index, _, hits = _lookup(docs, benchmark, window)
    gone = index.ws.table("gone", hits.select("key").distinct())
    index.ws.keep("gone")
    return drop_rows(docs, gone)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM folded
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, w[i : i + 9] AS seq
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT len(seq) AS n FROM win
), grams AS (
  SELECT doc_id, n, i, w[i : i + n - 1] AS seq
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.seq = win.seq
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
