"""WARC archives of pages: writing with revisits, reading with a verified record chain.

Writing: payloads of ``least`` bytes or more are grouped by SHA-256; the
smallest page id becomes the response record, the others revisit it and carry
no payload. Records go through Spark's text writer, whose line separator is the
blank line pair that ends a WARC record, so every part file is an archive on
any file system that Spark writes to.

Each record has the fields that WARC 1.1 asks for (date, target URI where the
page has one, profile of a revisit); ``WARC-Payload-Length`` is an extension that
tells the length a revisit leaves out.

Reading: the files are split at every occurrence of the record magic, wherever
it stands, so tasks of one file work apart. Each piece has an offset from the
summed lengths before it. The pieces and their order are read once and written
to the shared folder, so that every later step sees the same numbering, however
the executors come and go. A piece that looks like a record emits its offset and
the offset its header names as its successor; a payload that holds the magic
(even a whole embedded record) emits a candidate too. Pointer jumping from
offset 0 of each file, doubling the distance each round, keeps only the
records that the chain reaches. Pieces behind a reached record, up to its
successor, are its payload.

Defined cases: a null payload is empty; payloads shorter than ``least`` are
never grouped; rows repeated with one id and payload are all responses of that
id; ids may have any type that a string can be cast back to, and are written
percent-encoded; a null page id is written as a record id without number, read
back as null, and is the response of a group only if no other id is in it; an
empty table gives an empty result; texts of any length are one record; further
columns are ignored. A file whose chain breaks raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import Workspace, bounded, restrict, without

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("binary"), F.lit(b""))


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, sha, refers_to) of pages whose payload a smaller id holds too; only digests are shuffled."""
    digests = pages.select("page_id", F.sha2(_payload(), 256).alias("sha"), F.octet_length(_payload()).alias("size")).filter(F.col("size") >= least)
    first = digests.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    return digests.join(first.select("sha", "refers_to"), "sha").filter("NOT page_id <=> refers_to").select("page_id", "sha", "refers_to").distinct()


#: Fixed value: the profile of a revisit that has the same payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: str) -> Column:
    """A record id; characters that could end it are encoded."""
    return F.concat(F.lit("<urn:page"), F.coalesce(F.concat(F.lit(":"), F.url_encode(F.col(page_id).cast("string"))), F.lit("")), F.lit(">"))


def records(pages: DataFrame, least: int, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One string per page: the WARC header block, a blank line and the payload."""
    ws = Workspace(pages.sparkSession, "warc-write")
    again = ws.table("revisits", revisits(pages, least))
    again = bounded(again, F.col("sha"))
    sha = F.sha2(_payload(), 256)
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "") if "url" in pages.columns else F.lit(None).cast("string")
    p = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"), sha.alias("digest"), url.alias("uri"))
    r = again.select(F.col("page_id").alias("r_id"), F.col("sha").alias("r_sha"), "refers_to")
    p = p.join(r, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_sha")), "left")
    revisit = F.col("r_sha").isNotNull()
    size = F.octet_length("html")
    header = [
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), _urn("page_id"), F.lit("\r\nContent-Type: text/html; charset=utf-8"),
        F.lit(f"\r\nWARC-Date: {date}"), F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), "uri"), F.lit("")), F.when(revisit, f"\r\nWARC-Profile: {PROFILE}").otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nWARC-Payload-Length: "), size.cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), _urn("refers_to"))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.when(revisit, "0").otherwise(size.cast("string")), F.lit(END), F.when(revisit, "").otherwise(F.col("html")),
    ]
    return p.select(F.concat(*header).alias("value"))


def write_archives(pages: DataFrame, path: str, *, least: int = 100, records_per_file: int = 20_000) -> None:
    records(pages, least).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def _header(piece: Column, name: str) -> Column:
    """The value of a header field; only the part before the first blank line is searched."""
    block = F.substring_index(piece, END, 1)
    return F.regexp_extract(F.concat(F.lit("\r\n"), block, F.lit("\r\n")), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, size, value): text between magics and its byte offset; ``value`` lacks the magic that ends it.

    A file starts with the magic, so its first piece is empty and every later
    piece starts behind a magic. Offsets are those of the piece's own magic.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"), "value", F.monotonically_increasing_id().alias("ord"))
    return raw.withColumn("size", F.octet_length("value").cast("bigint") + len(MAGIC))


def read_archives(spark: SparkSession, path: str, *, id_type: str = "bigint", consume: bool = False) -> DataFrame:
    """Reached records: page_id, record_type, digest, length, refers_to, payload; ids are read as ``id_type``.

    With ``consume`` the archives are deleted as soon as their pieces are stored.
    """
    ws = Workspace(spark, "warc-read")
    raw = ws.table("raw", _pieces(spark, path), compression="zstd")
    if consume:
        ws.remove(path)
    has_end = F.instr("value", END) > 0
    head = F.substring_index("value", END, 1)
    length = F.when(F.col("length").rlike("^[0-9]{1,15}$"), F.col("length").cast("bigint"))
    parsed = raw.select("file", "block", "ord", "size", "bytes", F.when(has_end, _header(F.col("value"), "Content-Length")).alias("length"), F.octet_length(head).alias("head"))
    parsed = ws.table("candidates", parsed.select("file", "block", "ord", "size", "bytes", (F.lit(len(MAGIC) + len(END)) + F.col("head") + length + len(END)).alias("span")))
    # offsets in two levels: sums per block of a file, then within the block
    blocks = parsed.groupBy("file", "block").agg(F.sum("size").alias("sum"))
    prior = F.sum("sum").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", F.coalesce(prior, F.lit(0)).alias("prior"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("file", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the piece at sum s follows the magic that starts at s - len(MAGIC); the empty piece 0 is no record
    placed = parsed.withColumn("inside", inside).join(blocks, ["file", "block"]).select("file", "ord", (F.col("prior") + F.col("inside") - len(MAGIC)).alias("start"), "span")
    placed = ws.table("placed", placed.filter("start >= 0"))
    links = placed.filter("span IS NOT NULL").select("file", "start", (F.col("start") + F.col("span")).alias("next"))
    reached = _reach(ws, links)
    broken = parsed.groupBy("file").agg(F.max("bytes").alias("start")).join(reached, ["file", "start"], "left_anti").limit(1).collect()
    if broken:
        raise ValueError(f"the record chain of {broken[0].file} doesn't reach its end")
    # the record of each piece is the last reached start at or before it
    owner = F.last(F.when(F.col("hit"), F.col("start")), ignorenulls=True).over(Window.partitionBy("file").orderBy("start"))
    owned = placed.join(reached.withColumn("hit", F.lit(True)), ["file", "start"], "left").select("file", "ord", "start", F.coalesce("hit", F.lit(False)).alias("hit"), owner.alias("record"))
    owned = ws.table("owned", owned)
    # only records that hold the magic are put together; the others are read straight from the files
    split = ws.table("split", owned.join(owned.filter("NOT hit").select("file", "record").distinct(), ["file", "record"], "left_semi").select("ord", "file", "record"))
    n = split.count()
    texts = raw.select("ord", "value")
    whole = without(texts.filter("value != ''"), split.select("ord"), n, "ord").select("value")
    if n:
        whole = whole.unionByName(_joined(restrict(texts, split.select("ord"), n, "ord").join(split, "ord")))
    value, block = F.col("value"), F.substring_index("value", END, 1)
    named = whole.select("value", F.length(block).alias("head"), *[_header(value, n).alias(k) for k, n in (("rid", "WARC-Record-ID"), ("ref", "WARC-Refers-To"), ("type", "WARC-Type"), ("sum", "WARC-Payload-Digest"), ("len", "WARC-Payload-Length"))])
    number = lambda c: F.expr(f"CASE WHEN {c} LIKE '<urn:page:%' THEN try_cast(try_url_decode(regexp_extract({c}, '<urn:page:([^>]*)>', 1)) AS {id_type}) END")
    payload = value.substr(F.col("head") + len(END) + 1, F.length(value) - F.col("head") - 2 * len(END))
    return named.select(number("rid").alias("page_id"), F.col("type").alias("record_type"), F.regexp_replace("sum", "^sha256:", "").alias("digest"), F.expr("try_cast(len AS BIGINT)").alias("length"), number("ref").alias("refers_to"), payload.alias("payload"))


def _joined(parts: DataFrame) -> DataFrame:
    """Records put together from their pieces; a record's pieces are as many as its payload holds magics."""
    grouped = parts.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("ord", "value"))).alias("parts"))
    return grouped.select(F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC).alias("value"))


def _reach(ws: Workspace, links: DataFrame) -> DataFrame:
    """(file, start) of candidates on the chain from offset 0, by pointer jumping.

    Each round doubles the jump of every candidate and adds the jumps of what
    is reached, so a chain of n records takes about log2(n) rounds.
    """
    reached = ws.table("reached", links.filter("start = 0").select("file", "start"))
    n = reached.count()
    while True:
        jumps = links.select("file", "start", F.col("next").alias("to"))
        more = reached.unionByName(reached.join(jumps, ["file", "start"]).select("file", F.col("to").alias("start"))).distinct()
        more = ws.table("reached", more)
        ws.drop(reached)
        reached, before, n = more, n, more.count()
        if n == before:
            return reached
        second = links.select("file", F.col("start").alias("next"), F.col("next").alias("after"))
        links = ws.table("links", links.join(second, ["file", "next"], "left").filter("after IS NOT NULL").select("file", "start", F.col("after").alias("next")))


def round_trip(pages: DataFrame, *, least: int = 100) -> DataFrame:
    """Writes the pages' archives to the shared folder and reports what reading them back gives."""
    ws = Workspace(pages.sparkSession, "warc")
    if pages.isEmpty():
        kind = pages.schema["page_id"].dataType
        return pages.select(F.col("page_id").cast(kind), F.lit(0).cast("bigint").alias("payload_bytes"), F.lit("").alias("payload_digest"), F.lit("").alias("record_type"), F.col("page_id").alias("refers_to"))
    write_archives(pages, ws.path("archives"), least=least)
    read = read_archives(pages.sparkSession, ws.path("archives"), id_type=pages.schema["page_id"].dataType.simpleString(), consume=True)
    revisit = F.col("record_type") == "revisit"
    body = F.col("payload").cast("binary")
    return read.select("page_id", F.when(revisit, F.col("length")).otherwise(F.octet_length(body)).cast("bigint").alias("payload_bytes"), F.when(revisit, F.col("digest")).otherwise(F.sha2(body, 256)).alias("payload_digest"), "record_type", F.when(revisit, F.col("refers_to")).alias("refers_to"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS sha FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS low FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> low THEN low END AS refers_to
FROM m
"""
