from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

from weftgraph.llm import warc
from weftgraph.llm.common import Workspace

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: %s\r\n\r\n"


def expected(rows):
    low = defaultdict(list)
    for i, h in rows:
        if len((h or "").encode()) >= 100:
            low[h].append(i)
    out = Counter()
    for i, h in rows:
        body = (h or "").encode()
        ids = [x for x in low.get(h, []) if x is not None]
        first = min(ids) if ids else None
        again = bool(low.get(h)) and i != first
        out[i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    return out


def corpus():
    long_ = "<p>é" * 40
    rows = [(5, long_), (3, long_), (9, long_), (9, long_), (1, "x" * 99), (2, "x" * 99), (4, None), (6, ""), (None, long_), (None, "y" * 150), (40, "z" * 100), (41, "z" * 100)]
    rows += [(10, "a" + FAKE % 4 + "abcd\r\n\r\n"), (11, FAKE % "9" * 3), (12, "\r\n\r\nWARC/1.1\r\n"), (13, "WARC/1.1\r\n" * 5), (14, FAKE % "-7"), (15, FAKE % "99999999999999999999"), (16, "WARC/1.1\r\nWARC-Type: x"), (17, "a\r\n\r\n" + FAKE % 0 + "\r\n\r\n" + FAKE % 200), (18, "end\r\n\r\n")]
    return rows + [(100 + i, f"page {i} " * (i % 40)) for i in range(200)]


def test_round_trip(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, h, "u") for i, h in rows], "page_id long, html string, value string").repartition(3)
    found = Counter(tuple(r) for r in warc.round_trip(frame).collect())
    assert found == expected(rows)


def test_small_splits(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "page_id long, html string").coalesce(1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert Counter(tuple(r) for r in warc.round_trip(frame).collect()) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_archive_format(spark):
    path = Workspace(spark, "warc-test").path("a")
    warc.write_archives(spark.createDataFrame([(7, "é" * 60)], "page_id long, html string"), path)
    [raw] = [r.content for r in spark.read.format("binaryFile").load(f"{path}/part-*").collect()]
    head, body = bytes(raw).split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\n") and b"Content-Length: 120" in head
    assert body == "é".encode() * 60 + b"\r\n\r\n"


def test_broken_chain_is_an_error(spark):
    path = Workspace(spark, "warc-test").path("broken")
    spark.createDataFrame([(FAKE % 50 + "short",)], "value string").write.option("lineSep", warc.END).text(path)
    with pytest.raises(ValueError, match="chain"):
        warc.read_archives(spark, path).collect()


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_ids_keep_their_type(spark):
    long_ = "<p>é" * 40
    rows = [("b>c d", long_), ("a\r\n:%", long_), ("", "x"), (None, long_), ("z", None)]
    got = Counter(tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, "page_id string, html string")).collect())
    assert got == expected(rows)
    frame = spark.createDataFrame([(1, long_, 2, "r"), (2, long_, 3, "s")], "page_id int, html string, size int, file string")
    out = warc.round_trip(frame)
    assert out.schema["page_id"].dataType.simpleString() == "int" and out.schema["refers_to"].dataType.simpleString() == "int"
    assert Counter(tuple(r) for r in out.collect()) == expected([(1, long_), (2, long_)])
