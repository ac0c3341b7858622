from __future__ import annotations

import hashlib
import random
import re

from weftgraph.llm import infill

COLUMNS = "doc_id long, text string, n string, form int"


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) with all units in a list."""
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(u)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed=1):
    rng = random.Random(seed)
    out = [None, "", "a", " ", "é", "abc", "<P>", "x<S>y", "<M", "<<P", "P>", "<P", "ab<P>cd", "日本語text漢字", "😀a😀b", "\n\t\r", "é" * 50, "a" * 50, "<<<>>>PSM<x>", "ABC def\x00ghi", "ſtraße"]
    for _ in range(150):
        out.append("".join(rng.choices(["a", "Bc", "PSM", " ", "<", ">", "é", "漢", "😀", "1", "\n", ".", "words"], k=rng.randint(0, 60))))
    return [*out, *out[10:40]]


def test_units_and_form_match_brute_force(spark):
    rows = [(None if i % 17 == 0 else i // 2, t, "x", 3) for i, t in enumerate(texts())]
    got = infill.transform(spark.createDataFrame(rows, COLUMNS)).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *brute(i, t)) for i, t, *_ in rows), key=key)


def test_restored_is_the_exact_text(spark):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(texts(7))]
    out = infill.transform(spark.createDataFrame(rows, "doc_id long, text string"), percent=100)
    got = {r.doc_id: r for r in out.select("doc_id", "form", infill.restored(F.col("output"), F.col("form")).alias("text")).collect()}
    assert {i: r.text for i, r in got.items()} == {i: t or "" for i, t in rows}
    assert {"psm", "spm", "plain"} == {r.form for r in got.values()}


def test_query_matches_brute_force(spark, sf001):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = infill.op13_fill_in_middle(spark, sf001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, p, m, out = brute(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, digest(out), digest(docs[r.doc_id] or ""))


def test_very_long_texts(spark):
    rows = [(1, "word, " * 300_000), (2, "x" * 2_000_000), (3, "é" * 1_000_000)]
    got = {r.doc_id: r for r in infill.transform(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert tuple(got[i])[1:] == brute(i, t)


def test_empty_table_and_other_ids(spark):
    assert infill.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = infill.transform(spark.createDataFrame([("a-7", "some words here")], "doc_id string, text string")).collect()[0]
    assert tuple(got) == ("a-7", *brute("a-7", "some words here"))
