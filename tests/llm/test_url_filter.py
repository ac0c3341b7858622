from __future__ import annotations

import re
from collections import Counter

import pytest

from weftgraph.llm import url_filter

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/1?x#y", "https://example.net/EN/", "http://x.net", "http://x.net?a=/b", "ftp://net/", "http://notnet/", "http://a.org/fr/2", "http://borg/fr/2", "http://org/fr",
    "http://a.example.com/de/5#z", "http://anexample.com/de/5", "a://b.net/c://d.org/fr/", "x?y=://host.org/fr/1", "http://ÉX.net/é", "http://h.org#/fr/", "http://u:p@h.net:80/", "http://multi\nline.net/a\nb?c",
]


def brute(url):
    rest = url.partition("://")[2] if url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for r, v in url_filter.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_parts_and_rules(spark):
    frame = spark.createDataFrame([(i, u, "s") for i, u in enumerate(URLS)], "page_id long, url string, score string")
    rows = {r.page_id: r for r in url_filter.judge(frame).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == (verdict or ("block" if rows[i].score >= 0.5 else "allow"))


def test_query_on_a_table(spark, sf001):
    pages = spark.read.parquet(f"{sf001}/pages.parquet").select("page_id", "url").collect()
    found = Counter((r.page_id, r.host, r.path, r.rule) for r in url_filter.op1_url_filter(spark, sf001).collect())
    assert found == Counter((p.page_id, *brute(p.url)[:3]) for p in pages)


@pytest.mark.parametrize("url, unwanted", [("http://m.casino-win.example.com/en/5", True), ("https://ads-track.example.org/fr/9", True), ("http://www.spam-farm.example.com/x", True), ("https://blog.tionsh.example.com/en/5", False), ("http://ththan.example.org/de/77.html", False)])
def test_model_on_unseen_urls(url, unwanted):
    import pyarrow as pa

    host, path = url_filter.host_path(url)
    assert (url_filter.fit().score(pa.array([host]), pa.array([path]))[0] >= 0.5) == unwanted


def test_empty_table(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
