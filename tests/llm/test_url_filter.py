import random

import pytest
from pyspark.sql import functions as F

from spanveil.llm.url_filter import RULES, cascade, member, url_filter

URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com/EN/x", "http://example.com/en/", "https://www.Example.com/en/1?q=/es/", "ftp://a.net/es/x", "http://a.net?x=/es/", "http://anet/es/", "http://xexample.com/en/", "http://com", "http://com/", "x://b.org/p#f?", "http://m.b.org/p\n?x", "http://a.net/fr/#", "http://\xc9.org/", "http://first://second.com/"]


def brute(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if host in listed else "allow"


@pytest.mark.parametrize("most", [50_000_000, 0])
def test_against_brute_force(spark, most):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://b.org/"), (3, "http://b.org/")]
    pages = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "page_id long, url string, host string, html string")
    keys = ["b.org", "m.b.org", "never.seen", None, "", "b.org"]
    listed = spark.createDataFrame([(k, 1) for k in keys], "key string, rule int")
    got = sorted(map(tuple, url_filter(pages, listed, most_listed=most).collect()), key=str)
    assert got == sorted(((a, *brute(b, keys)) for a, b in rows), key=str)
    assert url_filter(pages.limit(0), listed).collect() == []
    assert {x.verdict for x in url_filter(pages.where("page_id = 13"), listed.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_on_many_keys(spark):
    r = random.Random(7)
    keys = [(f"host{i}.example", r.random() < 0.2) for i in range(20_000)]
    universe = spark.createDataFrame(keys, "key string, listed boolean")
    levels = cascade(universe)
    assert len(levels) >= 2
    assert universe.where(member(F.col("key"), levels) != F.col("listed")).count() == 0


def test_cascade_of_one_side_only(spark):
    for flag in (True, False):
        universe = spark.createDataFrame([(str(i), flag) for i in range(50)], "key string, listed boolean")
        levels = cascade(universe)
        assert {x[0] for x in universe.select(member(F.col("key"), levels)).collect()} == {flag}
