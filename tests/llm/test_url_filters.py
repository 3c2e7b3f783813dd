import random

import pytest
from pyspark.sql import functions as F

from paraspark.llm import url_filters as U
from tests.llm.helpers import rows_by


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = rest[:cut].translate(str.maketrans(upper, upper.lower()))
    tail = rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "https://A.B.Net/x", "http://example.net/en/1?q=/", "http://example.net/en",
        "http://www.example.com/de/x#/fr/", "http://x.org/fr/", "http://x.org/FR/", "http://u:p@x.org:80/fr/", "a://b://c.org/fr/", "http://org/fr/é",
        "http://.org/fr/", "http://..net/", "http://x.net?/", "http://x.net#a", "http://É.ORG/fr/", "http://x.net/" + "p/" * 20_000]


@pytest.mark.parametrize("limit", [U.BROADCAST_RULES, 0])
def test_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(U, "BROADCAST_RULES", limit)
    rng = random.Random(1)
    urls = URLS + [f"http://{'.'.join(rng.choice(['a', 'b', 'org', 'net', 'example']) for _ in range(rng.randint(1, 4)))}/{rng.choice(['en', 'fr', 'de', 'x'])}/{k}" for k in range(200)]
    rules = [*U.RULES, ("a.org", "", "block"), ("a.org", "/e", "allow"), ("b", "/x/1", "block"), ("b", "/x/1", "allow"), (None, "/", "block"), ("", "/", "block")]
    frame = spark.createDataFrame(rules, "host string, path string, action string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = rows_by(U.judge_urls(pages, frame), "page_id")
    for i, url in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == brute(url, rules), url
    assert len(got) == len(urls)


def test_empty_tables_repeated_rows_and_extra_columns(spark):
    rules = spark.createDataFrame(U.RULES, "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id long, url string")
    clash = pages.withColumn("host", F.lit(1)).withColumn("short", F.lit(2)).withColumn("verdict", F.lit(3))
    got = U.judge_urls(clash, rules.withColumn("digest", F.lit("x"))).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got) == [(0, "allow"), (1, "block"), (1, "block")]
    assert U.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in U.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
