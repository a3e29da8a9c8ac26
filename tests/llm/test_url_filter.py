import time

import pytest

from emberfall.llm import url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        ends = [rest.find(c) for c in "/?#" if c in rest]
        cut = min(ends, default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [
        (len(h + p), len(h), h + p, v)
        for h, p, v in rules
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = [
    "https://a.example.net/en/1?x=http://b.net/",
    "http://EXAMPLE.Net/EN/",
    "http://example.net/en",
    "http://example.net",
    "http://notexample.com/de/x",
    "ftp://x.y.example.com/de/",
    "http://example.com:80/de/",
    "http://org/fr/#a",
    "http://www.org/fr/a/b/../c?d#e",
    "no scheme",
    "",
    "://",
    "http://?q",
    "http://net/\nnext/line",
    "http://é.net/ü/",
    None,
]


@pytest.mark.parametrize("rules", [RULES, [], [("net", "/e", "block"), ("net", "", "allow"), ("b.net", "/e", "allow"), ("b.net", "/ex/", "block")]])
def test_against_plain_rules(spark, rules):
    urls = URLS + ["http://b.net/ex/1", "http://b.net/e", "http://b.net/en", "http://c.net/", "http://c.net/e/"]
    rows = [(i % 9 if i else None, u, "x", "y") for i, u in enumerate(urls + urls[:3])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, row_url string")
    got = url_filter.judge_urls(pages, url_filter.rules_table(spark, rules)).collect()
    want = [(r[0], *plain(r[1], rules)) for r in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)


def test_conflicting_and_void_rules(spark):
    rules = spark.createDataFrame(
        [("net", "/", "allow"), ("NET", "/", "block"), (None, "/", "block"), ("org", None, "block"), ("com", "/", None)],
        url_filter.RULES_SCHEMA,
    )
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, "http://a.org"), (3, "http://a.com/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(pages, url_filter.rules_table(spark, RULES)).collect() == []


def test_long_urls(spark):
    start = time.time()
    urls = ["http://a.net/" + "x/" * 50_000, "http://example.com/de" + "/" * 50_000, "http://" + "a." * 50_000 + "org/fr/", "http://b.org/" + "y" * 200_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rules_table(spark, RULES)).collect()}
    assert got == {0: ("net/", "block"), 1: ("example.com/de/", "block"), 2: ("org/fr/", "allow"), 3: (None, "allow")}
    assert time.time() - start < 20
