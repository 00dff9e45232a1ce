from __future__ import annotations

import os

import pytest

from graftwood.llm import queries
from graftwood.llm.url_filter import UrlFilter, canonical_path, filter_urls, listing

RULES = [("net", "/", "block", True), ("example.net", "/en/", "allow", True), ("example.com", "/de/", "block", True), ("org", "/fr/", "allow", True), ("bad.example.org", "/", "block", False)]
URLS = {
    "http://a.b.net/x": ("a.b.net", "/x", "net/", "block"),
    "HTTP://M.Example.NET/en/1?q#f": ("m.example.net", "/en/1", "example.net/en/", "allow"),
    "https://example.net/EN/1": ("example.net", "/EN/1", "net/", "block"),
    "https://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
    "https://x.example.com/de/y/../z": ("x.example.com", "/de/y/../z", "example.com/de/", "block"),
    "https://x.example.com/de": ("x.example.com", "/de", None, "allow"),
    "https://bad.example.org/fr/1": ("bad.example.org", "/fr/1", "org/fr/", "allow"),
    "https://w.bad.example.org/en": ("w.bad.example.org", "/en", None, "block"),
    "https://net": ("net", "", None, "allow"),
    "https://net?x=/a": ("net", "", None, "allow"),
    "https://a.net/p?u=http://b.org/fr/": ("a.net", "/p", "net/", "block"),
    "no scheme a.net/x": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "://": ("", "", None, "allow"),
    "x://É.NET/\n": ("É.net", "/\n", "net/", "block"),
}


def test_query_equals_its_sql(spark, duck, same_rows, sf):
    same_rows(queries.op3_url_filter(spark, sf).toPandas(), duck.execute(queries.ORACLES["op3_url_filter"]).df())


@pytest.mark.parametrize("p", [UrlFilter(), UrlFilter(blocks=1, bits=1), UrlFilter(broadcast_rows=0)])
def test_cases(spark, p):
    pages = spark.createDataFrame([(k, u, "clash", "clash", "clash") for k, u in enumerate(URLS)] + [(None, None, None, None, None), (0, next(iter(URLS)), "x", "x", "x")], "page_id long, url string, host string, key string, r string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string, named boolean")
    rows = filter_urls(pages, rules, p).collect()
    want = [(k, *v) for k, v in enumerate(URLS.values())] + [(None, "", "", None, "allow"), (0, *next(iter(URLS.values())))]
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, want))


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string, named boolean")
    assert filter_urls(pages.limit(0), rules).count() == 0
    assert tuple(filter_urls(pages, rules.limit(0)).first()) == (1, "a.net", "/", None, "allow")


def test_the_list_is_an_input(spark, sf, tmp_path):
    """Listed under every top-level domain, the junk hosts of each table are blocked where no rule decides."""
    path = os.path.join(os.path.dirname(queries.__file__), "url_list.txt")
    spark.conf.set(queries.URL_LIST_PATH, path)
    try:
        for at, n in ((sf, 1), (sf.replace("0.001", "0.01"), 13), (sf.replace("0.001", "0.1"), 107)):
            rows = queries.op3_url_filter(spark, at).filter("rule is null and host rlike '(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)[.]example[.]'").collect()
            assert [r["verdict"] for r in rows] == ["block"] * n
        own = tmp_path / "list.txt"
        own.write_text("# nothing\n\nExample.org/en/ # a path\nthther.example.com\n")
        spark.conf.set(queries.URL_LIST_PATH, str(own))
        for r in queries.op3_url_filter(spark, sf).filter("rule is null").collect():
            assert (r["verdict"] == "block") == (r["host"].endswith("example.org") and r["path"].startswith("/en/") or r["host"] == "thther.example.com")
    finally:
        spark.conf.unset(queries.URL_LIST_PATH)


@pytest.mark.parametrize(
    "url,verdict",
    [
        ("https://user:pw@w.bad.example.org:8080/en", "block"),
        ("https://BAD.example.org./x", "block"),
        ("https://bad.example.org", "block"),
        ("https://evil.example.com/x/../a/%62/c", "block"),
        ("https://evil.example.com/a/./b/", "block"),
        ("https://evil.example.com/a/%2e%2E/a/b/..", "allow"),
        ("https://evil.example.com/a/b", "allow"),
        ("https://evil.example.com/../../a/b/%zz%", "block"),
        ("https://evil.example.com/a%2Fb/", "allow"),
        ("https://nobad.example.org/", "allow"),
    ],
)
def test_listed_urls_are_canonical(spark, url, verdict):
    listed = listing(spark.createDataFrame([("Bad.Example.org",), ("evil.example.com:443/a/./%62/",)], "url string"))
    row = filter_urls(spark.createDataFrame([(1, url)], "page_id long, url string"), listed).first()
    assert (row["rule"], row["verdict"]) == (None, verdict)


@pytest.mark.parametrize("path,want", [("", "/"), ("/", "/"), ("a", "/a"), ("/a/../../b/.", "/b/"), ("/..", "/"), ("/a/b/..", "/a/"), ("/a//b", "/a//b"), ("/%7e%41%2f%", "/~A%2F%"), ("/.a/..b", "/.a/..b")])
def test_canonical_paths(spark, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(canonical_path(df["p"])).first()[0] == want
