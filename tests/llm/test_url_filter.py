"""URL rules against trying every rule on every url."""

import pytest

from fathom.llm import url_filter as U

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("a.example.net", "", "block"), ("a.example.net", "/en/", "allow"), ("a.example.net", "/en/", "block"), ("et", "/", "block"),
         (None, "/", "block"), ("x.org", None, "block"), ("net", "/", "block")]
URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://M.Example.NET/en/1?x#y", "http://example.net/en", "http://xexample.net/en/1",
        "http://a.example.net", "http://b.a.example.net/en/2", "http://q.org/fr/", "http://q.org/FR/", "http://example.com?/de/", "http://example.com/de/x://y/",
        "://x.example.com/de/", "http://example.com:80/de/", "http://n-et.net/", "http://..net/", "http://Ä.NET/é", "http://x.et/", "line\nhttp://a.net/\n?"]


def brute(url):
    i = (url or "").find("://")
    rest = url[i + 3:] if i >= 0 else ""
    stop = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:stop])
    path = rest[stop:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in RULES if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


@pytest.mark.parametrize("rows", [1, 7, 500])
def test_like_brute_force_for_any_number_of_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(U, "RANGE_ROWS", rows)
    urls = [(i, u, "c") for i, u in enumerate(URLS * 3)] + [(None, "http://hot.net/x", "c")] * 60
    got = U.judge_urls(spark.createDataFrame(urls, "page_id long, url string, host string"), spark.createDataFrame(RULES, "host string, path string, verdict string"))
    want = [(i, *brute(u)) for i, u, _ in urls]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert U.judge_urls(urls.where("false"), rules).collect() == []
    assert U.judge_urls(urls, rules.where("false"), default="block").first()["verdict"] == "block"
