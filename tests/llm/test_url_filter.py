import re

import pytest

from colonnade.llm import queries, url_filter
from workload.check import compare, connect

URLS = [
    None, "", "no scheme", "http://", "://", "HTTP://Sub.Example.ORG/es/x", "http://example.org/es", "http://example.org/en/1?q=/de/",
    "http://example.org/en/2", "https://notexample.org/es/", "http://org", "http://org/", "http://a.b.com/de/x#y", "http://com/fr/",
    "http://com.evil.net/fr/", "x://y://org/", "http://www.casino-win.net/", "http://casino-win.net?x", "http://a.org/casino-win/x.exe",
    "http://h.com/porn/", "http://h.com/PORN/", "http://h.com/" + "long/" * 20_000 + "porn/x", "http://user@a.com:80/de/", "http://a.com\n/de/x",
    "http://h.net/a%20b/login/", "http://ünïcode.org/es/",
]


def brute(url, host_rules, patterns):
    url = url or ""
    if "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, h, p in host_rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(h + p), verdict, h + p))
    if best:
        return host, path, best[2], best[1], None
    for p in patterns:
        if re.fullmatch(".*".join(map(re.escape, p.split("*"))), host + path, re.S):
            best = max(best or (0,), (len(p), "block", p))
    return host, path, None, best[1] if best else "allow", best[2] if best else None


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/")]


@pytest.mark.parametrize("most", [50_000, 0], ids=["broadcast", "joined"])
def test_odd_urls(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
    rows = [(k, u, 1) for k, u in enumerate(URLS)] + [(None, "http://a.com/de/", 1), (3, "http://a.com/de/", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")
    patterns = [*url_filter.PATTERNS, "*zz*", "*porn"]
    got = url_filter.judge_urls(
        pages, [url_filter.host_rule(*r) for r in RULES], [url_filter.pattern_rule(p) for p in patterns]
    ).collect()
    want = [(i, *brute(u, RULES, patterns)) for i, u, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_no_rows_and_no_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(pages, queries.HOST_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://A.com/x")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge_urls(one, [], []).collect()] == [(1, "a.com", "/x", None, "allow", None)]


def test_tokens_nothing_can_lengthen():
    assert url_filter.host_rule("allow", "example.org", "/en/1").tokens == ("example", "org", "en")
    assert url_filter.pattern_rule("*ab-cd*ef/gh").tokens == ("gh",)
    assert url_filter.pattern_rule("*.casino-*").tokens == ("casino",)


def test_sql(spark, sf):
    assert compare(queries.op2_url_filter(spark, sf), connect(sf), queries.ORACLE["op2_url_filter"]) is None
