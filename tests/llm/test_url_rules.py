"""URL rules against a plain loop, and on odd rows."""

import re

import pytest

from procwatch.llm import url_rules

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"), ("a.net", "/es/x", "allow"), ("net", "/es/x/y", "block"),
         ("org", "", "block"), ("EXAMPLE.org", "/A", "allow")]
URLS = ["http://example.com/en/1", "https://www.example.com/en/", "http://m.www.example.com/en/2?x#y", "http://com/",
        "http://notexample.com/en/", "ftp://a.b.net/es/x/y/z", "http://a.net/es/x/q", "http://a.net/es/", "http://net/fr",
        "http://x.org", "http://x.org?q", "http://sub.example.org/Abc", "no scheme", "", None, "://", "http:///en/",
        "http://a,b.com/", "http://..com/", "http://com./en/", "a://b://c.net/es/1", "http://x.com#/en/", "http://exämple.com/é",
        "http://" + "a." * 3000 + "net/es/1", "http://x.net/es/" + "p" * 50000, "http://a b.net/fr/\nq"]


def by_hand(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h.lower() + p, v) for h, p, v in rules
            if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("rules", [RULES, RULES[:1], []])
def test_follows_the_definition(spark, rules):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 3)], "page_id long, url string, host string")
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_rules.judge(pages.repartition(7), given).collect()
    assert len(got) == len(URLS) * 3
    for r in got:
        assert tuple(r)[1:] == by_hand((URLS * 3)[r["page_id"]], rules)


def test_repeated_rows_and_null_ids(spark):
    pages = spark.createDataFrame([(None, "http://a.com/")] * 3 + [(1, "http://a.com/")] * 2, "page_id long, url string")
    given = spark.createDataFrame(RULES + RULES[:2], "host string, path string, verdict string")
    got = url_rules.judge(pages, given).collect()
    assert [r["rule"] for r in got] == ["com/"] * 5


def test_empty_table(spark):
    given = spark.createDataFrame(RULES + [(None, "/", "block")], "host string, path string, verdict string")
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string"), given).count() == 0
