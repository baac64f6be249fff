"""URL rules against a plain search of all rules, by broadcast and by shuffle."""

import random
import re

import pytest

from corpusmill.llm import url_filter as U

RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "a.b.org", ""),
    ("allow", "b.org", "/x"), ("block", "b.org", "/x"), ("block", "localhost", "/"), (None, "q.com", "/"), ("block", None, "/"),
]
ODD = [
    None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.Com/en/7?x#y", "http://xexample.com/en/7", "http://www.example.com/en/70", "http://É.com/en/", "http://com/en/",
    "http://a.b.org", "http://z.a.b.org?q=/x", "http://b.org/x#://b", "http://b.org/X", "ftp://u:p@localhost:80/", "x://localhost/a://b", "http://e..com/en/", "http://.com/en/1", "http://net/de", "http://com/" + "en/" * 5000,
]


def judged(url):
    host, path = "", ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "allow", h + p, v) for v, h, p in RULES if v and h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


@pytest.mark.parametrize("broadcast_rules", [20_000, 0])
def test_against_all_rules(spark, broadcast_rules):
    rng = random.Random(8)
    part = lambda *x: rng.choice(x)
    urls = ODD + ODD[5:8] + [f"http://{part('', 'www.', 'a.b.')}{part('example.', 'b.', '')}{part('com', 'net', 'org')}{part('/en/', '/de/', '/x')}{rng.randrange(100)}" for _ in range(300)]
    df = spark.createDataFrame([(i if i % 7 else None, u, "mine", "mine") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = U.judge_urls(df, U.rule_table(spark, RULES), broadcast_rules=broadcast_rules)
    assert sorted(got.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
    want = [(i if i % 7 else None, *judged(u)) for i, u in enumerate(urls)]
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    rules, some = U.rule_table(spark, RULES), spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    assert U.judge_urls(some.where("false"), rules).collect() == []
    (r,) = U.judge_urls(some, rules.where("false")).collect()
    assert (r.rule, r.verdict) == (None, "allow")
