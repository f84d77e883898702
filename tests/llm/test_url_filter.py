"""The URL filter against a plain loop over rules."""

from __future__ import annotations

import random
import re

import pytest

from carewatch.llm import queries as q
from carewatch.llm import urlfilter

from ..conftest import DATA

PAGES, RULES = "page_id long, url string", "host string, path string, verdict string"


def split(url):
    m = re.search(r"^.*?://([^/?#]*)([^?#]*)", url or "", re.S)
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def brute(pages, rules, otherwise="allow"):
    known = {}
    for host, path, verdict in rules:
        k = re.sub("[A-Z]", lambda c: c[0].lower(), host or ""), path or ""
        known[k] = max(known.get(k, ""), verdict or "block")
    out = []
    for page_id, url in pages:
        host, path = split(url)
        fit = [(len(h + p), len(h), h + p, v) for (h, p), v in known.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out.append((page_id, host, path, max(fit)[2] if fit else None, max(fit)[3] if fit else otherwise))
    return sorted(out, key=repr)


def got(spark, pages, rules, **options):
    rows = urlfilter.judged(spark.createDataFrame(pages, PAGES), spark.createDataFrame(rules, RULES), **options)
    assert rows.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted((tuple(r) for r in rows.collect()), key=repr)


AWKWARD = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://com"), (6, "http://COM/"), (7, "x://a://b/c"), (8, "http://www.Example.com/en/a?b#c"), (8, "http://www.Example.com/en/a?b#c"), (None, "http://notexample.com/en/"),
    (9, "http://example.com/en"), (10, "http://example.com?x=/en/"), (11, "http://.com/"), (12, "http://com./"), (13, "http://a.net/es/\n/é"), (14, "//net/fr/"), (15, "http://net/fr/" + "z" * 300_000), (16, "http://" + "a." * 5000 + "net/es/x"), (17, "http://x.net/fr/#/es/"), (18, "http://ÉXAMPLE.com/"),
]


def test_awkward_urls(spark):
    assert got(spark, AWKWARD, urlfilter.RULES) == brute(AWKWARD, urlfilter.RULES)
    assert got(spark, AWKWARD, []) == brute(AWKWARD, [])
    assert got(spark, [], urlfilter.RULES) == []
    odd = [("", "", "block"), (None, None, "allow"), ("Com", "/", None), ("com", "/", "allow"), ("net", "", "allow")]
    assert got(spark, AWKWARD, odd, otherwise="block") == brute(AWKWARD, odd, "block")


@pytest.mark.parametrize("few", [True, False])
def test_nested_rules_in_slices(spark, monkeypatch, few):
    """Deep nests, a host with a third of the rows and of the rules, equal urls across slices."""
    monkeypatch.setattr("carewatch.operators.scan.LEAST", 20)
    rng = random.Random(3)
    label = lambda: rng.choice(["a", "b", "c"])
    host = lambda: "hot.a" if rng.random() < 0.3 else ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "/" * (rng.random() < 0.9) + "".join(rng.choice("x/é") for _ in range(rng.choice([0, 1, 2, 3, 9])))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(150)] + [("hot.a", "/" + "x" * k, rng.choice(["allow", "block"])) for k in range(40)]
    pages = [(k, f"http://{host()}{path()}") for k in range(500)] + [(k, "http://hot.a/" + "x" * rng.randint(0, 45)) for k in range(200)] + [(k, "http://hot.a/xx/x") for k in range(200)]
    assert got(spark, pages, rules, broadcast_hosts=10**6 if few else 0) == brute(pages, rules)


def test_extra_columns_and_no_python(spark):
    pages = spark.createDataFrame([(1, "http://www.example.com/en/", "x", 2, "r")], "page_id long, url string, host string, _row long, state string")
    rows = urlfilter.op11_urls(pages)
    assert [tuple(r) for r in rows.collect()] == [(1, "www.example.com", "/en/", "www.example.com/en/", "allow")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_equals_sql(spark, same):
    same(q.QUERIES["op11_urls"](spark, DATA), q.SQL["op11_urls"])
