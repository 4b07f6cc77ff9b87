"""URL filter: rules by brute force, held-out accuracy of the model, awkward rows."""

import random

import pytest
from cases import SF

from quillspark.llm import queries
from quillspark.llm import url_filter as U

URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?q=1#f", "http://example.com/en/", "http://example.com/en",
    "http://a.b.example.com/en/1", "https://www.example.com/en/1", "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/",
    "http://x.net?/es/", "http://x.net#/es/", "ftp://q.org/a://b.com/c", "http://com", "http://com/", "http://é.com/ü\n/x", "a\n://host/p",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.action


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "c", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, features double")


def test_rules_by_brute_force(spark):
    got = {r["page_id"]: r for r in U.judge(pages(spark, URLS), queries.URL_RULES, "allow").collect()}
    for i, url in enumerate(URLS):
        host, path, rule, action = brute(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, action or "allow"), url


def labelled(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        bad = rng.random() < 0.5
        host = rng.choice(["casino", "bet-win", "pills"] if bad else ["library", "school", "museum"])
        path = rng.choice(["/buy", "/cheap", "/offer"] if bad else ["/read", "/about", "/history"])
        noise = "".join(rng.choices("abcdefghij", k=6))
        out.append((f"http://{noise}.{host}.org{path}/{noise}", bad))
    return out


def test_held_out_accuracy(spark):
    model = U.train(spark.createDataFrame(labelled(1, 400), "url string, blocked boolean"))
    test = labelled(2, 300)
    got = {r["page_id"]: r["verdict"] for r in U.judge(pages(spark, [u for u, _ in test]), [], model).collect()}
    assert sum((got[i] == "block") == bad for i, (_, bad) in enumerate(test)) >= 0.97 * len(test)


def test_query(spark):
    rows = queries.op5_url_filter(spark, SF).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, action = brute(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == action if action else r["verdict"] in ("allow", "block")
    again = {r["page_id"]: r["verdict"] for r in queries.op5_url_filter(spark, SF).collect()}
    assert again == {r["page_id"]: r["verdict"] for r in rows}


@pytest.mark.parametrize(("labels", "verdict"), [([], "allow"), ([("http://a/", True)], "block"), ([("http://a/", False), (None, None)], "allow")])
def test_few_labels(spark, labels, verdict):
    model = U.train(spark.createDataFrame(labels, "url string, blocked boolean"))
    assert {r["verdict"] for r in U.judge(pages(spark, ["http://q/", None]), [], model).collect()} == {verdict}


def test_empty_table(spark):
    model = U.train(spark.createDataFrame(labelled(1, 40) + [(None, True)], "url string, blocked boolean"))
    assert U.judge(pages(spark, ["x"]).where("page_id < 0"), queries.URL_RULES, model).count() == 0
