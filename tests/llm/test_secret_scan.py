"""Secret scan against SQL and Python's regular expressions; trigram queries; awkward rows."""

import re

import duckdb
from cases import AWKWARD, SF, frame, ordered, prose, tables

from quillspark.llm import oracles, queries
from quillspark.llm import secret_scan as X


def brute(text):
    out = []
    for i, rule in enumerate(X.RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), i, m.end()))
    return sorted(out)


TRICKY = [
    'password = "abcdefgh"', "PASSWD:'x'; Token=abc123def", "password=token:abcdef", "api_key==aaaaaa apikey : zzzzzz",
    "secret = a\nsecret=abcdef", "é token=tökenabc token=\U0001f600abc", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIA" + "B" * 30,
    "0123456789abcdef" * 3, "0" * 23, "g" + "a" * 24 + "h", "ghp_" + "a" * 36, "xoxb-1234567890-abc", "AIza" + "x" * 35,
    "sk_live_" + "a1" * 8, "eyJhbGciOi.eyJzdWIiOi.abcdefgh1", "-----BEGIN RSA PRIVATE KEY-----", "the broken password is here",
    " ".join(f"token=abc{i:05d}" for i in range(700)), "pass word tok en",
]


def test_query_matches_sql(spark):
    df = queries.op7_secret_scan(spark, SF)
    sql = tables(duckdb.connect()).sql(oracles.ORACLES["op7_secret_scan"])
    assert ordered(df.collect(), df.columns) == ordered(sql.fetchall(), sql.columns)


def test_tricky_texts(spark):
    rows = [(i, f"{prose(i, 5)} {t} {prose(i, 3)}") for i, t in enumerate(TRICKY)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in X.scan(frame(spark, rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert sum(map(bool, got.values())) >= 14


def test_trigram_queries_are_necessary():
    for rule in X.RULES:
        query = X.trigram_query(rule.pattern)
        for text in TRICKY:
            if query is not None and re.search(rule.pattern, text):
                assert any(all(g in text.lower() for g in choice) for choice in query), (rule.kind, text)
    assert X.trigram_query("[0-9a-f]+") is None and X.trigram_query("ab|xyz") is None
    assert X.trigram_query("foo(bar|baz)?") == [frozenset({"foo"})]
    assert X.trigram_query("ab[cd]e") == [frozenset({"abc", "bce"}), frozenset({"abd", "bde"})]


def test_awkward_rows(spark):
    rows = [*AWKWARD, (40, "token=abcdef"), (40, "token=abcdef"), (None, "token=abcdef")]
    got = X.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sum(bool(r["spans"]) for r in got) == 3
    assert X.scan(frame(spark, [])).count() == 0
