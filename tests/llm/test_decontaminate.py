"""Decontamination against every window of a small fixture; awkward rows."""

import random

import duckdb
import numpy as np
from cases import AWKWARD, SF, frame, prose, tables

from quillspark.llm import decontaminate as D
from quillspark.llm import queries
from quillspark.llm import shingles as S


def normal(text):
    data = (text or "").lower().encode()
    return [data[a:b] for a, b in zip(*S.word_spans(data), strict=True)]


def brute(docs, items):
    """(doc, item, best similarity) over all windows of as many words as the item has."""
    out = {}
    bags = [(i, v, S.counted(v, 5)) for i, v in ((i, normal(t)) for i, t in items) if v]
    for d, text in docs:
        w = normal(text)
        held = set(S.counted(w, 5))
        for i, v, want in bags:
            if len(v) >= 5 and len(held & set(want)) < 0.8 * len(want):
                continue  # no window can hold enough of it
            best = max((S.weighted_similarity(S.counted(w[a : a + len(v)], 5), want) for a in range(len(w) - len(v) + 1)), default=0)
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def test_all_similar_windows_are_found(spark):
    rng = random.Random(3)
    items = [(i, prose(("item", i), rng.randint(3, 60))) for i in range(25)]
    items += [(50, items[4][1]), (51, None), (52, "  "), (53, "only four words here")]
    docs = []
    for d in range(60):
        words = prose(("doc", d), rng.randint(5, 300)).split()
        part = rng.choice(items[:25])[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            part[rng.randrange(len(part))] = "edit"
        if d % 4:
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((d, rng.choice([" ", "\n", ", "]).join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item"]): round(r["similarity"], 9) for r in D.matches(frame(spark, docs), bench).collect()}
    want = brute(docs, items)
    assert set(got) <= set(want)
    exact = {k for k, s in want.items() if s == 1.0}
    assert exact <= set(got) and len(exact) >= 20
    assert len(set(want) - set(got)) <= 0.02 * len(want)
    assert all(got[k] == want[k] for k in exact)


def test_documents_shorter_than_an_item(spark):
    items = [(i, prose(("item", i), 60 + 20 * i)) for i in range(6)]
    docs, want = [], {}
    for i, text in items:
        words = text.split()
        for k, cut in enumerate((1, 5, 10, 12, 20, 40)):
            for own in (words[cut:], words[: len(words) - cut]):
                d = len(docs)
                docs.append((d, " ".join(own)))
                found = S.weighted_similarity(S.counted(own, 5), S.counted(words, 5))
                if found >= 0.8:
                    want[d, i] = (0, len(own), round(found, 9))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.matches(frame(spark, docs), bench).collect()
    assert {(r["id"], r["item"]): (r["start"], r["n_words"], round(r["similarity"], 9)) for r in found} == want
    kept = {r["doc_id"] for r in D.keep_clean(frame(spark, docs), bench).collect()}
    assert kept == set(range(len(docs))) - {d for d, _ in want} and kept and want


def test_the_radius_reaches_the_similarity():
    rng = np.random.default_rng(2)
    found = 0
    for _ in range(4000):
        own = rng.integers(0, 1 << 63, 180, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 180, dtype=np.uint64)
        a, b = D.simhash(own[:162]), D.simhash(own[18:])  # 144 of 180 shingles are common: 0.8
        found += ((a ^ b) & (1 << 64) - 1).bit_count() <= D.RADIUS
    assert found >= 0.998 * 4000


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(5)
    left = [(n, rng.getrandbits(63)) for n in (7, 9) for _ in range(60)]
    flip = lambda p: p ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 24)))
    right = [(i, "", n, flip(p), []) for i, (n, p) in enumerate(left)]
    bench = spark.createDataFrame(right, D._ITEM)
    prints = spark.createDataFrame(left, "n_words int, fp long")
    for radius in (3, 15):
        got = {tuple(r) for r in D.within_radius(prints, bench, radius).collect()}
        want = {
            (n, p, q, (p ^ q).bit_count())
            for n, p in left for _, _, m, q, _ in right if n == m and (p ^ q).bit_count() <= radius
        }
        assert got == want


def test_query_finds_every_verbatim_item(spark):
    con = tables(duckdb.connect())
    want = set(con.sql("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)").fetchall())
    got = {(r["doc_id"], r["item_id"]) for r in queries.op4_decontaminate(spark, SF).collect()}
    assert want <= got and want
    docs = [tuple(r) for r in con.sql("SELECT doc_id, text FROM documents").fetchall()]
    assert got == set(brute(docs, con.sql("SELECT item_id, text FROM benchmark").fetchall()))


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, prose(3, 60)), (None, prose(2, 80)), (3, None), (4, "")], "item_id long, text string")
    docs = frame(spark, AWKWARD)
    found = D.matches(docs, bench)
    assert sorted((r["id"], r["item"] or 0) for r in found.collect()) == [(3, 0), (4, 0), (8, 1)]
    kept = D.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [
        (False, 0), (False, 1), (False, 2), (False, 5), (False, 6), (False, 7), (True, 0), (True, 0),
    ]
    none = bench.where("item_id > 99")
    assert D.matches(docs, none).count() == 0 and D.keep_clean(docs, none).count() == len(AWKWARD)
    assert D.matches(frame(spark, []), bench).count() == 0
