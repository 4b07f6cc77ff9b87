"""Collocations against SQL and plain counting; collisions, long texts and awkward rows."""

import random
import re
from collections import Counter
from itertools import groupby

import duckdb
import numpy as np
from cases import AWKWARD, SF, frame, ordered, prose, tables

from quillspark.llm import collocations as C
from quillspark.llm import oracles, queries


def plain_counts(rows):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                counts.update((lang, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return counts, totals


def brute(rows, least=10, top=2000):
    counts, totals = plain_counts(rows)
    found = []
    for (lang, phrase), a in counts.items():
        w = phrase.split(" ")
        if len(w) < 2 or a < least:
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = counts[lang, " ".join(w[:k])], counts[lang, " ".join(w[k:])]
            cuts.append((1000000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        found.append((lang, phrase, a, l, r, totals[lang], score))
    covers = {}
    for lang, phrase, a, *_ in found:
        w = phrase.split(" ")
        if len(w) == 3:
            for part in (" ".join(w[:2]), " ".join(w[1:])):
                covers[lang, part] = max(covers.get((lang, part), 0), a)
    found = [f for f in found if 100 * covers.get(f[:2], 0) < 50 * f[2]]
    found.sort(key=lambda f: (f[0], -f[6], -f[2], f[1].encode()))
    return [(f[0], i + 1, *f[1:]) for _, g in groupby(found, key=lambda f: f[0]) for i, f in enumerate(g) if i < top]


def mined(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def corpus():
    rng = random.Random(8)
    vocabulary = [*prose("v", 25).split(), "É", "naïve", "a b", "\x00", "Ü"]
    out = []
    for i in range(200):
        text = ""
        for _ in range(rng.randint(0, 90)):
            text += rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " | ", "\x0b"])
        out.append((i, text * rng.choice([1, 1, 3]), rng.choice(["en", "de", None])))
    return out


def with_langs(spark, rows):
    return spark.createDataFrame([(i, t, g) for i, t, g in rows], "doc_id long, text string, lang string")


def test_query_matches_sql(spark):
    df = queries.op13_collocations(spark, SF)
    sql = tables(duckdb.connect()).sql(oracles.ORACLES["op13_collocations"])
    assert ordered(df.collect(), df.columns) == ordered(sql.fetchall(), sql.columns)


def test_against_plain_counting_with_small_blocks(spark):
    rows = corpus()
    want = brute([(g, t) for _, t, g in rows])
    assert len(want) > 20 and {len(w[2].split(" ")) for w in want} == {2, 3}
    assert mined(C.collocations(with_langs(spark, rows), block_bytes=200)) == want
    assert mined(C.collocations(with_langs(spark, rows), top=5)) == brute([(g, t) for _, t, g in rows], top=5)


def test_collisions_are_recounted_by_text(spark):
    """Keys of 8 bits: nearly all phrases collide."""
    rows = corpus()
    df = C.collocations(with_langs(spark, rows), bits=8)
    assert mined(df) == brute([(g, t) for _, t, g in rows])


def test_fingerprints_do_not_depend_on_the_place():
    text = prose("fp", 30_000).encode() + b"\n"
    block = C.Block(text + text, np.array([len(text), 2 * len(text)]))
    half = len(block.starts) // 2
    for size in (1, 2, 3):
        at, keys, checks = block.grams(size, np.zeros(2, np.uint64), C._mask(64))
        a, b = at < half - 3, (at >= half) & (at < 2 * half - 3)
        assert (keys[a] == keys[b]).all() and (checks[a] == checks[b]).all()
        words = [block.phrase(i, size) for i in at[a].tolist()]
        assert len(set(words)) == len(set(keys[a].tolist()))


def test_cuts_keep_every_byte():
    rng = random.Random(2)
    for most in (1, 5, 40):
        text = "".join(rng.choice("ab .,\n") for _ in range(300)).encode()
        parts = list(C._cut(text, most))
        assert b"".join(parts) == text
        assert all(p[-1:] in b".,\n" for p in parts[:-1])


def test_awkward_rows(spark):
    assert mined(C.collocations(frame(spark, AWKWARD))) == brute([("en", r[1]) for r in AWKWARD])
    assert C.collocations(frame(spark, [])).count() == 0
    same = [(7, "x y. " * 30)] * 4 + [(None, "x y z")] * 9
    assert mined(C.collocations(frame(spark, same))) == brute([("en", t) for _, t in same])
    one = "word " * 5000
    assert mined(C.collocations(frame(spark, [(1, one)]))) == brute([("en", one)])
