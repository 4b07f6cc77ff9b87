"""Near copies against all pairs of 5-word shingle sets; awkward rows."""

import random

import corpus_pipeline
from cases import AWKWARD, SF, frame, prose

from quillspark.llm import near_copies as N
from quillspark.llm import simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"edit{rng.randrange(10**6)}"
    return out


def copies():
    """Texts with chains and groups of copies of 1-4% edited words."""
    rng = random.Random(6)
    rows = []
    for base in range(25):
        words = prose(("base", base), rng.randint(100, 400)).split()
        rows.append(words)
        for k in range(6):
            rows.append(edited(rng, rng.choice([words, rows[-1]]), max(1, len(words) * (k % 4 + 1) // 100)))
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def brute(rows):
    """Smallest id of the component of each id."""
    held = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(held[i] & held[j]) >= 0.8 * len(held[i] | held[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_stage_against_all_pairs(spark):
    rows = copies()
    want = brute(rows)
    assert 25 < len(set(want.values())) < len(rows) / 2
    docs = frame(spark, rows)
    assert {r["id"]: r["component_id"] for r in N.near_copies(docs).collect()} == want
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == set(want.values())


def test_awkward_rows(spark):
    docs = frame(spark, AWKWARD)
    got = N.near_copies(docs).collect()
    assert len(got) == len(AWKWARD)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [
        (False, 0), (False, 3), (False, 5), (False, 6), (False, 7), (False, 8), (True, 0),
    ]
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_sets_move_only_for_texts_that_share_a_band(spark, monkeypatch):
    """The sets of shingles are as large as the texts; a table of all classes with their sets moved them once more."""
    kept, real = {}, N.stored
    monkeypatch.setattr(N, "stored", lambda df, name, **k: kept.setdefault(name, real(df, name, **k)))
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0] + " more", texts[0]])], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in N.near_copies(docs).collect()}
    assert got == {i: 0 if i in (0, 20, 21) else i for i in range(22)}
    assert "shingles" not in kept["classes"].columns
    assert kept["asked"].count() == 2  # the text and its near copy; its exact copy is of its class
