"""Repeated passages against exact 50-word windows; near passages, clusters and awkward rows."""

import random

import numpy as np
from cases import AWKWARD, SF, frame, prose

from quillspark.llm import passages as P
from quillspark.llm import queries
from quillspark.llm import shingles as S


def normal(text):
    data = (text or "").lower().encode()
    return [data[a:b] for a, b in zip(*S.word_spans(data), strict=True)]


def sharing(docs, size):
    """Documents that hold a run of ``size`` words which another document holds too."""
    held = {}
    for d, text in docs:
        w = normal(text)
        for i in range(len(w) - size + 1):
            held.setdefault(tuple(w[i : i + size]), set()).add(d)
    return {d for v in held.values() if len(v) > 1 for d in v}


def test_query_against_exact_windows(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"] for r in queries.op6_passages(spark, SF).collect()}
    must, may = sharing(docs, P.PARAGRAPH + P.ANCHORS - 1), sharing(docs, 18)
    assert must and must <= got <= may


def test_passages_inside_other_text(spark):
    passage = prose("shared", 51)
    rows = [(i, f"{prose(i, 40 + 7 * i)} {passage} {prose(100 + i, 30 + 5 * i)}") for i in range(12)]
    rows += [(50 + i, prose(500 + i, 200)) for i in range(10)]
    got = P.repeated(frame(spark, rows)).collect()
    assert {r["id"] for r in got} == set(range(12))
    assert {r["id"] for r in got if not r["removed"]} == {0}
    inside = set(S.counted(normal(passage), 5))
    for r in got:  # a paragraph may reach over the end of the passage by a word or two
        own = set(S.counted(normal(dict(rows)[r["id"]])[r["start"] : r["start"] + r["n_words"]], 5))
        assert len(own & inside) >= 0.8 * len(own)


def test_removals_cover_every_place_to_its_ends(spark):
    passage, rows, held = prose("again", 130).split(), [], {}
    for i in range(5):
        words, at = [], []
        for k in range(3):
            words += [*prose((i, k), 25).split(), f"left{i}x{k}"]
            at.append(range(len(words), len(words) + len(passage)))
            words += [*passage, f"right{i}x{k}"]
        rows.append((i, " ".join(words)))
        held[i] = {w for r in (at if i else at[1:]) for w in r}
    got = {i: set() for i in held}
    for r in P.repeated(frame(spark, rows)).collect():
        if r["removed"]:
            got[r["id"]] |= set(range(r["start"], r["start"] + r["n_words"]))
    for i, words in held.items():  # a similar paragraph may reach over an end of the passage by a word or two
        assert words <= got[i], (i, sorted(words - got[i]))
        assert all({w - 2, w - 1, w + 1, w + 2} & words for w in got[i] - words), (i, sorted(got[i] - words))


def test_edited_passages_are_linked(spark):
    hit = 0
    for seed in range(4):
        rng = random.Random(seed)
        words = prose(("p", seed), 120).split()
        rows = []
        for i in range(6):
            own = list(words)
            own[rng.randrange(100, 118)] = "edit"
            rows.append((i, " ".join([*prose((seed, i), 30).split(), *own])))
        hit += {r["id"] for r in P.repeated(frame(spark, rows)).collect()} == set(range(6))
    assert hit == 4


def test_similar_paragraphs_share_a_band():
    rng = random.Random(9)
    found = total = 0
    for seed in range(300):
        a = prose(("x", seed), 30).split()
        b = list(a)
        b[rng.choice([0, 1, 28, 29])] = "edit"
        sets = [S.shingle_hashes(S.word_hashes(t, *S.word_spans(t)), 5) for t in (" ".join(w).encode() for w in (a, b))]
        common = len(set(sets[0].tolist()) & set(sets[1].tolist()))
        if common / (2 * len(sets[0]) - common) < 0.8:
            continue
        keys = P.band_keys(np.stack(sets))
        found += bool((keys[0] == keys[1]).any())
        total += 1
    assert total > 200 and found / total > 0.95


def test_groups_link_all_similar_members():
    rng = random.Random(4)
    sets = [frozenset(rng.sample(range(40), 20)) for _ in range(30)]
    sets += [frozenset([*list(s)[:18], 50, 51]) for s in sets[:10]]
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                old, new = parent[i], parent[j]
                parent = [new if p == old else p for p in parent]
    rows = np.array([sorted(s) for s in sets], np.uint32)
    links = list(zip(*(x.tolist() for x in P.links(np.zeros(len(rows)), rows, 0.8)), strict=True))
    got = list(range(len(sets)))
    for a, b in links:
        old, new = got[a], got[b]
        got = [new if p == old else p for p in got]
    classes = lambda ps: sorted(sorted(i for i, q in enumerate(ps) if q == p) for p in set(ps))
    assert classes(got) == classes(parent) and len(links) < len(sets)
    assert all(similar(sets[a], sets[b]) for a, b in links)


def test_awkward_rows(spark):
    got = P.repeated(frame(spark, AWKWARD)).collect()
    assert {r["id"] for r in got} == {3, 4}
    assert {r["id"] for r in got if not r["removed"]} == {3}
    assert P.repeated(frame(spark, [])).count() == 0
    same = "x " * 500
    assert {r["id"] for r in P.repeated(frame(spark, [(1, same), (2, same), (None, same)])).collect()} == {1, 2, None}
    assert P.repeated(frame(spark, [(1, same), (1, same), (2, prose(1, 90))])).count() == 0


def test_groups_of_several_bands_with_repeats_inside_a_set():
    rng = random.Random(5)
    rows = np.array([[rng.randrange(9) for _ in range(6)] for _ in range(200)], np.uint32)
    rows = np.concatenate((rows, [rng.sample(range(9), 6) for _ in range(200)])).astype(np.uint32)
    rng.shuffle(order := list(range(400)))
    rows = rows[order]
    band = np.sort(np.array([rng.randrange(40) for _ in rows]))
    a, b = P.links(band, rows, 0.8)
    got, want = list(range(len(rows))), list(range(len(rows)))
    sets = [set(r) for r in rows.tolist()]
    every = [(i, j) for i in range(400) for j in range(i) if band[i] == band[j]]
    every = [(i, j) for i, j in every if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for parent, found in ((got, zip(a.tolist(), b.tolist(), strict=True)), (want, every)):
        for i, j in found:
            old, new = parent[i], parent[j]
            parent[:] = [new if p == old else p for p in parent]
    names = lambda ps: [ps.index(p) for p in ps]
    assert names(got) == names(want) and len(set(want)) < 400 and len(a) == 400 - len(set(want))


def test_anchors_are_the_smallest_of_every_window():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 20, 21, 32):
        for hashes in (rng.integers(0, 1 << 63, 500, dtype=np.uint64), rng.integers(0, 5, 500, dtype=np.uint64) << np.uint64(40)):
            want = np.unique([i + hashes[i : i + size].argmin() for i in range(500 - size + 1)])
            assert (P.anchors(hashes, size) == want).all()


def test_band_keys_are_made_for_many_texts_at_once(monkeypatch):
    """A text has few paragraphs, so a call for each costs more than the paragraphs; the rows are those of each text."""
    from unittest.mock import MagicMock

    import pyarrow as pa

    docs, calls, real = MagicMock(), [], P.band_keys
    monkeypatch.setattr(P, "F", MagicMock())
    monkeypatch.setattr(P, "content_key", MagicMock())
    monkeypatch.setattr(P, "band_keys", lambda inside: calls.append(len(inside)) or real(inside))
    P.band_rows(docs, "text", "doc_id")
    run = docs.select.return_value.mapInArrow.call_args.args[0]
    texts = ["", *(" ".join(f"w{i}x{k}" for k in range(80)) for i in range(40))]
    columns = [pa.array(texts), pa.array(range(1, 42), pa.int32())]
    (rows,) = run(iter([pa.RecordBatch.from_arrays(columns, names=["text", "doc"])]))
    assert len(calls) == 1
    got = set(zip(*(rows.column(c).to_numpy().tolist() for c in ("band", "key", "doc")), strict=True))
    want = set()
    for tag, body in enumerate(texts, 1):
        _, keys, inside, _ = P.paragraphs(body)
        for key, bands in zip(keys.view(np.int64).tolist(), real(inside).view(np.int64).tolist(), strict=True):
            want |= {(band, key, tag) for band in bands}
    assert got == want


def test_texts_of_a_block_are_read_at_once_and_apart(monkeypatch):
    """One call hashes the words of many short texts; paragraphs and edges are those of each text alone."""
    import pyarrow as pa

    calls, real = [], S.word_hashes
    sizes = (0, 1, 29, 30, 31, 49, 50, 51, 52, 80, 300)
    texts = [None, "", "x " * 500, *(f" {prose(('t', n), n).upper()}. " for n in sizes), "x " * 35]
    monkeypatch.setattr(S, "word_hashes", lambda *a: calls.append(1) or real(*a))
    (got,) = P.blocks(pa.array(texts))
    assert len(calls) == 1
    sides, _ = P.around(got, np.arange(len(got.of)))
    row = 0
    for i, text in enumerate(texts):
        data = (text or "").lower().encode()
        words = real(data, *S.word_spans(data))
        hashes = S.shingle_hashes(words, P.SHINGLE)
        room = max(0, len(words) - P.PARAGRAPH + 1)
        for start in P.anchors(hashes[:room], min(P.ANCHORS, room)) if room else []:
            own = hashes[start : start + P.PARAGRAPH - P.SHINGLE + 1]
            assert (got.of[row], got.starts[row], got.left[row]) == (i, start, len(words) - start - P.PARAGRAPH)
            assert (got.inside[row] == own).all()
            assert got.keys[row] == S.mixed((own * P._SLOTS).sum(keepdims=True))[0]
            edges = words[max(0, start - P.EDGE) : start][::-1], words[start + P.PARAGRAPH :][: P.EDGE]
            for side, edge in zip(sides[:, row], edges, strict=True):
                assert (side == np.append(edge, np.zeros(P.EDGE - len(edge), np.uint64))).all()
            row += 1
    assert row == len(got.of) > len(sizes)
    monkeypatch.setattr(P, "BLOCK", 600)
    apart = list(P.blocks(pa.array(texts)))
    assert len(apart) > 3
    for c in ("of", "starts", "left", "keys", "inside"):
        assert (np.concatenate([getattr(x, c) for x in apart]) == getattr(got, c)).all()


def test_members_of_a_large_key_are_compared_only_if_they_can_be_similar(monkeypatch):
    """The sets of a frequent phrase have a part in common; comparing all of them took time with the square of the key."""
    rng = np.random.default_rng(6)
    n, width = 3000, 26
    rows = rng.integers(1000, 1 << 32, (n, width), dtype=np.uint32)
    rows[:, :15] = np.arange(15)
    rows[1::10, :24] = rows[::10, :24]  # similar to the one before
    rows[2::20, :3] = rows[2::20, 20:23]  # repeats inside a set
    rows[3::20] = rows[2::20]
    rows[3::20, 0] = 99
    band = np.zeros(n, np.int64)
    assert (np.bincount(P.meetings(band, rows, 0.8)[1]) ** 2).sum() < 20 * n
    rows, band = np.concatenate((rows[:300], rows[:70], rows[100:300])), np.repeat([0, 1, 2], (300, 70, 200))
    monkeypatch.setattr(P, "CROWD", 100)
    a, b = P.links(band, rows, 0.8)
    sets = [set(r) for r in rows.tolist()]
    every = [(i, j) for i in range(len(rows)) for j in range(i) if band[i] == band[j]]
    every = [(i, j) for i, j in every if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got, want = list(range(len(rows))), list(range(len(rows)))
    for parent, found in ((got, zip(a.tolist(), b.tolist(), strict=True)), (want, every)):
        for i, j in found:
            old, new = parent[i], parent[j]
            parent[:] = [new if p == old else p for p in parent]
    names = lambda ps: [ps.index(p) for p in ps]
    assert names(got) == names(want) and 50 < len(rows) - len(set(want)) < len(rows) // 2
