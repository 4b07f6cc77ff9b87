import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import edits as E
from quillspark.operators import ngrams as N
from quillspark.operators import spelling as S
from quillspark.plans import spell_checker as P

LETTERS = "abcdefghijklmnopqrstuvwxyz"
PAIRS = [("teh", "the"), ("caat", "cat"), ("ct", "cat"), ("cot", "cat"), ("at", "cat"), ("xthe", "the")]


def near(t):
    cuts = [(t[:i], t[i:]) for i in range(len(t) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
    out |= {a + c + b[1:] for a, b in cuts if b for c in LETTERS}
    return out | {a + c + b for a, b in cuts for c in LETTERS}


def random_words(seed, n, longest=8):
    r = random.Random(seed)
    pick = lambda: "".join(r.choice(r.choice(["ab", "abc", "abcdefé_"])) for _ in range(r.randint(1, longest)))
    return sorted({pick() for _ in range(n)})


def frame(spark, words, name):
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


def test_edit_sets(spark):
    words = ["a", "cat", "sta", "the", "é_x", ""]
    rows = frame(spark, words, "t").select("t", E.edits1(F.col("t")).alias("e")).collect()
    for r in rows:
        assert set(r.e) == near(r.t) and len(r.e) == len(set(r.e))
    assert {r.t: len(r.e) for r in rows}["cat"] == 182


def test_learned_channel(spark):
    pairs = spark.createDataFrame(PAIRS, "error string, correct string")
    got = {(r.error_type, r.key): (r.n, r.p) for r in P.learn_channel(pairs).collect()}
    assert {k: (n, pytest.approx(p)) for k, (n, p) in got.items()} == {
        ("transposition", "he"): (1, 1), ("insertion", "aa"): (1, 1 / 3), ("insertion", "#x"): (1, 1 / 18),
        ("deletion", "ca"): (1, 1), ("deletion", "#c"): (1, 1 / 18), ("substitution", "oa"): (1, 1 / 3),
    }
    letters = N.letter_counts(frame(spark, [e for e, _ in PAIRS], "word").withColumn("n", F.lit(1)))
    assert letters.count() == 18
    maps = {r.error_type: r.table for r in S.confusion_maps(S.learn_confusions(pairs)).collect()}
    assert maps["insertion"] == {"#x": 1, "aa": 1}


def test_parity_keys(spark):
    df = spark.createDataFrame(PAIRS + [("ca", "cat")], "e string, c string")
    e, c = F.col("e"), F.col("c")
    rows = df.select("e", E.lookup_key_parity(e, c).alias("look"), E.learn_key_parity(e, c).alias("learn"),
                     E.error_type(e, c, parity=True).alias("kind")).collect()
    got = {r.e: (r.look, r.learn, r.kind) for r in rows}
    assert got["ca"] == ("ca", "ta", "deletion")
    assert got["teh"] == ("eh", "eh", "substitution")
    assert got["at"] == ("c", "c", "deletion")
    assert got["ct"] == ("ca", "ac", "deletion")


def test_known_edits_match_brute_force(spark):
    terms, words = random_words(1, 120), random_words(2, 250)
    got = {tuple(r) for r in S.known_edits(frame(spark, terms, "term"), frame(spark, words, "word")).collect()}
    assert got == {(t, w) for t in terms for w in near(t) & set(words)}


def dense_channel(spark):
    """A positive rate for every key over a small alphabet."""
    chars = "#abcdefé_"
    rows = [
        (kind, a + b, 1 / (3 + 7 * i + j + k))
        for k, kind in enumerate(["deletion", "insertion", "substitution", "transposition"])
        for (i, a), (j, b) in itertools.product(enumerate(chars + "gx"), enumerate(chars + "gx"))
        if not (kind == "substitution" and "#" in a + b)
    ]
    return rows, spark.createDataFrame(rows, "error_type string, key string, p double")


def key(error, correct):
    at = next((i for i, (x, y) in enumerate(zip(error, correct)) if x != y), min(len(error), len(correct)))
    before = correct[at - 1] if at else "#"
    if len(error) < len(correct):
        return "deletion", before + correct[at]
    if len(error) > len(correct):
        return "insertion", before + error[at]
    if sorted(error) == sorted(correct) and error != correct:
        return "transposition", correct[at : at + 2]
    return "substitution", error[at : at + 1] + correct[at : at + 1]


def brute_scores(terms, words, rates):
    rate = lambda e, c: rates.get(key(e, c), 0.0) if e != c else 0.0
    out = {}
    for t in terms:
        for c in near(t) - {t, ""}:
            p = rate(t, c)
            if p == 0:
                continue
            if c in words:
                out[t, c] = out.get((t, c), 0) + p
            for w in near(c) & words - {t, c}:
                if rate(c, w):
                    out[t, w] = out.get((t, w), 0) + p * rate(c, w)
    return out


def test_candidates_match_brute_force(spark):
    terms, words = random_words(3, 60, 10), random_words(4, 150, 10)
    rows, channel = dense_channel(spark)
    got = S.candidates(frame(spark, terms, "term"), frame(spark, words, "word"), channel).collect()
    want = brute_scores(terms, set(words), {(k, x): p for k, x, p in rows})
    found = {(r.term, r.word): r.score for r in got}
    assert set(found) == set(want)
    for k, v in want.items():
        assert found[k] == pytest.approx(v)


def test_candidates_of_letters_that_no_correction_adds(spark):
    """One-character words outside a-z reach each other by no two corrections; the plan stays in the JVM."""
    words = [chr(0x4E00 + i) for i in range(400)]
    kinds = ["deletion", "insertion", "substitution"]
    rows = [(k, a + b, 0.5) for k in kinds for a in ["#", *words[:20]] for b in words[:20] if k != "substitution" or a != "#"]
    channel = spark.createDataFrame(rows, "error_type string, key string, p double")
    found = S.candidates(frame(spark, words, "term"), frame(spark, words, "word"), channel)
    assert found.count() == 0
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()


CORPUS = "the cat sat on the mat. the cat ate the rat. the rat sat on the cat. a cat sat on a mat."


@pytest.fixture(scope="module")
def checker(spark):
    docs = spark.createDataFrame([(0, CORPUS)], "doc_id int, text string")
    pairs = spark.createDataFrame(PAIRS + [("sst", "sat"), ("matt", "mat")], "error string, correct string")
    return P.with_learned_channel(P.from_text(docs, keep=True), pairs)


def test_spell_check(spark, checker):
    texts = spark.createDataFrame(
        [(1, "the cot sat on the mat. the rat sat on the cat"), (2, "The ct sat on the mat.")],
        "doc_id int, text string",
    )
    got = {r.doc_id: r.corrected for r in P.spell_check(checker, texts, 0.6).collect()}
    assert got[1] == "the cat sat on the mat .\nthe rat sat on the cat."
    assert got[2] == "the cat sat on the mat ."
    sure = P.spell_check(checker, texts, 1 - 1e-12).collect()
    assert {r.doc_id: r.corrected for r in sure}[1].split("\n")[1] == "the rat sat on the cat."


def test_word_sentence_score_is_exact(spark, checker):
    """The window deltas give the same best sentence as scoring whole sentences."""
    text = "the cot sat on the mat."
    cands = {
        r.word: r.score
        for r in S.candidates(frame(spark, ["cot"], "term"), checker.vocabulary, checker.channel).collect()
    }
    z = sum(cands.values())
    whole = spark.createDataFrame(
        [(w, text[:-1].replace("cot", w)) for w in cands], "doc_id string, text string"
    )
    lls = {r.doc_id: r.loglik for r in P.evaluate(checker, whole).collect()}
    alpha = 0.6
    best = max(cands, key=lambda w: (2 * math.log(1 - alpha) + math.log(cands[w] / z) + lls[w], w))
    texts = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert P.correct_sentences(checker, texts, alpha).first().word == best


def test_given_error_tables(spark, checker):
    table = spark.createDataFrame([("insertion", "#x", 4), ("deletion", "ca", 6)], "error_type string, key string, n long")
    got = {r.key: r.p for r in P.with_error_tables(checker, table).channel.collect()}
    letters = {r.chars: r.n for r in checker.letters.collect()}
    assert got["ca"] == pytest.approx(6 / letters["ca"]) and got["#x"] == pytest.approx(4 / len(letters))
    lm_only = P.from_language_model(checker.lm)
    assert lm_only.vocabulary.count() > 5


def spot_rows(spark, rng, n):
    words = "the cat sat on mat rat ate a . cot ct , ! hat".split()
    rows = []
    for _ in range(n):
        at = rng.randint(1, 3)
        near = [rng.choice(words) for _ in range(at - 1 + rng.randint(1, 3))]
        rows.append((f"{at}|" + " ".join(near), near, at, near[at - 1]))
    return spark.createDataFrame(list({r[0]: r for r in rows}.values()), "spot string, near array<string>, at int, term string")


@pytest.mark.parametrize("wide", [256, 1, 0])
def test_model_first_equals_full_scoring(spark, checker, wide):
    """The ranking join finds what scoring every choice at every spot finds, from fewer rows."""
    spots = spot_rows(spark, random.Random(5), 150)
    terms = spots.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    # every word is a choice of every term, with shares that seldom decide
    rows = [(t.term, w.word, 1 + (hash_of(t.term + w.word) % 7) / 10) for t in terms.collect() for w in checker.vocabulary.collect() if t.term != w.word]
    scored = spark.createDataFrame(rows, "term string, word string, score double")
    choices = P._choices(scored, terms, 0.6).cache()
    full, all_rows = P.best_words(checker.lm, spots, choices, first=10**6)
    some, few_rows = P.best_words(checker.lm, spots, choices, first=1, wide=wide)
    want = {r.spot: (round(r._old, 9), r._best) for r in full.collect()}
    assert {r.spot: (round(r._old, 9), r._best) for r in some.collect()} == want
    per_spot = [round(n / len(want), 1) for n in (few_rows, all_rows)]
    print(f"rows scored per word, wide={wide}: {per_spot[0]} instead of {per_spot[1]}")
    assert few_rows < all_rows if wide else few_rows <= all_rows


def hash_of(text):
    return sum(ord(c) * (i + 3) for i, c in enumerate(text))


def test_strings_that_no_term_asks_for_are_dropped_before_the_join(spark):
    from pyspark.sql import functions as F

    from quillspark.operators import spelling as S

    rows = spark.range(20000).select(F.xxhash64("id").alias("k"), "id")
    others = rows.where("id % 100 = 0").select(F.col("k").alias("o"))
    got = [r.id for r in S.known_to(rows, "k", others, "o").collect()]
    assert set(range(0, 20000, 100)) <= set(got) and len(got) == len(set(got)) < 230
    assert S.known_to(rows, "k", others.limit(0), "o").count() == 0
    channel = spark.createDataFrame([("substitution", "ab", 0.5)], "error_type string, key string, p double")
    terms = spark.createDataFrame([("xax",)], "term string")
    plan = S.candidates(terms, spark.createDataFrame([("xbx",)], "word string"), channel)._jdf.queryExecution().toString()
    assert "bit_or" in plan
