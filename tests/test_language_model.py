import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import ngrams as N
from quillspark.plans import language_model as L

SAMPLE = (
    "A cat sat on the mat. A fat cat sat on the mat. A rat sat on the mat. The rat sat on the cat. "
    "A bat spat on the rat that sat on the cat on the mat."
).lower()


@pytest.fixture(scope="module")
def lm(spark):
    return L.fit(spark.createDataFrame([(0, SAMPLE)], "doc_id int, text string"), 3, keep=True)


def test_counts(spark, lm):
    grams = {r.gram: r.n for r in lm.model().collect()}
    assert sum(grams.values()) == 37 and len(grams) == 27
    assert grams["sat on the"] == 5 and grams["on the mat."] == 4 and grams["the mat. a"] == 2
    docs = spark.createDataFrame([(SAMPLE,)], "text string")
    chars = {r.gram: r.n for r in N.char_ngram_counts(docs, 3).collect()}
    assert sum(chars.values()) == 145 and len(chars) == 40
    assert chars["at "] == 15 and chars[" th"] == 9 and chars["he "] == 8
    assert N.corpus_size(docs).first().tokens == 39
    assert lm.window_size() == 3 and L.fit(docs, 0).order == 3
    words = {r.word: r.n for r in N.words_of_grams(lm.grams).collect()}
    assert words["sat"] == 5


def test_short_texts_have_no_grams(spark):
    docs = spark.createDataFrame([("a b",), ("",), (None,)], "text string")
    assert N.word_ngram_counts(docs, 3).count() == 0
    assert N.char_ngram_counts(docs, 4).count() == 0


@pytest.mark.parametrize(
    "text, token, string",
    [
        ("a cat sat on the mat.", -0.559615788, -0.559615788),
        ("the rat sat on the mat.", -1.252762968, -1.252762968),
        ("a cat spat on the rat", -8.573951525, -8.573951525),
        ("cat", 0.0, 0.0),
        ("the c on", -3.295836866, -0.693147181),
    ],
)
def test_log_likelihood(spark, lm, text, token, string):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert L.evaluate(lm, df).first().loglik == pytest.approx(token, abs=1e-8)
    assert L.evaluate(lm, df, match="string").first().loglik == pytest.approx(string, abs=1e-8)


def test_parity_smoothing_clips_the_context(spark, lm):
    df = spark.createDataFrame([(1, "a cat spat")], "doc_id int, text string")
    # grams starting with "a ca": one of 27
    got = L.evaluate(lm, df, match="string", parity=True).first().loglik
    assert got == pytest.approx(math.log(1 / 28), abs=1e-9)


def test_punctuation_words_leave_the_context(spark, lm):
    df = spark.createDataFrame([(1, "sat - on"), (2, "- - cat")], "doc_id int, text string")
    got = {r.doc_id: r.loglik for r in L.evaluate(lm, df).collect()}
    # "sat" starts 5 grams, all "sat on the": "on" is never last
    assert got[1] == pytest.approx(math.log(1 / (5 + 27)))
    last_cat = sum(r.n for r in lm.grams.collect() if r.last == "cat")
    assert got[2] == pytest.approx(math.log(last_cat / 37))


def test_prefix_frequency(spark, lm):
    subs = spark.createDataFrame([("sat",), ("sat on the",), ("the c",), ("zz top",)], "sub string")
    got = {r.sub: r.tf for r in L.prefix_frequency(lm, subs).collect()}
    assert got["sat"] == 5 and got["sat on the"] == 5 and got["zz top"] == pytest.approx(1 / 27)
    string = {r.sub: r.tf for r in L.prefix_frequency(lm, subs, match="string").collect()}
    assert string["the c"] == 2


def test_smooth(spark, lm):
    pairs = spark.createDataFrame([("on the", "mat."), ("on the", "zz"), ("q q", "a")], "ctx string, next string")
    got = {(r.ctx, r.next): r.p for r in L.smooth(lm, pairs).collect()}
    assert got["on the", "mat."] == pytest.approx(5 / (7 + 27))
    assert got["on the", "zz"] == pytest.approx(1 / (7 + 27)) and got["q q", "a"] == pytest.approx(1 / 27)


def test_guide_covers_every_weight_once(spark, lm):
    s = L.sampler(lm)
    totals = {r.ctx: r.total for r in s.contexts.collect()}
    guide = s.guide.collect()
    seen = {(r.ctx, r.gram): (r.lo, r.hi) for r in guide}
    bins = {r.ctx: r.bins for r in s.contexts.collect()}
    for ctx, total in totals.items():
        spans = sorted(v for (c, _), v in seen.items() if c == ctx)
        assert spans[0][0] == 0 and spans[-1][1] == total
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        for draw in range(total):
            hits = [r for r in guide if r.ctx == ctx and r.bin == draw * bins[ctx] // total and r.lo <= draw < r.hi]
            assert len(hits) == 1


def test_generate(spark, lm):
    seeds = spark.createDataFrame(
        [(1, "a cat"), (2, None), (3, "a fat cat sat on the mat. a rat sat on the mat."), (4, "zz yy"), (5, "on the")],
        "seed_id int, context string",
    )
    got = {r.seed_id: r.generated for r in L.generate(lm, seeds, 8, 11).collect()}
    again = {r.seed_id: r.generated for r in L.generate(lm, seeds, 8, 11).collect()}
    assert got == again
    assert all(len(t.split(" ")) == 8 for t in got.values())
    assert got[1].startswith("a cat sat on the") and got[3] == "a fat cat sat on the mat. a"
    grams = {r.gram for r in lm.grams.collect()}
    for key in (1, 2):
        w = got[key].split(" ")
        # the sample's last words may have no successor; a fresh gram is drawn then
        assert " ".join(w[:3]) in grams


def test_characters(spark):
    docs = spark.createDataFrame([(0, "abcabd")], "doc_id int, text string")
    lm = L.fit(docs, 3, chars=True)
    p = L.evaluate(lm, spark.createDataFrame([(1, "abc")], "doc_id int, text string")).first().loglik
    assert p == pytest.approx(math.log(0.5))
    seeds = spark.createDataFrame([(1, "ca")], "seed_id int, context string")
    assert L.generate(lm, seeds, 4, 1).first().generated in ("cabc", "cabd")


def test_mle_sums_to_one(spark):
    docs = spark.createDataFrame([("a b a.",), ("b a",)], "text string")
    rows = L.mle(docs, 3).collect()
    sums = {}
    for r in rows:
        sums[r.k, r.ctx] = sums.get((r.k, r.ctx), 0) + r.p
    assert {round(v, 9) for v in sums.values()} == {1.0}
    p = {(r.ctx, r.word): r.p for r in rows}
    assert p["<s> <s>", "a"] == 0.5 and p["b", "a"] == 1.0


def test_padded_and_continuations(spark):
    docs = spark.createDataFrame([("The cat. of of",)], "text string")
    got = {tuple(r.units): r.n for r in N.padded_ngram_counts(docs, 2, ["the", "of"]).collect()}
    assert got == {(None, "the"): 1, ("the", "cat"): 1, ("cat", "of"): 1, ("of", None): 1}
    more = spark.createDataFrame([("a b c",), ("a b c",), ("a b d",)], "text string")
    top = N.top_successors(N.trigram_continuations(more), 1).collect()
    assert [(r.w1, r.w2, r.w3, r.n) for r in top] == [("a", "b", "c", 2)]
    terms = N.clean_term_counts(docs)
    assert tuple(N.term_repetition(terms).first()) == (2, 1)
    letters = {r.chars: r.n for r in N.letter_counts(N.word_counts(more), word_starts=True).collect()}
    assert letters["#"] == 9 and letters["#a"] == 3 and letters["c"] == 2


def test_drawn_successors_follow_the_counts(spark):
    rows = [(str(i), "b", w, n) for i in range(3000) for w, n in (("x", 6), ("y", 3), ("z", 1))]
    table = spark.createDataFrame(rows, "w1 string, w2 string, w3 string, n long")
    drawn = N.drawn_successors(table, 3, 6)
    got = [w for r in drawn.collect() for w in r.drawn]
    share = {w: got.count(w) / len(got) for w in "xyz"}
    assert len(got) == 18000 and abs(share["x"] - 0.6) < 0.02 and abs(share["y"] - 0.3) < 0.02
    again = {r.w1: r.drawn for r in N.drawn_successors(table.repartition(7), 3, 6).collect()}
    assert again == {r.w1: r.drawn for r in drawn.collect()}
    assert len({tuple(d) for d in again.values()}) > 100  # the steps are drawn apart


def test_continued_walks_and_their_ends(spark):
    table = spark.createDataFrame(
        [("a", "b", "c", 2), ("b", "c", "d", 1), ("x", "y", "x", 1), ("y", "x", "y", 5)],
        "w1 string, w2 string, w3 string, n long",
    )
    pairs = spark.createDataFrame(
        [("a", "b"), ("a", "b"), ("c", "d"), ("x", "y"), ("", ""), (None, "b"), ("a", None)], "w1 string, w2 string"
    )
    got = {(r.w1, r.w2): r.words for r in N.continued(pairs, table, 1, 5).collect()}
    assert got == {("a", "b"): ["c", "d"], ("c", "d"): [], ("x", "y"): ["x", "y"] * 2 + ["x"], ("", ""): []}
    empty = {(r.w1, r.w2): r.words for r in N.continued(pairs, table.limit(0), 1, 2).collect()}
    assert set(empty) == set(got) and not any(empty.values())


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_grams_are_counted_by_one_string(spark):
    docs = spark.createDataFrame([("a b c d",), ("a  b c.",), ("x y",), ("",), (None,)], "text string")
    for df in (L.fit(docs, 3).grams, N.trigram_continuations(docs), N.word_ngram_counts(docs, 3)):
        plan = plan_of(df)
        assert "lambdafunction" not in plan and "hashpartitioning(gram" in plan
    assert {tuple(r) for r in L.fit(docs, 3).grams.collect()} == {
        ("a b c", "a b", "c", 1), ("b c d", "b c", "d", 1), ("a b c.", "a b", "c.", 1)
    }
    assert {tuple(r) for r in L.fit(docs, 1).grams.where("last = 'b'").collect()} == {("b", "", "b", 2)}
    pairs = {tuple(r) for r in N.trigram_continuations(docs).collect()}
    assert pairs == {("a", "b", "c", 2), ("b", "c", "d", 1)}


def test_kept_counts_are_a_compressed_table(spark):
    docs = spark.createDataFrame([("a b c d",)], "text string")
    plan = plan_of(L.fit(docs, 3, keep=True).grams)
    assert "FileScan parquet" in plan and "ExistingRDD" not in plan


def test_draws_order_only_what_is_asked_for(spark, lm):
    asked = spark.createDataFrame([("on the",), ("zz yy",), (None,)], "ctx string")
    s = L.sampler(lm, asked)
    assert [(r.ctx, r.total) for r in s.contexts.collect()] == [("on the", 7)]
    assert {r.gram for r in s.guide.collect()} == {r.gram for r in lm.grams.where("ctx = 'on the'").collect()}
    # a new or null context draws the gram at that place in the order of the md5
    from hashlib import md5

    order = sorted((md5(r.gram.encode()).hexdigest(), r.gram, r.last) for r in lm.grams.collect())
    seeds = spark.createDataFrame([(i, None if i % 2 else "zz yy") for i in range(50)], "k long, ctx string")
    for r in L.draw_next(lm, seeds, "k", 7, 1).collect():
        at = int(md5(f"7|{r.k}|1".encode()).hexdigest()[:8], 16) % len(order)
        assert (r.gram, r.last) == order[at][1:]


def test_many_grams_of_a_context_are_summed_in_buckets(spark, lm, monkeypatch):
    expected = {tuple(r) for r in L.sampler(lm).guide.collect()}
    monkeypatch.setattr(L, "HOT_GRAMS", 1)
    assert {tuple(r) for r in L.sampler(lm).guide.collect()} == expected


def test_prefixes_of_the_asked_sizes_only(spark, lm):
    wanted = spark.createDataFrame([("on the",), ("the c",)], "prefix string")
    assert L._prefixes(lm, wanted).count() == lm.counted[0]
    subs = spark.createDataFrame([("",), ("sat",), ("zz",), ("a  b",)], "sub string")
    got = {r.sub: r.tf for r in L.prefix_frequency(lm, subs).collect()}
    assert got[""] == 37 and got["sat"] == 5 and got["zz"] == pytest.approx(1 / (37 + 27))


def test_a_step_draws_for_the_pairs_reached(spark, monkeypatch):
    table = spark.createDataFrame(
        [("a", "b", "c", 1), ("b", "c", "d", 1), ("x", "y", "z", 1), ("x", "y", "q", 9)], "w1 string, w2 string, w3 string, n long"
    )
    asked = []
    drawn = N._drawn

    def counted(rows, seed, steps):
        asked.append(rows.count())
        return drawn(rows, seed, steps)

    monkeypatch.setattr(N, "_drawn", counted)
    pairs = spark.createDataFrame([("a", "b")], "w1 string, w2 string")
    assert N.continued(pairs, table, 1, 4).first().words == ["c", "d"]
    assert asked == [1, 1, 0, 0]
    monkeypatch.undo()
    steps = N.drawn_successors(table, 5, 3).where("w1 = 'x'").first().drawn
    assert [N._drawn(table, 5, [s]).where("w1 = 'x'").first().drawn[0] for s in range(3)] == steps


def test_steps_share_what_they_need_of_the_model(spark, monkeypatch):
    """The buckets of md5 are summed once for all steps, and a step's copy of the model's rows goes with it."""
    from quillspark.plans import language_model as L

    docs = spark.createDataFrame([(i, f"a b c{i % 3} d e f g{i % 5} h") for i in range(30)], "doc_id int, text string")
    lm = L.fit(docs, 3, keep=True)
    seeds = spark.createDataFrame([(1, "a b c1"), (2, "no such words"), (3, "x")], "seed_id int, context string")
    sums, gone, real, drop = [], [], L._slots, L.dropped
    monkeypatch.setattr(L, "_slots", lambda *a: sums.append(1) or real(*a))
    monkeypatch.setattr(L, "dropped", lambda t: gone.append(1) or drop(t))
    got = {r.seed_id: r.generated.split(" ") for r in L.generate(lm, seeds, 4, 5).collect()}
    assert {k: len(v) for k, v in got.items()} == {1: 4, 2: 4, 3: 4}
    assert len(sums) == 1 and len(gone) == 4
    # the draws are those of single steps
    step = L.draw_next(lm, spark.createDataFrame([(1, "b c1"), (2, "such words"), (3, "x")], "seed_id int, ctx string"), "seed_id", 5, 1)
    assert all(got[r.seed_id][3 if r.seed_id < 3 else 1] == r["last"] for r in step.collect())


def test_uniform_draws_move_a_bucket_once(spark, monkeypatch):
    from quillspark.plans import language_model as L

    docs = spark.createDataFrame([(i, f"a b c{i} d e{i} f") for i in range(40)], "doc_id int, text string")
    lm = L.fit(docs, 3, keep=True)
    rows = spark.range(60).select("id", F.lit("no such").alias("ctx"))
    draw = lambda: L._draw_any(lm, rows, F.lit(1), lm.counted[0], "id", 3, 1)
    few = draw()
    assert "rightHint=(strategy=broadcast)" in few._jdf.queryExecution().optimizedPlan().toString().splitlines()[1]
    monkeypatch.setattr(L, "ASKED_ROWS", 10)  # many draws meet only the bins they fall into
    got = {r.id: r.gram for r in few.collect()}
    assert len(got) == 60 and {r.id: r.gram for r in draw().collect()} == got
    order = [r.gram for r in lm.grams.orderBy(F.md5("gram"), "gram").collect()]
    at = rows.select("id", L.draws.draw_below(F.lit(lm.counted[0]), 3, F.col("id"), F.lit(1)).alias("d")).collect()
    assert got == {r.id: order[r.d] for r in at}


def test_prefixes_are_dropped_before_they_are_counted(spark):
    from quillspark.plans import language_model as L

    lm = L.fit(spark.createDataFrame([(1, "a b c d a b e")], "doc_id int, text string"), 3, keep=True)
    wanted = spark.createDataFrame([("a b",), ("x y",)], "prefix string")
    totals = L._prefix_totals(lm, wanted, "token")
    assert [tuple(r) for r in totals.collect()] == [("a b", 2)]
    assert "Join LeftSemi" in totals._jdf.queryExecution().optimizedPlan().toString()


def test_continuation_drops_what_a_step_has_written(spark, monkeypatch):
    counts = spark.createDataFrame([("a", "b", "c", 2), ("b", "c", "d", 1)], "w1 string, w2 string, w3 string, n long")
    gone, drop = [], N.dropped
    monkeypatch.setattr(N, "dropped", lambda t: gone.append(1) or drop(t))
    pairs = spark.createDataFrame([("a", "b"), ("x", "y")], "w1 string, w2 string")
    got = {(r.w1, r.w2): r.words for r in N.continued(pairs, counts, 1, 3).collect()}
    assert got == {("a", "b"): ["c", "d"], ("x", "y"): []} and len(gone) == 4
