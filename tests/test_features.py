import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import features as X
from quillspark.operators import labels as B
from quillspark.operators import tfidf as D
from quillspark.functions import text as T

COLUMNS = ["i_hash", "i_url", "i_tag", "i_capital", "i_punc", "i_terms", "puncs", "i_h_c", "i_b_o"]
ROWS = [
    (
        '"Crooked Hillary (2016) lost! #MAGA @BarackObama https://t.co/x',
        '" crooked hillary ( 2016 ) lost ! #maga @barackobama', [1, 1, 1, 2, 9, 1, 9.0, 2, 1],
    ),
    (
        "Thank you, Ohio!  WIN 10/10", "thank you , ohio !  win 10 / 10",
        [0, 0, 0, 5, 7, 3, 2.333333, 0, 0],
    ),
    (".", ". ", [0, 0, 0, 0, 1, 1, 1.0, 0, 0]),
    ("", "", [0, 0, 0, 0, 0, 1, 0.0, 0, 0]),
]


def test_content_features(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ROWS)], "id int, text string")
    got = {r.id: r for r in X.content_features(df, stopwords=["you"]).collect()}
    for i, (_, group, values) in enumerate(ROWS):
        assert got[i].features_group == group
        assert [round(got[i][c], 6) for c in COLUMNS] == values
    assert got[1].i_stopword == 1
    null = X.content_features(spark.createDataFrame([(None,)], "text string")).first()
    assert null.features_group is None and null.i_hash is None and null.i_terms is None


def test_corpus_counters(spark):
    df = spark.createDataFrame([("#A @B http://C Dd E",), ("#x y",)], "text string")
    assert tuple(X.corpus_counters(df).first()) == (2, 1, 1, 2)


def test_time(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 13:05:00' AS ts")
    r = X.timestamp_parts(X.time_features(df)).first()
    assert (r.i_hours, r.i_days, r.year, r.month, r.weekday) == (13, 0, 2024, 1, 0)


def test_minmax_constant_and_unclipped(spark):
    train = spark.createDataFrame([(1, 5), (3, 5)], "a int, b int")
    test = spark.createDataFrame([(5, 7)], "a int, b int")
    fitted = X.fit_minmax(train, ["a", "b"])
    assert [tuple(r) for r in X.apply_minmax(train, fitted, ["a", "b"]).orderBy("a").collect()] == [(0, 0), (1, 0)]
    assert tuple(X.apply_minmax(test, fitted, ["a", "b"]).first()) == (2.0, 2.0)


def test_tfidf(spark):
    docs = [(0, "the cat sat"), (1, "the cat ran ran"), (2, "a dog")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    weights, fitted = D.fit_transform(df, stopwords=["the"], bigrams=True)
    got = {(r.doc_id, r.term): r.weight for r in weights.collect()}
    assert (1, "cat ran") in got and (1, "the cat") not in got and (2, "dog") in got
    idf = {r.term: r.idf for r in fitted.collect()}
    assert idf["cat"] == pytest.approx(math.log(4 / 3) + 1)
    for doc in range(3):
        assert sum(v * v for (d, _), v in got.items() if d == doc) == pytest.approx(1)
    assert got[1, "ran"] / got[1, "cat"] == pytest.approx(2 * idf["ran"] / idf["cat"])
    small = D.fit(df, D.term_frequencies(df, "doc_id", "text"), "doc_id", 1, 2)
    assert {r.term for r in small.collect()} == {"cat", "ran"}
    unseen = spark.createDataFrame([(9, "cat unknown")], "doc_id int, text string")
    out = D.transform(D.term_frequencies(unseen, "doc_id", "text"), fitted, "doc_id").collect()
    assert [(r.term, r.weight) for r in out] == [("cat", 1.0)]


def test_terms_are_counted_in_their_row(spark):
    """Texts of one key count together, and only texts and one row per distinct term and task are shuffled."""
    rows = [(0, "bb aa bb"), (0, "aa cc"), (1, None), (2, ""), (None, "aa aa"), (3, "bb")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    tf = D.term_frequencies(df, "doc_id", "text")
    got = {(r.doc_id, r.term): r.tf for r in tf.collect()}
    assert got == {(0, "aa"): 2, (0, "bb"): 2, (0, "cc"): 1, (None, "aa"): 2, (3, "bb"): 1} and tf.count() == 5
    plan = tf._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(doc_id") == plan.count("Exchange") == 1 and ", term#" not in plan.split("Exchange")[1][:60]
    weights, _ = D.fit_transform(df, bigrams=True, max_features=3)
    assert "SortMergeJoin" not in weights._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.term): round(r.weight, 6) for r in weights.collect()}[3, "bb"] == 1.0


def test_whole_vocabulary_is_joined_without_sorting_terms(spark, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a vocabulary that is not small
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    df = spark.createDataFrame([(0, "aa bb bb"), (1, "bb cc")], "doc_id int, text string")
    weights, _ = D.fit_transform(df)
    assert {(r.doc_id, r.term): round(r.weight, 3) for r in weights.collect()}[0, "bb"] == 0.818
    plan = weights._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan


def test_vocabulary_cap_paths_agree(spark, monkeypatch):
    df = spark.createDataFrame([(0, "aa bb bb cc cc cc dd")], "doc_id int, text string")
    tf = D.term_frequencies(df, "doc_id", "text")
    small = {r.term for r in D.fit(df, tf, "doc_id", 1, 3).collect()}
    monkeypatch.setattr(D, "SORT_LIMIT", 0)
    assert {r.term for r in D.fit(df, tf, "doc_id", 1, 3).collect()} == small == {"cc", "bb", "aa"}


def test_sequences(spark):
    docs = spark.createDataFrame([(0, "b a b"), (1, "c")], "doc_id int, text string")
    voc = X.vocabulary_index(docs, "doc_id", T.words(F.col("text")))
    assert {r.term: r.idx for r in voc.collect()} == {"b": 2, "a": 3, "c": 4}
    texts = spark.createDataFrame([(0, "a z b c"), (1, "")], "doc_id int, text string")
    got = {r.doc_id: r.encoded for r in X.encode_sequences(texts, "doc_id", T.words(F.col("text")), voc, 3).collect()}
    assert got[0].ids == [3, 1, 2] and got[0].length == 3
    assert got[1].ids == [0, 0, 0] and got[1].length == 0


def test_synonyms(spark):
    texts = spark.createDataFrame([(i, "big dog") for i in range(50)], "doc_id int, text string")
    synonyms = spark.createDataFrame([("big", "large"), ("big", "huge")], "term string, synonym string")
    rows = X.augment_synonyms(texts, "doc_id", synonyms, 0.5, 3).collect()
    assert {r.augmented.split(" ")[0] for r in rows} == {"big", "large", "huge"}
    assert all(r.augmented.endswith(" dog") for r in rows) and 10 < sum(r.replaced for r in rows) < 40
    again = X.augment_synonyms(texts, "doc_id", synonyms, 0.5, 3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_labels(spark):
    df = spark.createDataFrame(
        [(1, "z", "android"), (2, "a", None), (3, "z", "web"), (4, None, "web"), (5, "m", "web")],
        "pos int, who string, device string",
    )
    coded = B.encode_labels(df, "who", ["pos"])
    assert {r.pos: r.code for r in coded.collect()} == {1: 0, 2: 1, 3: 0, 4: None, 5: 2}
    hot = B.encode_target(coded, "code").orderBy("pos").collect()
    assert [r.code for r in hot] == [0, 1, 0, None, 1]
    assert [r.code_2 for r in hot] == [0, 0, 0, 0, 1]
    assert [r.target for r in B.binary_target(df).orderBy("pos").collect()] == [0, 1, 1, 1, 1]
    assert B.drop_nulls(df, ["who"]).count() == 4
    assert [r.pos for r in B.class_head(B.binary_target(df), "target", 1, "pos", 2).collect()] == [2, 3]
    x, y = B.split_xy(df, "who")
    assert x.columns == ["pos", "device"] and y.columns == ["who"]
    assert B.one_hot(df, ["device"]).columns[-2:] == ["device_android", "device_web"]
