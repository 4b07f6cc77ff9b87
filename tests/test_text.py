from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.stems import stem_counts, with_stem


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_norm_text(spark):
    assert one(spark, ".", T.norm_text) == " ."
    assert one(spark, "Hi,  you (2)\nA&B", T.norm_text) == "hi , you ( 2 ) a & b"
    assert one(spark, "a b", T.norm_text) == "a b"


def test_filter_text(spark):
    anchor = '<a href="https://periscope.tv" rel="nofollow">Periscope.TV</a>'
    assert one(spark, anchor + " Go 100%!", T.filter_text) == "tv go"
    assert one(spark, "see https://t.co/x a=b", T.filter_text) == "see t co x a = b"
    assert one(spark, "http stays", T.filter_text) == "http stays"


def test_normalize_keeps_single_white_space_and_punctuation(spark):
    assert one(spark, "A\tb  C.\n\nD", T.normalize_text) == "a\tb c. d"


def test_punctuation_words(spark):
    assert one(spark, "x [y] \\ z|?", T.clean_format) == "xyz|"
    assert one(spark, "a - b-c | ?", T.clean_tokens) == ["a", "bc", "|"]


def test_tokens(spark):
    assert one(spark, "a  b ", T.split_space) == ["a", "", "b", ""]
    assert one(spark, " a \n b ", T.split_white) == ["a", "b"]
    assert one(spark, "a\tb  c", T.split_each_white) == ["a", "b", "", "c"]
    assert one(spark, "l'été_2, oui", T.words) == ["l", "été_2", "oui"]
    assert one(spark, "no, a b!", T.words_and_marks) == ["no", ",", "a", "b", "!"]


def test_sentences(spark):
    text = "Dr. Smith met J.F.K. in the U.S. He paid 3.5 dollars... see foo.com now! She said \"hi.\" ok"
    assert one(spark, text, T.sentences) == [
        "Dr. Smith met J.F.K. in the U.S.",
        "He paid 3.5 dollars... see foo.com now!",
        'She said "hi".',
        "ok.",
    ]
    assert one(spark, "we saw Acme Inc. They left", T.sentences) == ["we saw Acme Inc.", "They left."]
    assert one(spark, "e.g. this. i.e. that.", T.sentences) == ["e.g. this.", "i.e. that."]
    assert one(spark, "I work for Acme Inc.", T.sentences) == ["I work for Acme Inc."]
    assert one(spark, "Yes. ?", T.sentences) == ["Yes.", "?", "."]
    assert one(spark, "Yes. ? No", lambda c: T.join_sentences(T.sentences(c))) == "Yes.\nNo."


def test_stems(spark):
    expected = dict(
        consolation="consol", knackeries="knackeri", generously="generous", generate="generat",
        running="run", hopping="hop", hoping="hope", cries="cri", ties="tie", say="say",
        national="nation", agreed="agre", skies="sky", proceed="proceed", gas="gas", gaps="gap",
        sensibility="sensibl", geology="geolog", adoption="adopt", controlling="control",
        bees="bee", relativity="relat", communism="communism", vietnamization="vietnam",
    )
    df = spark.createDataFrame([(w, 2) for w in expected], "word string, n long")
    assert {r.word: r.stem for r in with_stem(df).collect()} == expected
    counts = spark.createDataFrame([("hope", 1), ("hoping", 2), ("run", 4)], "word string, n long")
    assert {r.stem: r.n for r in stem_counts(counts).collect()} == {"hope": 3, "run": 4}


def test_tokens_without_a_mark_are_spared_the_patterns(spark):
    df = spark.createDataFrame([('He said "no." Then (yes!) he left) at 3.5 e.g. now',)], "text string")
    out = df.select(T.sentences(F.col("text")).alias("s"))
    assert out.first().s == ['He said "no".', "Then (yes!)", "he left) at 3.5 e.g. now."]
    assert "contains" in out._jdf.queryExecution().toString().lower()
