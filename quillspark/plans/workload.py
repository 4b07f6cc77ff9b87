"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import draws
from quillspark.functions import edits as E
from quillspark.functions import text as T
from quillspark.functions.let import let
from quillspark.functions.rows import each, each_at, each_struct
from quillspark.functions.stems import stem_counts
from quillspark.operators import features as X
from quillspark.operators import labels as B
from quillspark.operators import metrics as M
from quillspark.operators import ngrams as N
from quillspark.operators import spelling as S
from quillspark.operators import splits as H
from quillspark.operators import tfidf as D
from quillspark.operators.scale import parts_by_rows, spread_scan, spread_texts, spread_work
from quillspark.plans import classification as C
from quillspark.plans import language_model as L
from quillspark.plans import spell_checker as P
from quillspark.session import cut_lineage
from quillspark.sources import constants as K

# Parameters of the queries.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "by", "de", "der", "des", "die", "du", "el", "en", "et",
    "for", "in", "is", "it", "la", "le", "les", "of", "on", "or", "that", "the", "to", "und", "was",
    "were", "with",
]
MENTIONS = {"i_h_c": (["tion", "ent"], "@user"), "i_b_o": (["er"], "@assistant")}
COUNTS = ["i_hash", "i_url", "i_tag", "i_capital", "i_punc", "i_terms", "i_stopword", "i_h_c", "i_b_o"]
SEED = 7
ALPHA = 0.95
WIDTH = 70


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread_scan(table(spark, sf, "documents"), "doc_id")


def gram_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents in parts whose grams fit a task."""
    return spread_texts(table(spark, sf, "documents"), "doc_id")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    c = spread_scan(table(spark, sf, "conversations"), "conv_id")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"), "role", "text")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns dressed as posts: mention, hash tag, link, time and device."""
    c = spread_scan(table(spark, sf, "conversations"), "conv_id")
    pages = table(spark, sf, "pages").select("page_id", "url")
    events = table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("device"))
    n_pages = pages.agg(F.count(F.lit(1)).alias("n")).scalar()
    c = c.withColumn("page_id", F.pmod("conv_id", n_pages))
    text = F.concat(
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("@"), "role", F.lit(" "))).otherwise(""),
        F.when(F.col("turn") % 2 == 1, F.concat(F.lit("#Turn"), F.col("turn").cast("string"), F.lit(" "))).otherwise(""),
        F.col("text"),
        F.lit(" "),
        F.coalesce("url", F.lit("")),
    )
    return (
        c.join(pages, "page_id", "left")
        .join(events, F.col("conv_id") == F.col("event_id"), "left")
        .select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"),
            F.col("role").alias("author"),
            text.alias("text"),
            "ts",
            "device",
        )
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return docs.join(table(spark, sf, "labels"), "doc_id")


def corpus(df: DataFrame, text: str = "text") -> DataFrame:
    """Corpus form of a text column: newlines made spaces, normalised."""
    return df.withColumn(text, T.normalize_text(T.newline_free(F.col(text))))


def _post_codes(spark, sf):
    return B.encode_labels(posts(spark, sf).select("post_id", "author"), "author", ["post_id"])


# --- labels, projections, filters


def label_encode(spark, sf):
    return _post_codes(spark, sf)


def one_hot(spark, sf):
    p = posts(spark, sf).select("post_id", "author", "device")
    p = B.encode_labels(p, "device", ["post_id"])
    hot = B.one_hot(p, ["author"], {"author": ["assistant", "user"]})
    return hot.withColumn("code", B.collapse_target(F.col("code"))).drop("author")


def binary_target(spark, sf):
    return B.binary_target(posts(spark, sf).select("post_id", "device"), "device", "click")


def project_posts(spark, sf):
    p = posts(spark, sf)
    x, _ = B.split_xy(p.select("post_id", "author", "device"), "author")
    both = B.stack(x.withColumn("part", F.lit("train")), p.select("post_id", F.lit("test").alias("part")))
    return both


def drop_nulls(spark, sf):
    d = documents(spark, sf).select("doc_id", "lang").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    return B.drop_nulls(d, ["quality"])


def nonempty_filter(spark, sf):
    d = documents(spark, sf).select("doc_id", T.filter_text(F.col("text")).alias("plain"))
    return B.non_empty(d, "plain").select("doc_id", F.length("plain").cast("long").alias("plain_len"))


def class_limit(spark, sf):
    p = B.binary_target(posts(spark, sf).select("post_id", "device"), "device", "click")
    return B.class_head(p, "target", 1, "post_id", 50)


def parse_posts(spark, sf):
    return B.parse_posts(posts(spark, sf), "text", "author", "post_id")


# --- text


def filter_text(spark, sf):
    return documents(spark, sf).select("doc_id", T.filter_text(F.col("text")).alias("plain"))


def norm_text(spark, sf):
    return documents(spark, sf).select("doc_id", T.norm_text(F.col("text")).alias("norm"))


def normalize_text(spark, sf):
    return documents(spark, sf).select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


def clean_terms(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        T.clean_format(F.col("text")).alias("cleaned"),
        F.array_join(T.clean_tokens(F.col("text")), "|").alias("tokens"),
    )


def sentence_split(spark, sf):
    d = documents(spark, sf)
    rows = each_at(d, T.sentences(F.col("text")), "sent", "sentence", "doc_id")
    return rows.withColumn("sent", F.col("sent").cast("long"))


def tokens(spark, sf):
    def line(parts: Column) -> Column:
        return F.array_join(parts, "|")

    t = F.col("text")
    return documents(spark, sf).select(
        "doc_id",
        F.size(T.split_space(t)).cast("long").alias("space_tokens"),
        line(T.split_white(t)).alias("white"),
        line(T.words(t)).alias("words"),
        F.size(T.split_each_white(t)).cast("long").alias("each_white_tokens"),
        line(T.words_and_marks(t)).alias("words_and_marks"),
    )


def ngram_stopfilter(spark, sf):
    counts = N.word_ngram_counts(corpus(gram_texts(spark, sf)), 2)
    units = counts.withColumn("units", F.split("gram", " "))
    return N.keep_contentful(units, "units", STOPWORDS).select("gram", "n")


def words_from_ngrams(spark, sf):
    return N.words_of_grams(N.word_ngram_counts(corpus(gram_texts(spark, sf)), 3))


# --- features


def corpus_counters(spark, sf):
    return X.corpus_counters(posts(spark, sf))


def content_features(spark, sf):
    p = posts(spark, sf).select("post_id", "text", "ts")
    out = X.extract_features(p, "text", "ts", stopwords=STOPWORDS, mentions=MENTIONS)
    return out.select(
        "post_id", "features_group", *[F.col(c).cast("long").alias(c) for c in COUNTS],
        F.round("puncs", 6).alias("puncs"),
        F.col("i_hours").cast("long").alias("i_hours"), F.col("i_days").cast("long").alias("i_days"),
    )


def time_features(spark, sf):
    e = X.timestamp_parts(table(spark, sf, "events").select("event_id", "ts"), "ts")
    return e.select("event_id", *[F.col(c).cast("long").alias(c) for c in ("hour", "weekday", "year", "month")])


def tfidf_uni(spark, sf):
    w, _ = D.fit_transform(documents(spark, sf), stopwords=STOPWORDS, min_df=2)
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def tfidf_bigram_capped(spark, sf):
    w, _ = D.fit_transform(
        documents(spark, sf), stopwords=STOPWORDS, bigrams=True, min_df=2, max_features=5000
    )
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def tfidf_transform(spark, sf):
    docs = documents(spark, sf)
    tf = D.term_frequencies(docs, "doc_id", "text", STOPWORDS)
    fitted = D.fit(docs, tf, "doc_id", min_df=2)
    posts = turns(spark, sf)
    parts = parts_by_rows(posts)
    unseen = D.term_frequencies(posts, "post_id", "text", STOPWORDS, parts=parts)
    return D.transform(unseen, fitted, "post_id", parts=parts).select("post_id", "term", F.round("weight", 6).alias("weight"))


def _numbers(spark, sf):
    p = posts(spark, sf).select("post_id", "device", "text", "ts")
    return X.extract_features(p, "text", "ts", stopwords=STOPWORDS, mentions=MENTIONS)


def minmax_scale(spark, sf):
    rows = _numbers(spark, sf)
    scaled = X.apply_minmax(rows, X.fit_minmax(rows, K.COUNT_FEATURES), K.COUNT_FEATURES)
    return scaled.select("post_id", *[F.round(c, 6).alias(c) for c in K.COUNT_FEATURES])


def feature_table(spark, sf):
    """Long feature table: TF-IDF terms of the content next to the scaled counters."""
    rows = B.binary_target(_numbers(spark, sf), "device", "click")
    weights, _ = D.fit_transform(rows, "post_id", "features_group", STOPWORDS, min_df=2)
    scaled = X.apply_minmax(rows, X.fit_minmax(rows, K.COUNT_FEATURES), K.COUNT_FEATURES)
    pairs = F.array(
        *[F.struct(F.lit(f"#{c}").alias("feature"), F.col(c).alias("value")) for c in K.COUNT_FEATURES]
    )
    numeric = scaled.select("post_id", "target", F.inline(pairs))
    terms = weights.join(rows.select("post_id", "target"), "post_id").select(
        "post_id", "target", F.col("term").alias("feature"), F.col("weight").alias("value")
    )
    return numeric.unionByName(terms).select("post_id", "target", "feature", F.round("value", 6).alias("value"))


def vocab_index(spark, sf):
    return X.vocabulary_index(documents(spark, sf), "doc_id", T.words_and_marks(F.col("text"))).select("term", "idx")


def encode_sequences(spark, sf):
    seen = T.words_and_marks(F.col("text"))
    vocabulary = X.vocabulary_index(documents(spark, sf), "doc_id", seen)
    rows = X.encode_sequences(turns(spark, sf), "post_id", seen, vocabulary, WIDTH)
    rows = B.non_empty_encoded(rows)
    return rows.select(
        "post_id",
        F.array_join(F.transform("encoded.ids", lambda i: i.cast("string")), " ").alias("ids"),
        F.col("encoded.length").cast("long").alias("length"),
    )


def augment_synonyms(spark, sf):
    """Synonyms here are the words of the documents that share their sorted letters."""
    words = N.word_counts(documents(spark, sf).withColumn("text", F.lower("text"))).select("word")
    keyed = words.where(F.length("word") > 3).withColumn(
        "letters", F.array_join(F.array_sort(F.split("word", "")), "")
    )
    # the next word of the same letters in order: at most one synonym per word, no pairs in a group
    ranked = keyed.groupBy("letters").agg(F.min("word").alias("synonym"))
    synonyms = keyed.join(ranked, "letters").where(F.col("word") != F.col("synonym")).select(
        F.col("word").alias("term"), "synonym"
    )
    return X.augment_synonyms(
        turns(spark, sf).withColumn("text", F.lower("text")), "post_id", synonyms, 0.5, SEED
    )


# --- counts and reports


def term_counts(spark, sf):
    return N.term_counts(documents(spark, sf))


def sequence_stats(spark, sf):
    return M.sequence_stats(documents(spark, sf))


def class_balance(spark, sf):
    return M.class_balance(table(spark, sf, "labels"), "quality").select(
        "quality", "n", F.round("ratio", 6).alias("ratio")
    )


def corpus_report(spark, sf):
    return M.corpus_report(B.parse_posts(posts(spark, sf), "text", "author", "post_id"), "author")


def word_ngrams(spark, sf):
    return N.word_ngram_counts(corpus(gram_texts(spark, sf)), 3)


def char_ngrams(spark, sf):
    return N.char_ngram_counts(corpus(documents(spark, sf)), 3)


def clean_term_freq(spark, sf):
    return N.clean_term_counts(corpus(documents(spark, sf)))


def _vocabulary(spark, sf):
    return N.word_counts(corpus(documents(spark, sf)))


def letter_counts(spark, sf):
    return N.letter_counts(_vocabulary(spark, sf), word_starts=True)


def padded_ngrams(spark, sf):
    counts = N.padded_ngram_counts(documents(spark, sf), 2, STOPWORDS)
    return counts.select(
        F.get("units", F.lit(0)).alias("w1"), F.get("units", F.lit(1)).alias("w2"), "n"
    )


def trigram_continuations(spark, sf):
    return N.trigram_continuations(gram_texts(spark, sf), STOPWORDS)


def singleton_terms(spark, sf):
    return N.term_repetition(N.clean_term_counts(corpus(documents(spark, sf))))


def _predictions(spark, sf):
    """Two rules as models: a document is good when it is longer than average, or when its number
    of words is even. Folds are seeded."""
    d = labelled(spark, sf).select(
        "doc_id", F.col("quality").alias("y"), F.length("text").alias("len"),
        F.size(T.words(F.col("text"))).alias("words"),
    )
    d = H.kfold(d, "doc_id", 10, SEED)
    mean = d.agg(F.avg("len").alias("m")).scalar()
    by_len = d.select(F.lit("length").alias("model"), "fold", "y", F.when(F.col("len") > mean, 1).otherwise(0).alias("pred"))
    by_words = d.select(F.lit("parity").alias("model"), "fold", "y", (F.col("words") % 2).alias("pred"))
    return by_len.unionByName(by_words)


def metrics_by_fold(spark, sf):
    return M.metrics_by_fold(_predictions(spark, sf))


def best_model(spark, sf):
    return M.best_model(M.metrics_by_fold(_predictions(spark, sf)))


def pred_totals(spark, sf):
    return M.predicted_totals(_predictions(spark, sf), "first", "second")


# --- language model


def _lm(spark, sf, n=3):
    return L.fit(corpus(gram_texts(spark, sf)), n, keep=True)


def lm_model(spark, sf):
    return L.fit(corpus(gram_texts(spark, sf)), 3).grams


def lm_prefix_tf(spark, sf):
    units = T.split_each_white(F.col("text"))
    subs = each(corpus(turns(spark, sf)), N.word_grams(units, 2), "sub")
    out = L.prefix_frequency(_lm(spark, sf), subs)
    return out.select("sub", F.round("tf", 9).alias("tf"))


def lm_loglik(spark, sf):
    out = L.evaluate(_lm(spark, sf), corpus(turns(spark, sf)), "post_id")
    return out.select("post_id", F.round("loglik", 5).alias("loglik"), "windows")


def lm_smooth(spark, sf):
    units = T.split_each_white(F.col("text"))
    pairs = each_struct(corpus(turns(spark, sf)), N.context_grams(units, 3), "last")
    pairs = pairs.withColumnRenamed("last", "next").distinct()
    return L.smooth(_lm(spark, sf), pairs).select("ctx", "next", F.round("p", 9).alias("p"))


def lm_generate_step(spark, sf):
    lm = _lm(spark, sf)
    seeds = corpus(turns(spark, sf)).select("post_id", L.last_context(lm, F.col("text")).alias("ctx"))
    return L.draw_next(lm, seeds, "post_id", SEED, 1)


def lm_generate(spark, sf):
    """Each turn's first three words extended to twenty."""
    lm = L.fit(corpus(gram_texts(spark, sf)), 3, keep=True)
    seeds = corpus(turns(spark, sf)).select(
        "post_id", F.array_join(F.slice(T.split_white(F.col("text")), 1, 3), " ").alias("context")
    )
    return L.generate(lm, seeds, 20, SEED, "post_id")


def lm_next_topk(spark, sf):
    return N.top_successors(N.trigram_continuations(gram_texts(spark, sf)), 3)


def lm_next_draw(spark, sf):
    """One weighted next word for every pair of words."""
    drawn = N.drawn_successors(N.trigram_continuations(gram_texts(spark, sf)), SEED)
    return drawn.select("w1", "w2", F.get("drawn", F.lit(0)).alias("w3"))


def lm_continue(spark, sf):
    """The first two words of every turn, continued by up to nineteen."""
    said = F.filter(T.words_and_marks(F.lower("text")), lambda t: t != ".")
    pairs = turns(spark, sf).select(F.get(said, F.lit(0)).alias("w1"), F.get(said, F.lit(1)).alias("w2"))
    walks = N.continued(pairs, N.trigram_continuations(gram_texts(spark, sf)), SEED)
    return walks.select("w1", "w2", F.array_join("words", " ").alias("continuation"), F.size("words").cast("long").alias("n_words"))


def lm_mle(spark, sf):
    out = L.mle(turns(spark, sf), 3)
    return out.select("k", "ctx", "word", "n", F.round("p", 9).alias("p"))


# --- spelling


def _turn_terms(spark, sf):
    words = N.word_counts(corpus(turns(spark, sf)))
    return words.select(F.col("word").alias("term"), "n")


def error_pairs(spark, sf):
    """A misspelling of every document word: one character dropped, doubled, swapped with its
    neighbour or replaced, by md5 of the word. A repeated error keeps its greatest word."""
    w = F.col("word")
    words = _vocabulary(spark, sf).where(F.length("word") >= 2).select("word")
    h = F.md5("word")
    kind = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(4))
    at = (F.pmod(F.conv(F.substring(h, 9, 8), 16, 10).cast("long"), F.length("word") - 1) + 1).cast("int")
    letter = F.char(F.pmod(F.conv(F.substring(h, 17, 8), 16, 10).cast("long"), F.lit(26)) + 97)
    n = F.length("word")

    def misspell(draw: Column) -> Column:
        i = draw["at"]
        head, rest = F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)
        swapped = F.concat(E.char_at(w, i + 1), E.char_at(w, i), F.substring(w, i + 2, n))
        return F.concat(
            head,
            F.when(draw["kind"] == 0, rest)
            .when(draw["kind"] == 1, F.concat(E.char_at(w, i), F.substring(w, i, n)))
            .when(draw["kind"] == 2, swapped)
            .otherwise(F.concat(draw["letter"], rest)),
        )

    draw = F.struct(kind.alias("kind"), at.alias("at"), letter.alias("letter"))
    pairs = each(spread_work(words, "word"), F.array(let(draw, misspell)), "error", F.col("word").alias("correct"))
    pairs = pairs.where(F.col("error") != F.col("correct"))
    return S.last_pairs(pairs.withColumn("line_no", F.col("correct")))


def edits1(spark, sf):
    sets = _turn_terms(spark, sf).select("term", E.edits1(F.col("term")).alias("_e"))
    return sets.select(
        "term",
        F.size("_e").cast("long").alias("n_edits"),
        F.array_min("_e").alias("first_edit"),
        F.array_max("_e").alias("last_edit"),
        F.aggregate("_e", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("total_len"),
    )


def known_edits(spark, sf):
    return S.known_edits(_turn_terms(spark, sf), _vocabulary(spark, sf))


def error_types(spark, sf):
    return S.classify_errors(error_pairs(spark, sf))


def confusion_learn(spark, sf):
    return S.learn_confusions(error_pairs(spark, sf))


def _channel(spark, sf):
    return P.learn_channel(cut_lineage(error_pairs(spark, sf)))


def error_proba(spark, sf):
    return _channel(spark, sf).select("error_type", "key", "n", F.round("p", 9).alias("p"))


def char_error_proba(spark, sf):
    table = S.learn_confusions(error_pairs(spark, sf))
    letters = N.letter_counts(_vocabulary(spark, sf), word_starts=True)
    return S.char_error_rates(table, letters).select("error_type", "key", "n", F.round("p", 9).alias("p"))


def _candidates(spark, sf, terms):
    out = S.candidates(terms, _vocabulary(spark, sf), cut_lineage(_channel(spark, sf)))
    return out.select("term", "word", F.round(F.log("score"), 6).alias("log_score"))


def _corrected(spark, sf, texts, key):
    """Texts corrected by the model and the channel of the documents."""
    docs = corpus(gram_texts(spark, sf))
    checker = replace(P.from_text(docs, keep=True), channel=cut_lineage(_channel(spark, sf)))
    return P.correct_sentences(checker, corpus(texts), ALPHA, key).select(
        key, F.col("sent").cast("long").alias("sent"), "corrected", "term", "word"
    )


def spell_candidates(spark, sf):
    words = N.word_counts(corpus(table(spark, sf, "benchmark")))
    return _candidates(spark, sf, words.select(F.col("word").alias("term")))


def spell_candidates_turns(spark, sf):
    """Candidates of every word of the conversations."""
    return _candidates(spark, sf, _turn_terms(spark, sf))


def spell_correct(spark, sf):
    return _corrected(spark, sf, table(spark, sf, "benchmark"), "item_id")


def spell_correct_turns(spark, sf):
    """Every conversation turn corrected."""
    return _corrected(spark, sf, turns(spark, sf), "post_id")


# --- splits


def _labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", "quality")


def shuffle_order(spark, sf):
    return H.shuffle_rank(documents(spark, sf).select("doc_id"), "doc_id", SEED)


def tail_split(spark, sf):
    return H.tail_split(documents(spark, sf).select("doc_id"), "doc_id", 0.2)


def fold_sets(spark, sf):
    folded = H.kfold(_labels(spark, sf), "doc_id", 10, SEED)
    return H.fold_sets(folded, "doc_id", 0, 0.1)


def kfold(spark, sf):
    return H.kfold(documents(spark, sf).select("doc_id"), "doc_id", 10, SEED)


def stratified_kfold(spark, sf):
    return H.stratified_kfold(_labels(spark, sf), "doc_id", "quality", 10, SEED)


def random_holdout(spark, sf):
    return H.random_holdout(documents(spark, sf).select("doc_id"), "doc_id", 0.1, SEED)


# --- models (no SQL counterpart)


def _task():
    return C.Task(stopwords=STOPWORDS, mentions=MENTIONS)


def _training_posts(spark, sf):
    p = posts(spark, sf)
    return p.withColumn("target", F.when(F.col("author") == "user", 0).otherwise(1))


def _train_eval(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf):
        predictions = C.train_models(_task(), _training_posts(spark, sf), [name], 10, SEED)
        return C.evaluate_models(predictions)

    return run


def predict_posts(spark, sf):
    """Best-model training on the posts of one split part, predictions for the other."""
    p = H.random_holdout(_training_posts(spark, sf), "post_id", 0.2, SEED)
    train = p.where(F.col("part") == "train").drop("part")
    test = p.where(F.col("part") == "test").drop("part")
    model, _ = C.train_best_model(_task(), train, "logreg")
    return C.predict(_task(), model, test)


def stem_vocab(spark, sf):
    words = N.word_counts(corpus(documents(spark, sf)))
    return stem_counts(words)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        label_encode, one_hot, binary_target, project_posts, drop_nulls, nonempty_filter, class_limit,
        parse_posts, filter_text, norm_text, normalize_text, clean_terms, sentence_split, tokens,
        ngram_stopfilter, words_from_ngrams, corpus_counters, content_features, time_features,
        tfidf_uni, tfidf_bigram_capped, tfidf_transform, minmax_scale, feature_table, vocab_index,
        encode_sequences, augment_synonyms, term_counts, sequence_stats, class_balance, corpus_report,
        word_ngrams, char_ngrams, clean_term_freq, letter_counts, padded_ngrams,
        trigram_continuations, confusion_learn, metrics_by_fold, best_model, pred_totals,
        singleton_terms, lm_model, lm_prefix_tf, lm_loglik, lm_smooth, lm_generate_step, lm_generate,
        lm_next_topk, lm_next_draw, lm_continue, lm_mle, edits1, known_edits, error_types, error_proba, char_error_proba,
        spell_candidates, spell_correct, spell_candidates_turns, spell_correct_turns, shuffle_order, tail_split, fold_sets, kfold,
        stratified_kfold, random_holdout, predict_posts, stem_vocab,
    )
}
QUERIES |= {
    "train_eval_logreg": _train_eval("logreg"),
    "train_eval_svm": _train_eval("svm_linear"),
    "train_eval_rbf": _train_eval("svm_rbf"),
    "train_eval_mlp": _train_eval("nn"),
}
