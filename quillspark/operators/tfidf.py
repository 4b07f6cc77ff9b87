"""TF-IDF in long form: (doc, term, weight), never one column per term."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.let import let
from quillspark.functions.rows import each_struct
from quillspark.operators.ngrams import window_starts, word_grams
from quillspark.operators.scale import global_index, lookup_join, parts_by_rows

SORT_LIMIT = 100_000


def terms_of(text: Column, stopwords: Sequence[str] = (), bigrams: bool = False) -> Column:
    """Terms of a text: words of two or more characters less the stopwords, optionally followed by
    the pairs of neighbours among the remaining words."""
    words = T.long_words(text)
    if stopwords:
        stop = list(stopwords)
        words = F.filter(words, lambda w: ~w.isin(*stop))
    if not bigrams:
        return words
    none = F.array().cast("array<string>")
    return let(words, lambda w: F.concat(w, F.coalesce(word_grams(w, 2), none)))


def term_frequencies(
    df: DataFrame, key: str, text: str, stopwords: Sequence[str] = (), bigrams: bool = False, parts: int | None = None
) -> DataFrame:
    """(key, term, tf). The texts of a key meet in one row, where their terms are counted: a shuffle carries texts,
    not terms, and what follows per key needs no other. ``parts`` is the number of its partitions (``parts_by_rows``)."""
    texts = df.repartition(parts or parts_by_rows(df), key).groupBy(key).agg(F.collect_list(text).alias("_texts"))
    terms = F.flatten(F.transform("_texts", lambda t: terms_of(t, stopwords, bigrams)))
    return each_struct(texts, tallies(terms), "term", key)


def tallies(terms: Column) -> Column:
    """Structs (term, tf) of the distinct elements of an array: the runs of the sorted array."""
    def runs(s: Column) -> Column:
        first = F.transform(
            window_starts(F.size(s), 1), lambda i: F.when((i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)), i)
        )
        return let(
            F.filter(first, lambda i: i.isNotNull()),
            lambda begin: F.transform(
                begin,
                lambda i, k: F.struct(
                    F.get(s, i - 1).alias("term"),
                    (F.coalesce(F.get(begin, k + 1), F.size(s) + 1) - i).cast("long").alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(terms), runs)


def fit(
    df: DataFrame, tf: DataFrame, key: str, min_df: int = 1, max_features: int | None = None
) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + documents) / (1 + df)) + 1.

    ``max_features`` keeps the terms with the highest total frequency, ties by term:
    a limited sort while that fits one task, ranks from a distributed sort beyond it.
    """
    stats = tf.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")
    ).where(F.col("df") >= min_df)
    if max_features is not None:
        order = [F.desc("total"), F.asc("term")]
        if max_features <= SORT_LIMIT:
            stats = stats.orderBy(*order).limit(max_features)
        else:
            stats = global_index(stats, *order, out="_at").where(F.col("_at") < max_features)
    documents = df.agg(F.count(F.lit(1)).alias("d")).scalar()
    idf = F.log((F.lit(1) + documents) / (F.lit(1) + F.col("df"))) + 1
    return stats.select("term", "df", "total", idf.alias("idf"))


def transform(
    tf: DataFrame, fitted: DataFrame, key: str, small: bool = False, parts: int | None = None
) -> DataFrame:
    """L2-normalised weights under a fitted vocabulary; terms outside it drop out. A ``small`` vocabulary is broadcast.
    ``parts`` is the number of partitions in which terms meet the vocabulary and each other (``parts_by_rows`` of the
    texts); without it Spark merges them by the bytes moved, of which a sort in memory takes several times as many."""
    if small:
        looked = tf.join(F.broadcast(fitted.select("term", "idf")), "term")
    else:
        # a partition of the vocabulary is far smaller than the terms that ask it, which need no sort then
        looked = lookup_join(tf, fitted, ["term"], ["idf"], "df", [key, "term"], hint="shuffle_hash", parts=parts)
    raw = looked.where(F.col("idf").isNotNull()).select(
        key, "term", (F.col("tf") * F.col("idf")).alias("_raw")
    )
    if parts and not small:
        raw = raw.repartition(parts, key)
    # a window holds one document's terms, which one row of text held before
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("_raw") / norm).alias("weight"))


def fit_transform(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stopwords: Sequence[str] = (),
    bigrams: bool = False,
    min_df: int = 1,
    max_features: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Weights of the corpus and the fitted vocabulary."""
    parts = parts_by_rows(df)
    tf = term_frequencies(df, key, text, stopwords, bigrams, parts)
    fitted = fit(df, tf, key, min_df, max_features)
    return transform(tf, fitted, key, max_features is not None and max_features <= SORT_LIMIT, parts), fitted
