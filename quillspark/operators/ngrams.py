"""Word and character n-grams, term counts and letter counts.

Every count is explode + groupBy, so Catalyst combines map-side and a frequent
gram costs one row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import draws as R
from quillspark.functions import text as T
from quillspark.functions.let import let
from quillspark.functions.rows import each, each_struct
from quillspark.operators.scale import ASKED_ROWS, asked_only, small_side
from quillspark.session import cut_lineage, dropped, written


def window_starts(size: Column, n: int) -> Column:
    """Window starts 1..size-n+1; null when there is no window (``sequence(1, 0)`` counts down)."""
    return F.when(size >= n, F.sequence(F.lit(1), size - F.lit(n - 1)))


def _glue(parts: Column, start: Column, n: int, sep: str) -> Column:
    return F.concat_ws(sep, *[F.get(parts, start + F.lit(k - 1)) for k in range(n)])


def runs_of(df: DataFrame, tokens: Column, n: int) -> DataFrame:
    """Columns w1..wn: one row per run of ``n`` tokens, which are never null. The array is zipped with itself, so that a
    run costs no lambda; rows beyond the last run have a null ``wn``."""
    rows = df.select(tokens.alias("_t"))
    shifted = [F.col("_t"), *[F.slice("_t", k, F.greatest(F.size("_t") - F.lit(k - 1), F.lit(0))) for k in range(2, n + 1)]]
    names = [f"w{k}" for k in range(1, n + 1)]
    return rows.select(F.inline_outer(F.arrays_zip(*shifted))).toDF(*names).where(F.col(names[-1]).isNotNull())


def gram_counts(df: DataFrame, tokens: Column, n: int, keep: Column | None = None) -> DataFrame:
    """(gram, n) of every run of ``n`` tokens that ``keep``, a condition on w1..wn, lets pass. Tokens hold no space and
    are not empty, so a gram is one string in the shuffle and can be cut again."""
    rows = runs_of(df, tokens, n)
    rows = rows if keep is None else rows.where(keep)
    gram = F.concat_ws(" ", *[F.col(f"w{k}") for k in range(1, n + 1)])
    return rows.select(gram.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def last_word(gram: Column) -> Column:
    return F.substring_index(gram, " ", -1)


def before_last(gram: Column) -> Column:
    """The gram less its last word and the space before it."""
    return F.substring(gram, F.lit(1), F.length(gram) - F.length(last_word(gram)) - 1)


def word_grams(tokens: Column, n: int) -> Column:
    """Space-joined runs of ``n`` tokens; null when there are fewer."""
    return let(tokens, lambda t: F.transform(window_starts(F.size(t), n), lambda i: _glue(t, i, n, " ")))


def context_grams(tokens: Column, n: int, sep: str = " ") -> Column:
    """Structs (ctx, last): the first n-1 units of each run joined, and its last unit."""
    def pairs(t: Column) -> Column:
        return F.transform(
            window_starts(F.size(t), n),
            lambda i: F.struct(
                _glue(t, i, n - 1, sep).alias("ctx") if n > 1 else F.lit("").alias("ctx"),
                F.get(t, i + F.lit(n - 2)).alias("last"),
            ),
        )

    return let(tokens, pairs)


def characters(text: Column) -> Column:
    """Characters of ``text``; an empty text has none."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_grams(text: Column, n: int) -> Column:
    return let(
        characters(text), lambda c: F.transform(window_starts(F.size(c), n), lambda i: _glue(c, i, n, ""))
    )


def count_items(df: DataFrame, items: Column, item: str, out: str = "n") -> DataFrame:
    """Occurrences of every element of the array column ``items``."""
    return each(df, items, item).groupBy(item).agg(F.count(F.lit(1)).alias(out))


def word_ngram_counts(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    return gram_counts(docs, T.split_space_nonempty(F.col(text)), n)


def char_ngram_counts(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    return count_items(docs, char_grams(F.col(text), n), "gram")


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of space-separated tokens, the empty token included."""
    return count_items(docs, T.split_space(F.col(text)), "term")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of word-character runs: the spelling vocabulary."""
    return count_items(docs, T.words(F.col(text)), "word")


def clean_term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return count_items(docs, T.clean_tokens(F.col(text)), "term", "tf")


def corpus_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """Number of white-space tokens of the whole corpus."""
    return docs.agg(F.coalesce(F.sum(F.size(T.split_white(F.col(text)))), F.lit(0)).alias("tokens"))


def term_repetition(terms: DataFrame, tf: str = "tf") -> DataFrame:
    """How many terms occur once and how many occur more often."""
    return terms.agg(
        F.count_if(F.col(tf) == 1).alias("singletons"),
        F.count_if(F.col(tf) > 1).alias("repeated"),
    )


def letter_counts(
    counted: DataFrame, word: str = "word", n: str = "n", word_starts: bool = False
) -> DataFrame:
    """One- and two-character counts over counted words, each word weighted by its count.

    With ``word_starts`` a ``#`` is put before every word, which adds ``#`` (the
    number of words) and ``#`` plus first letter.
    """
    w = F.concat(F.lit("#"), F.col(word)) if word_starts else F.col(word)
    units = F.concat(characters(w), F.coalesce(char_grams(w, 2), F.array().cast("array<string>")))
    rows = each(counted, units, "chars", F.col(n).alias("_n"))
    return rows.groupBy("chars").agg(F.sum("_n").alias("n"))


def keep_contentful(grams: DataFrame, units: str, stopwords: Sequence[str]) -> DataFrame:
    """n-grams (arrays) with at least one unit that is null (a pad) or no stopword."""
    stop = list(stopwords)
    return grams.where(F.exists(units, lambda u: u.isNull() | ~u.isin(*stop)))


def padded_grams(tokens: Column, n: int) -> Column:
    """Arrays of ``n`` units over the tokens with n-1 nulls before and after."""
    pad = F.array_repeat(F.lit(None).cast("string"), n - 1)
    return let(
        F.concat(pad, tokens, pad),
        lambda u: F.transform(
            window_starts(F.size(u), n), lambda i: F.array(*[F.get(u, i + F.lit(k - 1)) for k in range(n)])
        ),
    )


def padded_ngram_counts(
    docs: DataFrame, n: int, stopwords: Sequence[str], text: str = "text"
) -> DataFrame:
    """Counts of padded n-grams of lower-cased word and mark tokens, periods left out."""
    tokens = F.filter(T.words_and_marks(F.lower(F.col(text))), lambda t: t != ".")
    grams = each(docs, padded_grams(tokens, n), "units")
    return keep_contentful(grams, "units", stopwords).groupBy("units").agg(
        F.count(F.lit(1)).alias("n")
    )


def trigram_continuations(
    docs: DataFrame, stopwords: Sequence[str] = (), text: str = "text"
) -> DataFrame:
    """(w1, w2) -> counts of the next word, from trigrams without pads."""
    tokens = F.array_remove(T.words_and_marks(F.lower(F.col(text))), ".")
    keep = None
    if stopwords:
        stop = list(stopwords)
        keep = ~F.col("w1").isin(*stop) | ~F.col("w2").isin(*stop) | ~F.col("w3").isin(*stop)
    gram = F.col("gram")
    return gram_counts(docs, tokens, 3, keep).select(
        F.substring_index(gram, " ", 1).alias("w1"), last_word(before_last(gram)).alias("w2"), last_word(gram).alias("w3"), "n"
    )


def top_successors(continuations: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent next words per pair; Spark cuts each map partition to k per
    pair before the shuffle, so a pair with very many successors stays cheap."""
    order = Window.partitionBy("w1", "w2").orderBy(F.desc("n"), "w3")
    return continuations.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _arrival(seed: int, step: int) -> Column:
    """Arrival time of a next word in the race of ``step``: exponential at the rate of its count."""
    digest = R.seeded_key(seed, F.lit(step // 4), F.col("w1"), F.col("w2"), F.col("w3"))
    bits = F.conv(F.substring(digest, step % 4 * 8 + 1, 8), 16, 10).cast("long")  # an md5 holds four draws
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 32))) / F.col("n")


def drawn_successors(continuations: DataFrame, seed: int, steps: int = 1) -> DataFrame:
    """(w1, w2, drawn): ``steps`` independent next words per pair, each with the probability of its count.

    The word that arrives first in an exponential race wins, which is a minimum: it combines map-side, and a pair with
    very many next words sends one row per task. Equal arrivals go to the smaller word."""
    return _drawn(continuations, seed, range(steps))


def _drawn(continuations: DataFrame, seed: int, steps: Sequence[int]) -> DataFrame:
    firsts = [F.min(F.struct(_arrival(seed, s).alias("at"), F.col("w3").alias("w"))).alias(f"_{s}") for s in steps]
    won = continuations.groupBy("w1", "w2").agg(*firsts)
    return won.select("w1", "w2", F.array(*[F.col(f"_{s}.w") for s in steps]).alias("drawn"))


def continued(pairs: DataFrame, continuations: DataFrame, seed: int, steps: int = 19) -> DataFrame:
    """(w1, w2, words): every distinct pair of ``pairs`` and the up to ``steps`` words drawn after it.

    A step draws only for the pairs that its walks have reached, from the counts as they are kept; few pairs are sent to
    every task, so that a step moves none of the counts, and of more pairs a bitmap is. Each walk has the distribution of separate draws, and walks
    that meet at the same pair in the same step go on alike. A walk ends at a pair without a next word, so an unknown
    pair has an empty list; a pair with a null word is left out."""
    counts = written(continuations, "continuations")
    walks = pairs.select("w1", "w2").dropna().distinct()
    none = F.array().cast("array<string>")
    walks = written(walks.withColumns({"p1": F.col("w1"), "p2": F.col("w2"), "words": none, "_open": F.lit(True)}), "walks")
    for s in range(steps):
        asked = walks.where("_open").select(F.col("p1").alias("w1"), F.col("p2").alias("w2"))
        reached = asked_only(counts, asked, ["w1", "w2"])
        known = _drawn(reached, seed, range(s, s + 1)).select(
            F.col("w1").alias("p1"), F.col("w2").alias("p2"), F.get("drawn", F.lit(0)).alias("_next")
        )
        known, before = small_side(cut_lineage(known), ASKED_ROWS), walks
        walks = walks.join(known, ["p1", "p2"], "left").withColumn("next", F.when(F.col("_open"), F.col("_next")))
        walks = written(
            walks.select(
                "w1",
                "w2",
                F.when(F.col("next").isNull(), F.col("p1")).otherwise(F.col("p2")).alias("p1"),  # an ended walk stays
                F.coalesce("next", "p2").alias("p2"),
                F.concat("words", F.array_compact(F.array("next"))).alias("words"),
                F.col("next").isNotNull().alias("_open"),
            ),
            "walks",
        )
        dropped(before)
    dropped(counts)
    return walks.select("w1", "w2", "words")


def words_of_grams(grams: DataFrame, gram: str = "gram", n: str = "n") -> DataFrame:
    """Word counts back from n-gram counts: first word of every gram, plus the tail of the last
    gram in ascending order."""
    first = grams.select(F.get(F.split(gram, " "), F.lit(0)).alias("word"), F.col(n).alias("_n"))
    last = grams.agg(F.max(gram).alias("_last"))
    units = F.split("_last", " ")
    tail = last.select(
        F.explode(F.slice(units, F.lit(2), F.greatest(F.size(units) - 1, F.lit(0)))).alias("word"),
        F.lit(1).cast("long").alias("_n"),
    )
    return first.unionByName(tail).groupBy("word").agg(F.sum("_n").alias("n"))
