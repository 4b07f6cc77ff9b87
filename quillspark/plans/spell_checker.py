"""Context-sensitive spelling correction in the noisy-channel framework."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.rows import each_at, each_struct
from quillspark.operators import ngrams as N
from quillspark.operators import spelling as S
from quillspark.operators.scale import asked_only, lookup_join
from quillspark.plans import language_model as L
from quillspark.session import cut_lineage


#: Choices of a term that are scored at every spot, and postings of a window up to which they are looked up.
FIRST = 4
WIDE = 256


@dataclass(frozen=True)
class SpellChecker:
    """Language model, vocabulary (word, n), letter counts (chars, n), channel (error_type, key, n, p)."""

    lm: L.LanguageModel
    vocabulary: DataFrame
    letters: DataFrame
    channel: DataFrame | None = None


def from_text(
    docs: DataFrame, n: int = 3, text: str = "text", word_starts: bool = True, keep: bool = False
) -> SpellChecker:
    """Everything but the channel from a corpus; ``keep`` as in ``language_model.fit``."""
    clean = docs.withColumn(text, T.normalize_text(F.col(text)))
    vocabulary = N.word_counts(clean, text)
    return SpellChecker(
        L.fit(clean, n, text=text, keep=keep), vocabulary, N.letter_counts(vocabulary, word_starts=word_starts)
    )


def from_language_model(lm: L.LanguageModel, word_starts: bool = True) -> SpellChecker:
    """Vocabulary and letters recovered from the grams of a model."""
    vocabulary = N.words_of_grams(lm.grams)
    return SpellChecker(lm, vocabulary, N.letter_counts(vocabulary, word_starts=word_starts))


def learn_channel(pairs: DataFrame, word_starts: bool = False, parity: bool = False) -> DataFrame:
    """Channel from (error, correct) pairs, rates over the letters of the error words."""
    table = S.learn_confusions(pairs, parity)
    words = pairs.select(F.col("error").alias("word"), F.lit(1).cast("long").alias("n"))
    return S.error_rates(table, N.letter_counts(words, word_starts=word_starts))


def with_learned_channel(checker: SpellChecker, pairs: DataFrame) -> SpellChecker:
    return replace(checker, channel=learn_channel(pairs))


def with_error_tables(checker: SpellChecker, tables: DataFrame) -> SpellChecker:
    """Channel from given confusion counts, rates over the letters of the corpus."""
    return replace(checker, channel=S.char_error_rates(tables, checker.letters))


def evaluate(checker: SpellChecker, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return L.evaluate(checker.lm, texts, key, text)


def split_sentences(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent, sentence, words) of the normalised texts."""
    rows = each_at(texts, T.sentences(T.normalize_text(F.col(text))), "sent", "sentence", key)
    return rows.withColumn("words", T.words(F.col("sentence")))


def _window_rows(words: Column, at: Column, choice: Column, n: int, sep: str) -> Column:
    """Structs (ctx, ctx_size, next) of the windows that cover position ``at`` (1-based) when its
    word is ``choice``."""
    size = F.size(words)

    def unit(i: Column) -> Column:
        return F.when(i == at, choice).otherwise(F.get(words, i - 1))

    def one(offset: int) -> Column:
        start = at - F.lit(offset)
        ctx = F.filter(
            F.array(*[unit(start + F.lit(j)) for j in range(n - 1)]).cast("array<string>"),
            lambda t: ~T.is_punct_word(t),
        )
        row = F.struct(
            F.array_join(ctx, sep).alias("ctx"),
            F.size(ctx).alias("ctx_size"),
            unit(start + F.lit(n - 1)).alias("next"),
        )
        return F.when((start >= 1) & (start + F.lit(n - 1) <= size), row)

    return F.filter(F.array(*[one(o) for o in range(n)]), lambda r: r.isNotNull())


def _postings(lm: L.LanguageModel) -> DataFrame:
    """(key, word): every gram once per position, ``key`` naming the position and the other words."""
    n, tokens = lm.order, F.split("gram", " ")
    hole = [
        F.struct(_hole([F.get(tokens, F.lit(i)) for i in range(n)], j).alias("key"), F.get(tokens, F.lit(j)).alias("word"))
        for j in range(n)
    ]
    return lm.grams.select(F.inline(F.array(*hole)))


def _hole(units: list[Column], at: int) -> Column:
    return F.concat_ws(" ", F.lit(str(at)), *[u for i, u in enumerate(units) if i != at])


def _spot_keys(words: Column, at: Column, n: int) -> Column:
    """The posting key of every window that covers position ``at`` (1-based); null where a punctuation word shortens
    the context, so that the model answers by other counts."""
    size = F.size(words)

    def one(offset: int) -> Column:
        start = at - F.lit(offset)
        units = [F.get(words, start + F.lit(j - 1)) for j in range(n)]
        short = F.lit(False)
        for j in range(n - 1):
            if j != offset:
                short = short | T.is_punct_word(units[j])
        key = F.when(~short, _hole(units, offset))
        return F.when((start >= 1) & (start + F.lit(n - 1) <= size), F.struct(key.alias("key")))

    return F.filter(F.array(*[one(o) for o in range(n)]), lambda r: r.isNotNull())


def _choices(scored: DataFrame, terms: DataFrame, alpha: float) -> DataFrame:
    """(term, uses, choices): the words two edits from a term, likeliest first; bounded by its length and the alphabet."""
    choices = scored.groupBy("term").agg(
        F.sum("score").alias("_z"), F.collect_list(F.struct("word", "score")).alias("_c")
    )
    shares = F.transform(
        "_c",
        lambda c: F.struct(
            (F.log(c["score"]) - F.log("_z") + F.lit(math.log(1 - alpha))).alias("share"), c["word"].alias("word")
        ),
    )
    return choices.join(terms, "term").select("term", "uses", F.sort_array(shares, asc=False).alias("choices"))


def _scored_words(lm: L.LanguageModel, rows: DataFrame) -> DataFrame:
    """(spot, word, share, s): the log probability of the windows that a word at a spot changes."""
    wins = rows.select(
        "spot", "word", "share",
        F.explode_outer(_window_rows(F.col("near"), F.col("at"), F.col("word"), lm.order, lm.sep)).alias("_w"),
    ).select("spot", "word", "share", "_w.ctx", "_w.ctx_size", "_w.next")
    wins = L.score_windows(lm, wins, ["spot", "word"])
    return wins.groupBy("spot", "word", "share").agg(F.coalesce(F.sum(F.log("p")), F.lit(0.0)).alias("s"))


def best_words(
    lm: L.LanguageModel, spots: DataFrame, choices: DataFrame, first: int = FIRST, wide: int = WIDE
) -> tuple[DataFrame, int]:
    """(spot, _old, _best) for every distinct spot (spot, near, at, term, uses), and how many words were scored.

    A bounded ranking join, model first. Only words that the model has seen in one of a spot's windows can gain more
    than their channel share, and the postings of the windows name them. Any other word scores at most its share plus
    the add-one estimate of unseen windows, so these are taken in the order of their shares, ``first`` at a time and
    ever more, until the next one cannot reach the best so far. Where a window has more than ``wide`` postings, or its
    context a punctuation word, all choices of the term are scored instead; choices that are punctuation always are.
    """
    spots = cut_lineage(
        lookup_join(spots, choices, ["term"], ["choices"], "uses", ["spot"]).withColumn(
            "keys", _spot_keys(F.col("near"), F.col("at"), lm.order)
        )
    )
    keyed = spots.where(F.col("choices").isNotNull()).select("spot", "term", F.explode("keys").alias("_k")).select("spot", "term", "_k.key")
    asked = keyed.where(F.col("key").isNotNull()).select("key").distinct()
    postings = cut_lineage(asked_only(_postings(lm), asked, ["key"]))
    many = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > wide).select(F.col("key").alias("many"))
    many = cut_lineage(many)
    keyed = keyed.join(many, F.col("key") == F.col("many"), "left")
    everything = F.col("key").isNull() | F.col("many").isNotNull()
    full = keyed.where(everything).select("spot").distinct().withColumn("full", F.lit(True))
    seen = keyed.where(~everything).join(postings, "key").select("spot", "word").distinct()
    seen = seen.groupBy("spot").agg(F.collect_set("word").alias("seen"))  # at most ``wide`` a window
    spots = spots.join(full, "spot", "left").join(seen, "spot", "left")
    likely = F.filter(
        "choices",
        lambda c, i: F.coalesce("full", F.lit(False)) | (i < first) | T.is_punct_word(c["word"]) | F.coalesce(F.array_contains("seen", c["word"]), F.lit(False)),
    )
    spots = cut_lineage(spots.select("spot", "near", "at", "term", "choices", "full", likely.alias("likely"), F.size("keys").alias("_n")))
    own = F.array(F.struct(F.lit(None).cast("double").alias("share"), F.col("term").alias("word")))
    none = F.array().cast("array<struct<share:double,word:string>>")
    rows = each_struct(spots, F.concat(own, F.coalesce("likely", none)), "word", "spot", "near", "at")
    found = cut_lineage(_scored_words(lm, rows))
    scored = found.count()
    value = F.round(F.col("share") + F.col("s"), 9)
    best = F.max(F.when(F.col("share").isNotNull(), F.struct(value.alias("v"), F.col("word").alias("word"))))
    size = lm.sizes()[0].cast("double")
    limit = F.round(F.col("next.share") - F.col("_n") * F.log(size), 9)
    result = cut_lineage(found.groupBy("spot").agg(F.max(F.when(F.col("share").isNull(), F.col("s"))).alias("_old"), best.alias("_best")))
    done = first
    while True:
        state = result.select(F.col("spot").alias("_spot"), F.col("_best.v").alias("_v"))
        left = spots.where(F.col("full").isNull() & (F.size("choices") > done)).join(state, F.col("spot") == F.col("_spot"))
        left = left.withColumn("next", F.get("choices", F.lit(done))).where(F.col("_v").isNull() | (limit >= F.col("_v")))
        more = each_struct(left, F.slice("choices", done + 1, 7 * done), "word", "spot", "near", "at")
        more = cut_lineage(_scored_words(lm, more))
        if more.isEmpty():
            return result, scored
        scored, done = scored + more.count(), 8 * done
        better = more.groupBy(F.col("spot").alias("_spot")).agg(best.alias("_more"))
        # null is the least struct
        result = cut_lineage(
            result.join(better, F.col("spot") == F.col("_spot"), "left").select("spot", "_old", F.greatest("_best", "_more").alias("_best"))
        )


def correct_sentences(
    checker: SpellChecker, texts: DataFrame, alpha: float = 0.95, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Best version of every sentence: at most one word changed, and only for a better score.

    Replacing a word changes only the windows that cover it, so a spot is its word with the ``order - 1`` words on
    either side. Equal spots are scored once, by ``best_words``.
    """
    lm, n = checker.lm, checker.lm.order
    sents = split_sentences(texts, key, text)
    places = each_at(sents, F.col("words"), "_at", "term", key, "sent", "words")
    places = places.withColumn("_at", F.col("_at") + 1)
    near = F.slice("words", F.greatest(F.col("_at") - F.lit(n - 1), F.lit(1)), F.least(F.col("_at"), F.lit(n)) + F.lit(n - 1))
    places = places.select(key, "sent", "_at", "term", near.alias("near"), F.least("_at", F.lit(n)).alias("at"))
    places = places.withColumn("spot", F.concat_ws("\u0001", F.col("at").cast("string"), F.array_join("near", "\u0001")))
    places = cut_lineage(places)
    spots = places.groupBy("spot").agg(
        F.first("near").alias("near"), F.first("at").alias("at"), F.first("term").alias("term"), F.count(F.lit(1)).alias("uses")
    )
    terms = places.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    scored = S.candidates(terms.select("term"), checker.vocabulary, checker.channel)
    choices = cut_lineage(_choices(scored, terms, alpha))  # read by several joins below
    answers, _ = best_words(lm, cut_lineage(spots.drop("uses")), choices)
    answers = answers.join(spots.select(F.col("spot").alias("_spot"), "uses"), F.col("spot") == F.col("_spot")).drop("_spot")
    per_spot = lookup_join(places.drop("near", "at", "term"), answers, ["spot"], ["_old", "_best"], "uses", [key, "sent", "_at"])
    per_sent = per_spot.groupBy(key, "sent").agg(
        (F.sum("_old") / n).alias("_all"),
        F.max(
            F.when(
                F.col("_best").isNotNull(),
                F.struct(
                    F.round(F.col("_best.v") - F.col("_old"), 9).alias("v"),
                    (-F.col("_at")).alias("back"),
                    F.col("_best.word").alias("word"),
                ),
            )
        ).alias("_best"),
    )
    ids = sents.select(
        F.concat_ws("|", F.col(key).cast("string"), F.col("sent").cast("string")).alias("_sid"), key, "sent", "sentence", "words"
    )
    base = L.evaluate(lm, ids, "_sid", "sentence").select("_sid", "loglik")
    rows = ids.join(base, "_sid").join(per_sent, [key, "sent"], "left")
    better = F.round(
        F.col("_best.v") + F.col("_all") + F.lit(math.log(1 - alpha)), 9
    ) > F.round(F.col("loglik") + F.lit(math.log(alpha)), 9)
    changed = F.concat(
        F.array_join(
            F.transform(
                "words", lambda w, i: F.when(i + 1 == -F.col("_best.back"), F.col("_best.word")).otherwise(w)
            ),
            " ",
        ),
        F.lit(" ."),
    )
    return rows.select(
        key,
        "sent",
        "sentence",
        F.when(better, changed).otherwise(F.col("sentence")).alias("corrected"),
        F.when(better, F.get("words", -F.col("_best.back") - 1)).alias("term"),
        F.when(better, F.col("_best.word")).alias("word"),
    )


def spell_check(
    checker: SpellChecker, texts: DataFrame, alpha: float = 0.95, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, corrected): corrected sentences of each text, one per line."""
    fixed = correct_sentences(checker, texts, alpha, key, text)
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("sent", "corrected"))), lambda s: s["corrected"]
    )
    return fixed.groupBy(key).agg(T.join_sentences(ordered).alias("corrected"))
