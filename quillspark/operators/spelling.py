"""Spelling channel and correction candidates.

Candidates within two errors come from an equality join on the string between them:
one error before the term, one error after the word, each made from the channel's own
entries, so that the score of a pair is the sum over its joined rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import edits as E
from quillspark.functions.rows import each, each_struct
from quillspark.operators.scale import known_to, small_side, spread_work

#: Up to so many terms, some hundred strings each, are a hash table that is dealt out by the shuffle.
FEW_TERMS = 20_000


def known_edits(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, word): vocabulary words one edit from each distinct term, the term itself included.

    Strings one edit apart share a form with at most one character removed, so this is an
    equality join on about as many forms as a word has characters.
    """
    t = spread_work(terms.select("term").distinct(), "term")
    v = spread_work(vocabulary.select("word").distinct(), "word")
    t_forms = each(t, E.up_to_one_deleted(F.col("term")), "_form", "term")
    v_forms = each(v, E.up_to_one_deleted(F.col("word")), "_form", "word")
    a, b = F.col("term"), F.col("word")
    pairs = (
        t_forms.select("term", F.xxhash64("_form").alias("_form"))
        .join(v_forms.select("word", F.xxhash64("_form").alias("_form")), "_form")
        .select("term", "word")
        .where(F.levenshtein(a, b, 2) >= 0)
        .distinct()
    )
    # a replacement by the same letter gives the term back when it has a letter
    same = pairs.where((a == b) & (F.length(a) > 0) & (a.rlike("[a-z]") | a.rlike(r"(.)\1")))
    near = each_struct(
        pairs.where(E.one_edit_apart(a, b)), F.array(E.describe_edit(a, b)), "key", "term", "word"
    )
    return near.where("reachable").select("term", "word").unionByName(same)


def last_pairs(lines: DataFrame) -> DataFrame:
    """(error, correct) from (error, correct, line_no): the last pair of each error."""
    return lines.groupBy("error").agg(F.max_by("correct", "line_no").alias("correct"))


def classify_errors(pairs: DataFrame, parity: bool = False) -> DataFrame:
    """Type and key of every (error, correct) that is one edit apart."""
    e, c = F.col("error"), F.col("correct")
    rows = each_struct(
        spread_work(pairs, "error").where(E.one_edit_apart(e, c)), F.array(E.describe_edit(e, c)), "key", *pairs.columns
    )
    key = E.learn_key_parity(e, c) if parity else F.col("key")
    return rows.where("reachable").select(*pairs.columns, "error_type", key.alias("key"))


def learn_confusions(pairs: DataFrame, parity: bool = False) -> DataFrame:
    """(error_type, key, n) over distinct errors that are one edit from their correction."""
    return classify_errors(pairs, parity).groupBy("error_type", "key").agg(F.count(F.lit(1)).alias("n"))


def _rates(table: DataFrame, letters: DataFrame, denominator: Column) -> DataFrame:
    keys = letters.agg(F.count(F.lit(1)).alias("k")).scalar()
    known = letters.select(F.col("chars").alias("_chars"), F.col("n").alias("_c"))
    rows = table.withColumn("_of", denominator).join(known, F.col("_of") == F.col("_chars"), "left")
    return rows.select(
        "error_type", "key", "n", (F.col("n") / F.coalesce("_c", keys)).alias("p")
    )


def error_rates(table: DataFrame, letters: DataFrame) -> DataFrame:
    """Rate of each error: its count over the count of the characters it can happen to, taken from
    the error words; characters never counted stand for the number of distinct letter keys."""
    of = (
        F.when(F.col("error_type") == "insertion", F.substring("key", 1, 1))
        .when(F.col("error_type") == "substitution", F.substring("key", 2, 1))
        .otherwise(F.col("key"))
    )
    return _rates(table, letters, of)


def char_error_rates(table: DataFrame, letters: DataFrame) -> DataFrame:
    """As ``error_rates`` but always over the count of the whole key, from corpus letters."""
    return _rates(table, letters, F.col("key"))


def confusion_maps(table: DataFrame, value: str = "n") -> DataFrame:
    """The channel as one map per error type, for export."""
    return table.groupBy("error_type").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", value)))).alias("table")
    )


def _places(words: DataFrame, name: str) -> DataFrame:
    """One row per character of a word and one for its end: what stands before, at and after the place."""
    w = F.col(name)
    at = F.explode(F.sequence(F.lit(1), F.length(w) + 1)).alias("i")
    rows = spread_work(words.select(name).distinct(), name).select(name, at)
    return rows.select(
        name, F.substring(w, F.lit(1), F.col("i") - 1).alias("head"), F.substring(w, F.col("i") + 1, F.length(w)).alias("tail"),
        F.when(F.col("i") > 1, E.char_at(w, F.col("i") - 1)).otherwise("#").alias("before"),
        E.char_at(w, F.col("i")).alias("c"), E.char_at(w, F.col("i") + 1).alias("d"),
    )


def _ways(rates: DataFrame) -> dict[str, DataFrame]:
    """The channel by error type, its keys cut into their two characters; broadcast when it is small."""
    known = rates.where(F.col("p") > 0).select(
        "error_type", F.substring("key", 1, 1).alias("x"), F.substring("key", 2, 1).alias("y"), "p"
    )
    kinds = ("deletion", "insertion", "substitution", "transposition")
    return {k: small_side(known.where(F.col("error_type") == k).drop("error_type")) for k in kinds}


def _moves(rows: DataFrame, name: str, moves: list[tuple[DataFrame, Column, Column]]) -> DataFrame:
    found = [rows.join(rates, on).select(name, mid.alias("mid"), "p") for rates, on, mid in moves]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def intended(terms: DataFrame, channel: DataFrame) -> DataFrame:
    """(term, mid, p): the strings that one possible error turns into ``term``. Corrections add nothing but a-z.

    A change inside a run of equal characters counts at the end of the run, so every string appears once."""
    ways, rows = _ways(channel), _places(terms, "term")
    c, d, x, y, head, tail = (F.col(k) for k in ("c", "d", "x", "y", "head", "tail"))
    letter, here = y.between("a", "z"), c != ""
    return _moves(
        rows,
        "term",
        [
            (ways["deletion"], (x == F.col("before")) & (y != c) & letter, F.concat(head, y, c, tail)),
            (ways["insertion"], (x == F.col("before")) & (y == c) & here & (c != d), F.concat(head, tail)),
            (ways["substitution"], (x == c) & (y != c) & here & letter, F.concat(head, y, tail)),
            (
                ways["transposition"],
                (x == d) & (y == c) & (d != "") & (c != d),
                F.concat(head, d, c, F.substring(tail, F.lit(2), F.length(tail))),
            ),
        ],
    )


def misspelt(vocabulary: DataFrame, channel: DataFrame) -> DataFrame:
    """(word, mid, p): the strings that one possible error makes of ``word``."""
    ways, rows = _ways(channel), _places(vocabulary, "word")
    c, d, x, y, head, tail = (F.col(k) for k in ("c", "d", "x", "y", "head", "tail"))
    letter = c.between("a", "z")
    return _moves(
        rows,
        "word",
        [
            (ways["deletion"], (x == F.col("before")) & (y == c) & letter & (c != d), F.concat(head, tail)),
            (ways["insertion"], (x == F.col("before")) & (y != c), F.concat(head, y, c, tail)),
            (ways["substitution"], (y == c) & (x != c) & letter, F.concat(head, x, tail)),
            (
                ways["transposition"],
                (x == c) & (y == d) & (d != "") & (c != d),
                F.concat(head, d, c, F.substring(tail, F.lit(2), F.length(tail))),
            ),
        ],
    )


def candidates(terms: DataFrame, vocabulary: DataFrame, channel: DataFrame) -> DataFrame:
    """(term, word, score) for every vocabulary word one or two possible errors away: the channel probability of the
    error plus that of every pair of errors.

    Two edits meet in the middle: the strings one possible error before a term, and those one possible error after a
    word, are joined on the string between. The rules of the channel act while the strings are made, so no pair is
    formed that two possible errors do not connect.
    """
    terms = terms.select("term").distinct()
    first = intended(terms, channel)
    last = misspelt(vocabulary, channel)
    few = terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    one = first.join(vocabulary.select("word").distinct(), F.col("mid") == F.col("word")).select("term", "word", F.col("p").alias("_way"))
    middle = first.where(F.col("mid") != "").select("term", F.col("mid").alias("_mid"), F.col("p").alias("_p"), F.xxhash64("mid").alias("_k"))
    last = last.select("word", "mid", "p", F.xxhash64("mid").alias("k"))
    last = known_to(last, "k", middle, "_k")  # most strings of the vocabulary lead to no term
    # the rows of a few terms fit a task's hash table, which spares sorting the far more rows of the vocabulary
    two = (
        (middle.hint("shuffle_hash") if few else middle).join(last, (F.col("_k") == F.col("k")) & (F.col("_mid") == F.col("mid")))
        .where(F.col("term") != F.col("word"))
        .select("term", "word", (F.col("_p") * F.col("p")).alias("_way"))
    )
    return one.unionByName(two).groupBy("term", "word").agg(F.sum("_way").alias("score"))
