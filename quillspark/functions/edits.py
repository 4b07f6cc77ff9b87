"""One-edit neighbourhoods and the keys of the spelling channel.

A key names the characters an error touches: ``previous + missing`` for a
deletion, ``previous + extra`` for an insertion (``#`` at the word start),
``wrong + right`` for a substitution and the two correct characters for a
transposition. ``parity`` selects the position rules of the two historical
look-up and learning routines, which differ from each other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.let import let

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def _letters() -> Column:
    return F.split(F.lit(ALPHABET), "")


def _head(term: Column, i: Column) -> Column:
    """Characters before position ``i`` (1-based)."""
    return F.substring(term, F.lit(1), i - 1)


def _tail(term: Column, i: Column) -> Column:
    """Characters from position ``i`` on."""
    return F.substring(term, i, F.length(term))


def char_at(term: Column, i: Column) -> Column:
    return F.substring(term, i, F.lit(1))


def edits1(term: Column) -> Column:
    """Distinct strings one deletion, transposition, replacement or insertion away."""
    n = F.length(term)
    none = F.array().cast("array<string>")
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    deletes = F.transform(at, lambda i: F.concat(_head(term, i), _tail(term, i + 1)))
    swaps = F.when(
        n > 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
            lambda i: F.concat(
                _head(term, i), char_at(term, i + 1), char_at(term, i), _tail(term, i + 2)
            ),
        ),
    ).otherwise(none)
    replaces = F.flatten(
        F.transform(
            at,
            lambda i: F.transform(
                _letters(), lambda c: F.concat(_head(term, i), c, _tail(term, i + 1))
            ),
        )
    )
    inserts = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n + 1),
            lambda i: F.transform(
                _letters(), lambda c: F.concat(_head(term, i), c, _tail(term, i))
            ),
        )
    )
    return F.array_distinct(F.concat(deletes, swaps, replaces, inserts))


def first_difference(a: Column, b: Column) -> Column:
    """1-based position of the first differing character, one past the shorter when it is a prefix."""
    n = F.least(F.length(a), F.length(b))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(at, lambda i: char_at(a, i) != char_at(b, i)), F.lit(0)), n + 1)


def describe_edit(error: Column, correct: Column) -> Column:
    """Struct (error_type, key, reachable) of the edit that turns ``correct`` into ``error``; only
    meaningful for strings one edit apart.

    One key rule serves learning and look-up. ``reachable`` tells whether ``correct``
    arises from ``error`` by an edit that adds nothing but a-z.
    """
    le, lc = F.length(error), F.length(correct)

    def build(at: Column) -> Column:
        wrong, right = char_at(error, at), char_at(correct, at)
        before = F.when(at > 1, char_at(correct, at - 1)).otherwise("#")
        swap = (le == lc) & (wrong == char_at(correct, at + 1)) & (char_at(error, at + 1) == right)
        swap = swap & (at < le) & (_tail(error, at + 2) == _tail(correct, at + 2))
        kind = (
            F.when(le < lc, "deletion")
            .when(le > lc, "insertion")
            .when(swap, "transposition")
            .when(error != correct, "substitution")
        )
        key = (
            F.when(le < lc, F.concat(before, right))
            .when(le > lc, F.concat(before, wrong))
            .when(swap, F.substring(correct, at, F.lit(2)))
            .when(error != correct, F.concat(wrong, right))
        )
        reachable = (le > lc) | swap | right.between("a", "z")
        return F.struct(kind.alias("error_type"), key.alias("key"), reachable.alias("reachable"))

    return let(first_difference(error, correct), build)


def error_type(error: Column, correct: Column, parity: bool = False) -> Column:
    """Which of the four error types turns ``correct`` into ``error``; null for equal strings.
    The historical look-up rule goes by length alone."""
    if parity:
        le, lc = F.length(error), F.length(correct)
        return F.when(le < lc, "deletion").when(le > lc, "insertion").otherwise("substitution")
    return describe_edit(error, correct)["error_type"]


def error_key(error: Column, correct: Column) -> Column:
    return describe_edit(error, correct)["key"]


def lookup_key_parity(error: Column, correct: Column) -> Column:
    """Look-up key under the historical rule: a deletion or insertion is answered no later than
    the end of the shorter string, and a first-position edit names one character."""
    le, lc = F.length(error), F.length(correct)

    def build(at: Column) -> Column:
        d, i = F.least(at, le), F.least(at, lc)
        last = F.right(correct, F.lit(1))
        d_before = F.when(d > 1, char_at(correct, d - 1)).when(d == le, last).otherwise("")
        i_before = F.when(i > 1, char_at(correct, i - 1)).when(i == lc, last)
        extra = F.coalesce(F.concat(i_before, char_at(error, i)), char_at(correct, F.lit(1)))
        return (
            F.when(le < lc, F.concat(d_before, char_at(correct, d)))
            .when(le > lc, extra)
            .when(error != correct, F.concat(char_at(error, at), char_at(correct, at)))
        )

    return let(first_difference(error, correct), build)


def learn_key_parity(error: Column, correct: Column) -> Column:
    """Learning key under the historical rule: the touched character first, then the one before."""
    le, lc = F.length(error), F.length(correct)

    def build(at: Column) -> Column:
        i = F.least(at, lc)
        d_before = F.when(at > 1, char_at(error, at - 1)).otherwise("")
        i_before = F.when(i > 1, char_at(error, i - 1)).when(i == lc, F.right(error, F.lit(1)))
        swap = (char_at(error, at) == char_at(correct, at + 1)) & (
            char_at(error, at + 1) == char_at(correct, at)
        )
        return (
            F.when(le < lc, F.concat(char_at(correct, at), d_before))
            .when(le > lc, F.concat(char_at(error, i), F.coalesce(i_before, F.lit(""))))
            .when((at < le) & swap, F.substring(error, at, F.lit(2)))
            .when(error != correct, F.concat(char_at(error, at), char_at(correct, at)))
        )

    return let(first_difference(error, correct), build)


def one_deleted(term: Column) -> Column:
    n = F.length(term)
    return F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda i: F.concat(_head(term, i), _tail(term, i + 1)),
        ),
    ).otherwise(F.array().cast("array<string>"))


def up_to_one_deleted(term: Column) -> Column:
    """The term itself and every string with one of its characters removed."""
    return F.array_distinct(F.concat(F.array(term), one_deleted(term)))


def one_edit_apart(a: Column, b: Column) -> Column:
    """True when ``a`` and ``b`` differ by one deletion, insertion, substitution or swap."""
    swap = let(
        first_difference(a, b),
        lambda at: (char_at(a, at) == char_at(b, at + 1))
        & (char_at(a, at + 1) == char_at(b, at))
        & (_tail(a, at + 2) == _tail(b, at + 2)),
    )
    step = F.levenshtein(a, b, 2)
    return (a != b) & ((step.between(0, 1)) | ((step == 2) & (F.length(a) == F.length(b)) & swap))
