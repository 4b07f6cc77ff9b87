"""Text normalisation and tokenisation as native column expressions.

The patterns use only constructs that mean the same in Java, RE2 and Python, and
spell out Unicode white space because Java's ``\\s`` stops at ASCII.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.let import let
from quillspark.sources import constants as K

SPACE = (
    r"[\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
ASCII_SPACE = r"[ \t\n\r\f\x0B]"
WORD = r"[\p{L}\p{N}_]+"
LONG_WORD = r"[\p{L}\p{N}_]{2,}"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BLANKED = r"""[\p{Nd}+/.,&!"?@$()_%^*\[\]}{#:;'-]"""


def _sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def lower_case(text: Column) -> Column:
    return F.lower(text)


def filter_text(text: Column) -> Column:
    """Plain words of a post: client anchors named, digits and punctuation blanked, no ``https``."""
    for anchor, name in K.CLIENT_ANCHORS:
        text = F.replace(text, F.lit(anchor), F.lit(name))
    text = _sub(F.lower(text), BLANKED, " ")
    text = F.replace(F.replace(text, F.lit("="), F.lit(" = ")), F.lit("https"), F.lit(""))
    return F.trim(_sub(text, SPACE + "+", " "))


def norm_text(text: Column) -> Column:
    """Lower case with punctuation set off by single spaces; not trimmed."""
    text = _sub(F.lower(text), SPACE + "+", " ")
    text = _sub(text, r"([,.;!?:)])", " $1")
    text = _sub(text, r"([(])", "$1 ")
    text = _sub(text, r'([/"&*=])', " $1 ")
    return _sub(text, " {2,}", " ")


def is_plain(token: Column) -> Column:
    """True where ``norm_text`` would only lower the case."""
    return ~token.rlike(SPACE + r"""|[,.;!?:)(/"&*=]""")


def normalize_text(text: Column) -> Column:
    """Lower case, runs of two or more white-space characters made one space."""
    return F.lower(_sub(text, SPACE + "{2,}", " "))


def newline_free(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def punct_class() -> str:
    chars = [w for w in K.PUNCT_WORDS if len(w) == 1]
    return "[" + "".join("\\" + c if c in "\\[]^-" else c for c in chars) + "]"


def is_punct_word(token: Column) -> Column:
    return token.isin(*K.PUNCT_WORDS)


def clean_format(term: Column) -> Column:
    """The term without punctuation characters."""
    return _sub(term, punct_class(), "")


def split_space(text: Column) -> Column:
    """Split on every single space; empty tokens stay."""
    return F.split(text, " ")


def split_space_nonempty(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def split_white(text: Column) -> Column:
    """Split on runs of white space; empty tokens go."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def split_each_white(text: Column) -> Column:
    """Split on every single ASCII white-space character; empty tokens stay."""
    return F.split(text, ASCII_SPACE)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def long_words(text: Column) -> Column:
    """Lower-cased words of at least two characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(LONG_WORD), F.lit(0))


def words_and_marks(text: Column) -> Column:
    """Words, and every other non-space character as a token of its own."""
    return F.regexp_extract_all(text, F.lit(WORD_OR_MARK), F.lit(0))


def clean_tokens(text: Column) -> Column:
    """White-space tokens that are no punctuation word, cleaned, empties dropped."""
    kept = F.filter(split_white(text), lambda t: ~is_punct_word(t))
    return F.filter(F.transform(kept, clean_format), lambda t: t != "")


def _ends_sentence(
    token: Column, following: Column, titles: Sequence[str], suffixes: Sequence[str], starters: Sequence[str]
) -> Column:
    """Whether a blank-separated token closes its sentence, judged by itself and the token after it."""
    core = F.regexp_replace(F.lower(token), r"[)\]']+$", "")
    before_starter = F.lower(following).isin(*starters)
    # most tokens hold no mark and are spared the patterns
    may_close = F.contains(token, F.lit(".")) | F.contains(token, F.lit("!")) | F.contains(token, F.lit("?"))
    return (
        F.when(following.isNull(), True)
        .when(~may_close, False)
        .when(core.endswith("!") | core.endswith("?"), True)
        .when(~core.endswith(".") | core.endswith(".."), False)
        .when(core.isin(*[f"{t}." for t in titles], "e.g.", "i.e.") | core.rlike("^[a-z][.]$"), False)
        .when(core.isin(*[f"{s}." for s in suffixes]) | core.rlike("^([a-z]{1,2}[.]){2,}$"), before_starter)
        .otherwise(True)
    )


def sentences(
    text: Column,
    titles: Sequence[str] = K.TITLES,
    suffixes: Sequence[str] = K.SUFFIXES,
    starters: Sequence[str] = K.STARTERS,
) -> Column:
    """Sentences of ``text``, tokens joined by one space; a missing final period is added.

    A token that ends in ``!``, ``?`` or a period closes its sentence, unless the period belongs to a title, a
    single letter, an ellipsis, or to an acronym or company suffix that no sentence starter follows. Periods
    inside a token (decimals, domains) never do. A closing quote goes before the mark. The last token always
    closes.
    """
    final = F.when(text.endswith("."), "").when(text.rlike("[!?]$"), " .").otherwise(".")
    tokens = F.transform(
        split_white(F.concat(text, final)),
        # most tokens end in no quote and are spared the pattern
        lambda t: F.when(t.endswith('"') | t.endswith("\u201d"), _sub(t, '([.?!])(["\u201d])$', "$2$1")).otherwise(t),
    )

    def closing(ts: Column) -> Column:
        flags = F.transform(
            ts, lambda t, i: F.when(_ends_sentence(t, F.get(ts, i + 1), titles, suffixes, starters), i)
        )
        return F.filter(flags, lambda i: i.isNotNull())

    def grouped(ts: Column) -> Column:
        return let(closing(ts), lambda e: F.transform(e, lambda at, k: _between(ts, F.get(e, k - 1), at)))

    def _between(ts: Column, last: Column, at: Column) -> Column:
        begin = F.coalesce(last, F.lit(-1)) + 1
        return F.array_join(F.slice(ts, begin + 1, at - begin + 1), " ")

    return F.when(text.isNotNull(), let(tokens, grouped))


def join_sentences(parts: Column) -> Column:
    """One line per sentence, sentences that are only a punctuation word left out."""
    return F.array_join(F.filter(parts, lambda s: ~is_punct_word(s)), "\n")


def count_matches(text: Column, char_class: str) -> Column:
    """Number of characters of ``text`` in ``char_class``."""
    return F.length(text) - F.length(_sub(text, char_class, ""))


def starts_with_any(token: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(token, F.lit(p))
    return out
