"""English stems (the published Porter2 rules) as native expressions over distinct words.

Each step is a projection, so a word is read once per step in generated code and
no Python runs per word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = [
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
]
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able",
    "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful",
    "lessli": "less", "ogi": "og", "li": "",
}
STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate",
    "iti", "ous", "ive", "ize", "ion",
]
SHORT_END = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _suffix(word: Column, suffixes) -> Column:
    """The longest of ``suffixes`` the word ends with, else empty."""
    return F.regexp_extract(word, "(" + "|".join(suffixes) + ")$", 1)


def _less(word: Column, n: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _swap(word: Column, suffix: Column, table: dict[str, str]) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.concat(_less(word, F.length(suffix)), F.element_at(F.create_map(*pairs), suffix))


def _after_first_closed(word: Column) -> Column:
    """Length up to and with the first non-vowel after a vowel; the whole length without one."""
    head = F.regexp_extract(word, "^[^aeiouy]*[aeiouy]+[^aeiouy]", 0)
    return F.when(head == "", F.length(word)).otherwise(F.length(head))


def with_stem(words: DataFrame, word: str = "word", out: str = "stem") -> DataFrame:
    """Add the stem of every word. Meant for distinct words; join back for running text."""
    w, s = F.col("_w"), F.col("_s")
    original = F.lower(F.translate(F.col(word), "’‘", "''"))
    rows = words.withColumn("_o", original).withColumn(
        "_w", F.regexp_replace(F.regexp_replace(F.regexp_replace("_o", "^'", ""), "^y", "Y"), "([aeiou])y", "$1Y")
    )
    special = F.regexp_extract("_w", "^(gener|commun|arsen)", 1)
    rows = rows.withColumn(
        "_r1", F.when(special != "", F.length(special)).otherwise(_after_first_closed(w))
    )
    tail = F.substring(w, F.col("_r1") + 1, F.length(w))
    rows = rows.withColumn("_r2", F.col("_r1") + _after_first_closed(tail))

    def in_region(region: str) -> Column:
        return F.length(w) - F.length(s) >= F.col(region)

    def step(rows: DataFrame, suffix: Column, value: Column) -> DataFrame:
        return rows.withColumn("_s", suffix).withColumn("_w", F.when(s == "", w).otherwise(value))

    rows = step(rows, _suffix(w, ["'s'", "'s", "'"]), _less(w, F.length(s)))
    rows = step(
        rows,
        _suffix(w, ["sses", "ied", "ies", "us", "ss", "s"]),
        F.when(s == "sses", _less(w, F.lit(2)))
        .when(s.isin("ied", "ies"), F.when(F.length(w) > 4, _less(w, F.lit(2))).otherwise(_less(w, F.lit(1))))
        .when((s == "s") & w.rlike("[aeiouy].+s$"), _less(w, F.lit(1)))
        .otherwise(w),
    )
    rows = rows.withColumn("_kept", F.when(w.isin(*KEPT_AFTER_PLURAL), w))
    rows = rows.withColumn("_s", _suffix(w, ["eedly", "eed", "edly", "ed", "ingly", "ing"]))
    base = _less(w, F.length(s))
    rows = rows.withColumn(
        "_b", F.when((s != "") & ~s.isin("eed", "eedly") & base.rlike("[aeiouy]"), base)
    )
    b = F.col("_b")
    repaired = (
        F.when(b.rlike("(at|bl|iz)$"), F.concat(b, F.lit("e")))
        .when(b.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _less(b, F.lit(1)))
        .when((F.length(b) <= F.col("_r1")) & b.rlike(SHORT_END), F.concat(b, F.lit("e")))
        .otherwise(b)
    )
    rows = rows.withColumn(
        "_w",
        F.when(b.isNotNull(), repaired)
        .when(s.isin("eed", "eedly") & in_region("_r1"), F.concat(base, F.lit("ee")))
        .otherwise(w),
    )
    rows = rows.withColumn("_w", F.regexp_replace(w, "^(.+[^aeiouy])[yY]$", "$1i"))
    rows = step(
        rows,
        _suffix(w, STEP2),
        F.when(~in_region("_r1"), w)
        .when((s == "ogi") & ~w.rlike("logi$"), w)
        .when((s == "li") & ~w.rlike("[cdeghkmnrt]li$"), w)
        .otherwise(_swap(w, s, STEP2)),
    )
    rows = step(
        rows,
        _suffix(w, STEP3),
        F.when(~in_region("_r1"), w)
        .when((s == "ative") & ~in_region("_r2"), w)
        .otherwise(_swap(w, s, STEP3)),
    )
    rows = step(
        rows,
        _suffix(w, STEP4),
        F.when(~in_region("_r2"), w)
        .when((s == "ion") & ~w.rlike("[st]ion$"), w)
        .otherwise(_less(w, F.length(s))),
    )
    rows = step(
        rows,
        _suffix(w, ["e", "l"]),
        F.when(
            (s == "e")
            & (in_region("_r2") | (in_region("_r1") & ~_less(w, F.lit(1)).rlike(SHORT_END))),
            _less(w, F.lit(1)),
        )
        .when((s == "l") & in_region("_r2") & w.rlike("ll$"), _less(w, F.lit(1)))
        .otherwise(w),
    )
    known = [x for k, v in EXCEPTIONS.items() for x in (F.lit(k), F.lit(v))]
    stem = (
        F.when(F.length("_o") <= 2, F.col("_o"))
        .when(F.col("_o").isin(*EXCEPTIONS), F.element_at(F.create_map(*known), F.col("_o")))
        .otherwise(F.coalesce("_kept", F.translate(w, "Y", "y")))
    )
    return rows.select(*words.columns, stem.alias(out))


def stem_counts(counted: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """(stem, n) from counted distinct words."""
    return with_stem(counted, word).groupBy("stem").agg(F.sum(n).alias("n"))
