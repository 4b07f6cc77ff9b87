"""Secret scan over a trigram inverted index.

Native expressions only.

1. From each rule's regular expression the driver derives a Boolean trigram query: a choice (OR) of trigram
   sets (AND) without which it cannot match. A rule without such trigrams scans every text.
2. One pass lists which of the queries' trigrams each distinct text holds. The postings are grouped by
   (block of texts, trigram); a block holds a few thousand texts, so a frequent trigram is split.
3. Per block, postings are intersected and united as the queries say. What remains is a bit set of rules
   per candidate text.
4. Candidates are verified with the regular expression itself. Match positions are the running lengths of
   the pieces between the matches; the lengths are in code points.

Base rules are found leftmost and non-overlapping per kind; a match that is too short is dropped after
matching, so it still takes its characters.

Defined results: a null text is empty; copies are searched once in the index and each row gets its result;
null ids stay; an empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.let import let
from quillspark.llm.common import content_key, plain, small, stored

BLOCK_TEXTS = 4096
CHOICES = 64


@dataclass(frozen=True)
class Rule:
    """``group`` of the match must have at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base rules and the public shapes of common credentials.
RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)


# --- trigram queries

#: A choice is a tuple of literal runs; "" between two runs marks text of unknown content.
Choices = list[tuple[str, ...]]


def _joined(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    return (*a[:-1], a[-1] + b[0], *b[1:])


def _runs(tree) -> Choices:
    """Literal runs of every way through a parsed expression; ("", "") stands for anything."""
    found: Choices = [("",)]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            step: Choices = [(chr(arg),)]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            step = [(chr(c),) for _, c in arg]
        elif name == "SUBPATTERN":
            step = _runs(arg[-1])
        elif name == "BRANCH":
            step = [c for branch in arg[1] for c in _runs(branch)]
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            step = [("",), *_runs(arg[2])]
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            step = [_joined(c, ("", "")) for c in _runs(arg[2])]
        else:
            step = [("", "")]
        step = list(dict.fromkeys(step))
        if len(found) * len(step) > CHOICES:
            step = [("", "")]
        found = [_joined(a, b) for a, b in product(found, step)]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of AND sets of lower-case trigrams, or None if some way to match holds no trigram."""
    sets = {
        frozenset(run[i : i + 3].lower() for run in choice for i in range(len(run) - 2))
        for choice in _runs(re._parser.parse(pattern))
    }
    if not all(sets):
        return None
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


# --- the index


def postings(docs: DataFrame, text: str, grams: list[str]) -> DataFrame:
    """(block, gram, texts): sorted keys of the texts of one block that hold the trigram."""
    spark = docs.sparkSession
    blocks = spark.range(1).select(F.lit(max(1, -(-docs.count() // BLOCK_TEXTS))).alias("n")).first()[0]
    held = let(
        F.lower(plain(F.col(text))),
        lambda t: F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(t, g)),
    )
    rows = docs.select(content_key(F.col(text)).alias("content"), held.alias("grams"))
    return (
        rows.select("content", F.explode("grams").alias("gram"))
        .distinct()
        .groupBy(F.pmod("content", F.lit(blocks)).alias("block"), "gram")
        .agg(F.sort_array(F.collect_list("content")).alias("texts"))
    )


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(content, rules): bit set of the rules whose trigram query the text meets."""
    block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "texts"))).alias("of"))
    none = F.array().cast("array<bigint>")

    def texts(gram: str) -> Column:
        return F.coalesce(F.try_element_at("of", F.lit(gram)), none)

    def meets(choices: list[frozenset[str]]) -> Column:
        every = none
        for choice in choices:
            both = None
            for gram in sorted(choice):
                both = texts(gram) if both is None else F.array_intersect(both, texts(gram))
            every = F.array_union(every, both)
        return every

    found = [F.struct(F.lit(1 << rule).cast("long").alias("bit"), meets(q).alias("texts")) for rule, q in queries.items()]
    rows = block.select(F.inline(F.array(*found)))
    return rows.select("bit", F.explode("texts").alias("content")).groupBy("content").agg(F.sum("bit").alias("rules"))


# --- verification


def running_sums(lengths: Column, chunk: int = 128) -> Column:
    """Exclusive running sums of an int array, in time linear for all but huge arrays."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def offsets(a: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(a) + chunk - 1) / chunk).cast("int"))
        sums = F.transform(chunks, lambda c: total(F.slice(a, c * chunk + 1, F.lit(chunk))))
        return let(sums, lambda s: F.transform(s, lambda _, i: total(F.slice(s, F.lit(1), i))))

    def placed(a: Column) -> Column:
        return let(
            offsets(a),
            lambda o: F.transform(
                a,
                lambda _, i: F.get(o, F.floor(i / chunk).cast("int"))
                + total(F.slice(a, i - i % chunk + 1, i % chunk)),
            ),
        )

    return let(lengths, placed)


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of the rule's matches in ``text``, in code points."""
    pattern = F.lit(rule.pattern)
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")

    def build(hits: Column) -> Column:
        widths = F.transform(
            F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit")),
            lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)),
        )
        gaps = F.split(text, rule.pattern, -1)
        measured = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
        zipped = F.arrays_zip(
            running_sums(widths).alias("at"), gaps.alias("gap"), hits.alias("hit"), measured.alias("own")
        )
        kept = F.filter(zipped, lambda x: F.length(x["own"]) >= rule.least)
        return F.transform(
            kept,
            lambda x: F.struct(
                (x["at"] + F.length(x["gap"])).alias("start"),
                F.lit(number).alias("number"),
                (x["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"),
            ),
        )

    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) > 0, build(h)).otherwise(none))


def scan(
    docs: DataFrame, text: str = "text", id: str = "doc_id", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per document: id and ``spans``, an array of (start, number of the rule, end) by start."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    grams = sorted({g for q in queries.values() for s in q for g in s})
    found = stored(candidates(postings(docs, text, grams), queries), "candidates")
    marks = small(found.select(F.col("content").alias("of"), "rules"))
    rows = docs.select(
        F.col(id).alias("__id"), F.col(text).alias("__text"), content_key(F.col(text)).alias("__content")
    ).join(marks, F.col("__content") == F.col("of"), "left")
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")
    parts = []
    for i, rule in enumerate(rules):
        hits = spans(plain(F.col("__text")), rule, i)
        met = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0
        parts.append(F.when(met, hits).otherwise(none) if i in queries else hits)
    return rows.select(F.col("__id").alias(id), F.array_sort(F.concat(*parts)).alias("spans"))


def joined(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(
            found,
            lambda s: F.concat_ws(
                ":", F.get(kinds, s["number"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )
