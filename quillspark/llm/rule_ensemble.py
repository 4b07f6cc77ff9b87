"""Quality classifier as a sparse rule ensemble over text statistics.

1. ``statistics`` describes a whole text by numbers that are native expressions: shares of symbols, capitals, digits,
   repeated words and windows, lengths of words and lines. Nothing else enters a score.
2. Shallow trees are grown on labelled rows (Spark's random forest). Every path from a root to a node is a rule: a
   conjunction of comparisons of statistics with thresholds.
3. A logistic regression with a lasso penalty weighs the rules, next to nothing but an intercept; most get no weight.
4. The rules that keep one are compiled into one column expression, so that scoring is a projection of the scan: no
   Python, no shuffle, no model object on the executors.

Training takes at most ``train_rows`` labelled rows, those with the smallest hash of their id; the bound is on training
alone. Everything else is per row of the whole table.

Defined results: a null text is an empty one, and both get the score of a text without words; a null id is not held
out and has no label; null labels are left out; an id with several labels counts with its greatest, one with several
texts with one of them; with one class only, the score is the constant share of label 1 among the labels (one of each
class added), 0.5 without labels; repeated rows are each scored; an empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.let import let
from quillspark.llm.common import NO_WORD, content_key, plain, stored, words

TRAIN_ROWS = 20_000
TREES = 24
DEPTH = 3
PENALTY = 0.003
SEED = 5

#: The statistics of a text, in the order of the learner's vector.
STATISTICS = (
    "log_words", "word_length", "symbols", "bars", "marks", "capitals", "digits", "ends_in_symbol",
    "plain_words", "distinct_words", "distinct_windows", "longest_word", "words_per_line", "distinct_lines",
)


def _count(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def statistics(text: Column) -> Column:
    """Struct of the statistics of a nullable text, each a finite double."""
    text = plain(text)
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(NO_WORD))

    def counts(w: Column) -> Column:
        windows = F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        )
        return F.struct(
            F.size(w).alias("words"),
            F.length(F.array_join(w, "")).alias("size"),
            F.size(F.filter(w, lambda x: x.rlike(r"[#*$%&|<>!]$"))).alias("ends_in_symbol"),
            F.size(F.filter(w, lambda x: x.rlike(r"^\p{L}+[.,;:?]?$"))).alias("plain_words"),
            F.size(F.array_distinct(w)).alias("distinct_words"),
            F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)).alias("longest_word"),
            let(windows, lambda h: F.struct(F.size(F.array_distinct(h)).alias("distinct"), F.size(h).alias("all"))).alias("windows"),
            let(lines, lambda x: F.struct(F.size(F.array_distinct(x)).alias("distinct"), F.size(x).alias("all"))).alias("lines"),
        )

    def fields(c: Column) -> Column:
        values = {
            "log_words": F.log1p(c["words"].cast("double")),
            "word_length": _share(c["size"], c["words"]),
            "symbols": _share(_count(text, "#*$%&<>@^~=+"), c["size"]),
            "bars": _share(_count(text, "|"), c["words"]),
            "marks": _share(_count(text, "!?"), c["words"]),
            "capitals": _share(_count(text, r"\p{Lu}"), c["size"]),
            "digits": _share(_count(text, r"\p{Nd}"), c["size"]),
            "ends_in_symbol": _share(c["ends_in_symbol"], c["words"]),
            "plain_words": _share(c["plain_words"], c["words"]),
            "distinct_words": _share(c["distinct_words"], c["words"]),
            "distinct_windows": _share(c["windows"]["distinct"], c["windows"]["all"]),
            "longest_word": F.log1p(c["longest_word"].cast("double")),
            "words_per_line": _share(c["words"], c["lines"]["all"]),
            "distinct_lines": _share(c["lines"]["distinct"], c["lines"]["all"]),
        }
        return F.struct(*[values[s].cast("double").alias(s) for s in STATISTICS])

    return let(let(words(text), counts), fields)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is at most, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self, of: Column) -> Column:
        tests = [(of[s] <= t) if most else (of[s] > t) for s, most, t in self.terms]
        return reduce(Column.__and__, tests)

    def __str__(self) -> str:
        return " and ".join(f"{s} {'<=' if most else '>'} {t:.6g}" for s, most, t in self.terms)


@dataclass(frozen=True)
class Ensemble:
    """Intercept and weighted rules; without rules the score is a constant."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self, text: Column) -> Column:
        """Probability of label 1."""

        def of(stats: Column) -> Column:
            total = F.lit(self.intercept)
            for rule, weight in self.rules:
                total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
            return 1 / (1 + F.exp(-total))

        return let(statistics(text), of) if self.rules else F.lit(1.0) / (1 + F.exp(F.lit(-self.intercept)))


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def _simplified(path: Sequence[tuple[str, bool, float]]) -> Rule:
    """The tightest threshold of every statistic and side."""
    tight: dict[tuple[str, bool], float] = {}
    for stat, most, value in path:
        old = tight.get((stat, most), value)
        tight[stat, most] = min(old, value) if most else max(old, value)
    return Rule(tuple((s, m, v) for (s, m), v in sorted(tight.items())))


def tree_rules(description: str) -> list[Rule]:
    """The distinct paths of all trees in Spark's description of a forest."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, bool, float]]] = []
    for line in description.splitlines():
        split = _SPLIT.match(line)
        if not split:
            if line.lstrip().startswith("Tree "):
                path = []
            continue
        depth = len(split[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, (STATISTICS[int(split[3])], split[4] == "<=", float(split[5]))))
        found[_simplified([p[1] for p in path])] = None
    return list(found)


def held_out(id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    label: str = "quality",
    train_rows: int = TRAIN_ROWS,
    trees: int = TREES,
    depth: int = DEPTH,
    penalty: float = PENALTY,
    seed: int = SEED,
) -> Ensemble:
    """The ensemble learned from the labelled rows that are not held out."""
    marks = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(F.col(id)))
    marks = marks.groupBy(F.col(id).alias("__of")).agg(F.max(label).cast("double").alias("label"))
    marks = marks.orderBy(F.xxhash64("__of"), "__of").limit(train_rows)  # bounded, so it can be broadcast
    rows = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"))
    rows = rows.join(F.broadcast(marks), F.col("__id") == F.col("__of"))
    rows = rows.select("__id", "label", statistics(F.col("__text")).alias("stats"), content_key(F.col("__text")).alias("key"))
    rows = stored(rows.groupBy("__id", "label").agg(F.min_by("stats", "key").alias("stats")), "labelled")
    classes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = classes.get(1.0, 0), sum(classes.values()) - classes.get(1.0, 0)
    constant = Ensemble(math.log((ones + 1) / (zeros + 1)))
    if not ones or not zeros:
        return constant
    # one partition of at most train_rows rows: the forest's samples follow the partitions
    rows = rows.orderBy("__id").coalesce(1).select("label", "stats").cache()
    try:
        vectors = rows.select("label", "stats", array_to_vector(F.array(*[F.col(f"stats.{s}") for s in STATISTICS])).alias("features"))
        forest = RandomForestClassifier(
            numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, featureSubsetStrategy="onethird", minInstancesPerNode=5
        )
        rules = tree_rules(forest.fit(vectors).toDebugString)
        if not rules:
            return constant
        fired = F.array(*[r.column(F.col("stats")).cast("double") for r in rules])
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=200, standardization=True)
        model = lasso.fit(rows.select("label", array_to_vector(fired).alias("features")))
    finally:
        rows.unpersist()
    weights = model.coefficients.toArray().tolist()
    return Ensemble(float(model.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def score(docs: DataFrame, ensemble: Ensemble, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) for every row."""
    rows = docs.select(
        F.col(id).alias("__id"), held_out(F.col(id)).alias("held_out"), ensemble.score(F.col(text)).alias("score")
    )
    return rows.select(F.col("__id").alias(id), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
