"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

DataFrame expressions and Spark's own learner only; no Python runs on the executors.

A rule (action, host, path) fits its host and all subdomains if the path of the URL starts with the rule's;
the longest rule wins. The other URLs get the verdict of a model trained on a labelled URL table of at most
``train_rows`` rows, those with the smallest hash of their URL; the bound is on training alone.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by
the model; if the labels hold one class only, that class is every verdict, and without labels it is
``allow``; repeated rows get the same verdict; an empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRAIN_ROWS = 5_000
FEATURES = 1 << 12
GRAM = 3


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def by_rules(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, action) of the longest rule that fits; null if none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fit = fits(rule, host, path)
        name, action = F.when(fit, rule.name).otherwise(name), F.when(fit, rule.action).otherwise(action)
    return name, action


def _grams(host: Column, path: Column, size: int) -> Column:
    """Character n-grams of host and path, each with its ends marked."""

    def of(mark: str, text: Column) -> Column:
        text = F.concat(F.lit("^"), text, F.lit("$"))
        last = F.greatest(F.length(text) - size + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(size))))

    return F.concat(of("h", host), of("p", path))


def _parts(urls: DataFrame, url: str, *keep: Column) -> DataFrame:
    return urls.select(*keep, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))


def train(
    labelled: DataFrame,
    url: str = "url",
    blocked: str = "blocked",
    train_rows: int = TRAIN_ROWS,
    features: int = FEATURES,
    gram: int = GRAM,
    seed: int = 0,
) -> PipelineModel | str:
    """The fitted model, or the only verdict there is a label for. Rows with a null label are left out."""
    rows = (
        labelled.where(F.col(blocked).isNotNull())
        .select(F.col(url).alias("url"), F.col(blocked).cast("double").alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "url"), "url", "label")
        .limit(train_rows)
    )
    rows = _parts(rows, "url", F.col("label"))
    rows = rows.select("label", _grams(F.col("host"), F.col("path"), gram).alias("grams")).coalesce(1).cache()
    try:
        classes = {r[0] for r in rows.select("label").distinct().collect()}
        if len(classes) < 2:
            return "block" if classes == {1.0} else "allow"
        counted = HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True)
        learner = LogisticRegression(maxIter=30, regParam=0.01)
        return PipelineModel([counted, learner.fit(counted.transform(rows))])
    finally:
        rows.unpersist()


def judge(
    urls: DataFrame,
    rules: Sequence[Rule],
    model: PipelineModel | str,
    url: str = "url",
    id: str = "page_id",
    gram: int = GRAM,
) -> DataFrame:
    """One row per URL: id, host, path, rule and verdict."""
    rows = _parts(urls, url, F.col(id).alias("__id"))
    name, action = by_rules(rules, F.col("host"), F.col("path"))
    rows = rows.select("__id", "host", "path", name.alias("rule"), action.alias("action"))
    if isinstance(model, str):
        verdict = F.lit(model)
    else:
        rows = model.transform(rows.withColumn("grams", _grams(F.col("host"), F.col("path"), gram)))
        verdict = F.when(F.col("prediction") > 0.5, "block").otherwise("allow")
    return rows.select(
        F.col("__id").alias(id), "host", "path", "rule", F.coalesce("action", verdict).alias("verdict")
    )


def label_by_rules(urls: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """(url, blocked) of the URLs that a rule decides, as a labelled table."""
    rows = _parts(urls, url, F.col(url).alias("url"))
    _, action = by_rules(rules, F.col("host"), F.col("path"))
    return rows.select("url", (action == "block").alias("blocked")).where(F.col("blocked").isNotNull())
