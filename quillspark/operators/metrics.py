"""Corpus reports and classification metrics, each a single aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.rows import each
from quillspark.operators.ngrams import term_counts

METRICS = ["Accuracy", "Precision", "Recall", "F1", "AUC", "PRAUC"]


def sequence_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Number of texts, and longest, shortest and truncated mean length in characters."""
    size = F.length(text)
    return df.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.max(size).cast("long").alias("max_len"),
        F.min(size).cast("long").alias("min_len"),
        F.floor(F.avg(size)).cast("long").alias("mean_len"),
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of every class."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).select(
        label, "n", (F.col("n") / rows).alias("ratio")
    )


def vocabulary_size(df: DataFrame, text: str = "text", approximate: bool = False) -> DataFrame:
    if approximate:
        tokens = each(df, F.split(text, " "), "term")
        return tokens.agg(F.approx_count_distinct("term").alias("terms"))
    return term_counts(df, text).agg(F.count(F.lit(1)).alias("terms"))


def corpus_report(df: DataFrame, label: str, text: str = "text") -> DataFrame:
    """(measure, value): vocabulary size, lengths and class counts in one small table."""
    stats = sequence_stats(df, text)
    lengths = stats.select(
        F.explode(
            F.map_from_arrays(
                F.array(*[F.lit(c) for c in stats.columns]), F.array(*[F.col(c) for c in stats.columns])
            )
        ).alias("measure", "value")
    )
    terms = vocabulary_size(df, text).select(F.lit("terms").alias("measure"), F.col("terms").alias("value"))
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("value")).select(
        F.concat(F.lit("class:"), F.coalesce(F.col(label).cast("string"), F.lit("null"))).alias("measure"), "value"
    )
    return terms.unionByName(lengths).unionByName(classes)


def metrics_by_fold(
    predictions: DataFrame, model: str = "model", fold: str = "fold", y: str = "y", pred: str = "pred"
) -> DataFrame:
    """Scores of hard 0/1 predictions per model and fold, with an ``AVG`` row per model.

    The areas under the ROC and the precision-recall step curves are closed forms of
    the four confusion counts. The first four metrics are percentages.
    """
    yes, said = F.col(y) == 1, F.col(pred) == 1
    counts = predictions.groupBy(model, F.col(fold).cast("string").alias("fold")).agg(
        F.count_if(yes & said).cast("double").alias("tp"),
        F.count_if(~yes & said).cast("double").alias("fp"),
        F.count_if(~yes & ~said).cast("double").alias("tn"),
        F.count_if(yes & ~said).cast("double").alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    auc = F.when((tp + fn > 0) & (tn + fp > 0), (tp / (tp + fn) + tn / (tn + fp)) / 2)
    rate = (tp + fn) / total
    one_sided = (tp + fp == 0) | (tn + fn == 0)
    step = (1 - recall) * (rate + precision) / 2 + recall * (precision + 1) / 2
    prauc = F.when(one_sided, (rate + 1) / 2).otherwise(step)
    rows = counts.select(
        F.col(model).alias("Model"),
        F.col("fold").alias("Fold"),
        ((tp + tn) / total * 100).alias("Accuracy"),
        (precision * 100).alias("Precision"),
        (recall * 100).alias("Recall"),
        (f1 * 100).alias("F1"),
        auc.alias("AUC"),
        prauc.alias("PRAUC"),
    )
    sets = rows.groupingSets(
        [[F.col("Model"), F.col("Fold")], [F.col("Model")]], F.col("Model"), F.col("Fold")
    )
    return sets.agg(*[F.avg(m).alias(f"_{m}") for m in METRICS]).select(
        "Model",
        F.coalesce("Fold", F.lit("AVG")).alias("Fold"),
        *[F.round(f"_{m}", 3).alias(m) for m in METRICS],
    )


def best_model(results: DataFrame) -> DataFrame:
    """The model with the highest average F1, ties by name."""
    return (
        results.where(F.col("Fold") == "AVG").orderBy(F.desc("F1"), "Model").limit(1).select("Model", "F1")
    )


def predicted_totals(
    predictions: DataFrame, first: str, second: str, pred: str = "pred"
) -> DataFrame:
    """Rows predicted for each of the two authors; 0 is the first."""
    return predictions.groupBy(
        F.when(F.col(pred) == 0, first).otherwise(second).alias("author")
    ).agg(F.count(F.lit(1)).alias("n"))
