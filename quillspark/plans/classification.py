"""Authorship classification: features, k-fold training and evaluation, final model, prediction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import features as X
from quillspark.operators import metrics, models, splits
from quillspark.operators.tfidf import terms_of
from quillspark.session import cut_lineage, dropped
from quillspark.sources import constants as K

FOLDS_AT_ONCE = 4  # an iteration is a short job, so folds share the cores


@dataclass(frozen=True)
class Task:
    """Where the columns are and how text becomes features. ``target`` is 0/1."""

    key: str = "post_id"
    text: str = "text"
    ts: str = "ts"
    stopwords: Sequence[str] = ()
    mentions: Mapping[str, tuple[Sequence[str], str]] = field(default_factory=lambda: K.MENTIONS)
    min_df: int = 2
    max_features: int | None = None
    max_iter: int | None = None

    @property
    def numeric(self) -> list[str]:
        fixed = [c for c in K.COUNT_FEATURES if c not in K.MENTIONS]
        return [*fixed, *self.mentions]


def prepare(task: Task, posts: DataFrame) -> DataFrame:
    """Key, target, numeric features and the term array of every post."""
    rows = X.extract_features(
        posts, task.text, task.ts, stopwords=task.stopwords, mentions=task.mentions
    )
    terms = F.coalesce(
        terms_of(F.col("features_group"), task.stopwords), F.array().cast("array<string>")
    )
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in task.numeric]
    kept = [c for c in ("target", "fold") if c in posts.columns]
    return rows.select(task.key, *kept, terms.alias("terms"), *numbers)


def train_models(
    task: Task,
    posts: DataFrame,
    names: Sequence[str] = tuple(models.MODELS),
    folds: int = 10,
    seed: int = 0,
    stratified: bool = True,
    leaky: bool = False,
) -> DataFrame:
    """(model, fold, key, y, pred) of every model on every held-out fold.

    Features are fitted inside each fold; ``leaky`` fits them once on all rows, as
    older results were made.
    """
    if stratified:
        posts = splits.stratified_kfold(posts, task.key, "target", folds, seed)
    else:
        posts = splits.kfold(posts, task.key, folds, seed)
    rows = prepare(task, posts)
    if task.max_features is None:
        fitted = models.fold_terms(rows, "terms", folds, task.min_df)
        widest = fitted.width
    else:
        # a checkpoint has parts merged by their size; a cached plan keeps one per shuffle partition, for every pass of every fold
        rows, widest = cut_lineage(rows), task.max_features
        fit = lambda d: models.fit_features(d, "terms", task.numeric, task.min_df, task.max_features)
        shared = fit(rows) if leaky else None

    def featured(fold: int) -> tuple[DataFrame, int]:
        if task.max_features is None:
            return models.fold_features(fitted, task.numeric, None if leaky else fold, task.min_df)
        features = shared or fit(rows.where(F.col("fold") != fold))
        return models.plain_features(features.transform(rows)), models.width_of(features, task.numeric)

    def run(fold: int) -> list[DataFrame]:
        table, width = featured(fold)
        train, test = table.where(F.col("fold") != fold), table.where(F.col("fold") == fold)
        cut, parts = task.max_features is None, []
        for name in names:
            predicted, _ = models.fit_predict(name, train, test, width, seed, task.max_iter, cut)
            # the model and the rows of a fold are let go with it
            parts.append(
                cut_lineage(
                    predicted.select(
                        F.lit(name).alias("model"), F.lit(fold).alias("fold"), task.key, F.col("target").alias("y"), "pred"
                    )
                )
            )
        if cut:
            dropped(table)
        return parts

    at_once = min(models.folds_at_once(name, widest, FOLDS_AT_ONCE) for name in names)
    with ThreadPool(min(at_once, folds)) as pool:
        parts = pool.map(inheritable_thread_target(posts.sparkSession)(run), range(folds), chunksize=1)
    if task.max_features is None:
        dropped(fitted.rows)
        dropped(fitted.terms)
    return reduce(DataFrame.unionByName, sum(parts, []))


def evaluate_models(predictions: DataFrame) -> DataFrame:
    return metrics.metrics_by_fold(predictions)


def train_best_model(
    task: Task, posts: DataFrame, name: str, seed: int = 0
) -> tuple[PipelineModel, int]:
    """One model of the named kind on all rows, with its feature stages."""
    if name == "svm_rbf":
        raise ValueError("the projected kernel is not a saved stage; use fit_predict")
    rows = prepare(task, posts).persist()
    features = models.fit_features(rows, "terms", task.numeric, task.min_df, task.max_features)
    width = models.width_of(features, task.numeric)
    train = models.training_rows(models.balanced_weights(features.transform(rows)))
    model = models.classifier(name, rows.count(), width, seed, task.max_iter).fit(train)
    rows.unpersist()
    return PipelineModel([*features.stages, model]), width


def predict(task: Task, model: PipelineModel, posts: DataFrame) -> DataFrame:
    """(key, pred) for every post, under the features fitted in training."""
    return model.transform(prepare(task, posts)).select(
        task.key, F.col("prediction").cast("int").alias("pred")
    )
