"""Feature pipelines and classifiers on Spark ML."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    ElementwiseProduct,
    Normalizer,
    SQLTransformer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.rows import each_struct
from quillspark.operators import net
from quillspark.operators.features import fit_minmax
from quillspark.operators.scale import global_index, lookup_join
from quillspark.operators.tfidf import tallies
from quillspark.session import cut_lineage, written

ALL_TERMS = (1 << 31) - 1  # Spark ML's largest vocabulary


def fit_features(
    train: DataFrame, terms: str, numeric: Sequence[str], min_df: int = 2, max_features: int | None = None
) -> PipelineModel:
    """Sparse TF-IDF of the term array next to min-max scaled numbers, in column ``features``.

    Weights are tf * (ln((1 + documents) / (1 + df)) + 1), L2-normalised. The vocabulary
    is whole unless the caller names a cap; Spark ML keeps it on the driver.
    """
    max_features = ALL_TERMS if max_features is None else max_features
    counter = CountVectorizer(
        inputCol=terms, outputCol="_counts", minDF=float(min_df), vocabSize=max_features
    ).fit(train)
    idf = IDF(inputCol="_counts", outputCol="_idf").fit(counter.transform(train))
    weigh = ElementwiseProduct(
        inputCol="_counts", outputCol="_weighted", scalingVec=Vectors.dense(idf.idf.toArray() + 1.0)
    )
    unit = Normalizer(inputCol="_weighted", outputCol="_tfidf", p=2.0)
    scaled = ", ".join(f"{e} AS _s_{c}" for c, e in zip(numeric, _scaled(train, numeric), strict=True))
    scale = SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")
    assemble = VectorAssembler(
        inputCols=["_tfidf", *[f"_s_{c}" for c in numeric]], outputCol="features", handleInvalid="keep"
    )
    return PipelineModel([counter, weigh, unit, scale, assemble])


def _scaled(train: DataFrame, numeric: Sequence[str]) -> list[str]:
    """Each number between its bounds in ``train``, as SQL."""
    bounds = fit_minmax(train, numeric).first()
    scaled = []
    for c in numeric:
        low = bounds[f"min_{c}"] or 0.0
        span = (bounds[f"max_{c}"] or 0.0) - low
        scaled.append(f"(CAST({c} AS DOUBLE) - {low!r}D) / {(span or 1.0)!r}D")
    return scaled


@dataclass(frozen=True)
class FoldTerms:
    """Rows with their terms as a sparse vector ``counts`` of numbers, and what each fold needs of a term's weight.

    ``rows`` keeps all columns but the terms; ``terms`` has ``idx``, ``df`` and ``held``, the rows of each fold that have
    the term. Both are tables in the shared folder. No vocabulary is on the driver.
    """

    rows: DataFrame
    terms: DataFrame
    width: int
    folds: int


def fold_terms(rows: DataFrame, terms: str, folds: int, min_df: int = 2) -> FoldTerms:
    """Numbers the terms of at least ``min_df`` rows once for all folds, the most frequent first. ``rows`` has a ``fold``."""
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    cells = each_struct(rows, tallies(F.col(terms)), "term", "_row", "fold")
    held = F.array(*[F.count_if(F.col("fold") == k).cast("int") for k in range(folds)])
    known = cells.groupBy("term").agg(
        F.count(F.lit(1)).cast("int").alias("df"), F.sum("tf").alias("_total"), held.alias("held")
    )
    known = global_index(known.where(F.col("df") >= min_df), F.desc("_total"), "term", out="idx")
    known = written(known.select("term", F.col("idx").cast("int").alias("idx"), "df", "held"), "terms")
    width = known.count()
    found = lookup_join(cells.drop("fold"), known, ["term"], ["idx"], "df", ["_row", "term"], hint="shuffle_hash")
    found = found.where(F.col("idx").isNotNull()).groupBy(F.col("_row").alias("_of")).agg(
        F.sort_array(F.collect_list(F.struct("idx", F.col("tf").cast("double").alias("tf")))).alias("_cells")
    )
    none = F.array().cast("array<struct<idx:int,tf:double>>")
    rows = rows.drop(terms).join(found, F.col("_row") == F.col("_of"), "left").drop("_row", "_of")
    rows = rows.withColumn("_cells", F.coalesce("_cells", none))
    return FoldTerms(_vectors(rows, "_cells.idx", "_cells.tf", width, "counts").drop("_cells"), known, width, folds)


def _vectors(rows: DataFrame, indices: str, values: str, width: int, out: str) -> DataFrame:
    """``rows``, written, with the sparse vector ``out`` of two arrays. No name is made for a feature, as Spark ML's
    assembler does: so many names would outweigh the vocabulary on the driver."""
    cells = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(width).alias("size"),
        F.col(indices).alias("indices"), F.col(values).alias("values"),
    )
    table = rows.withColumn(out, cells)
    schema = T.StructType([T.StructField(out, VectorUDT()) if f.name == out else f for f in table.schema.fields])
    return written(table, out, schema)


def fold_features(
    fitted: FoldTerms, numeric: Sequence[str], fold: int | None, min_df: int = 2
) -> tuple[DataFrame, int]:
    """As ``fit_features`` on the rows outside ``fold`` (on all for none), and the number of features they have: all
    rows, written, with the column ``features``. The driver holds one number per term."""
    rows = fitted.rows
    train = rows if fold is None else rows.where(F.col("fold") != fold)
    inside = F.col("df") if fold is None else F.col("df") - F.get("held", F.lit(fold))
    documents = train.count()
    df = fitted.terms.select("idx", inside.alias("df")).toArrow()
    idf = np.zeros(max(fitted.width, 1))
    had = df.column("df").to_numpy()
    idf[df.column("idx").to_numpy()] = np.where(had >= min_df, np.log((1 + documents) / (1 + had)) + 1, 0.0)
    weigh = ElementwiseProduct(inputCol="counts", outputCol="_weighted", scalingVec=Vectors.dense(idf[: fitted.width]))
    unit = Normalizer(inputCol="_weighted", outputCol="_tfidf", p=2.0)
    scaled = [F.expr(e) for e in _scaled(train, numeric)]
    seen = unit.transform(weigh.transform(rows)).withColumn("_unit", F.unwrap_udt("_tfidf"))
    kept = F.filter(
        F.arrays_zip(
            F.concat("_unit.indices", F.array(*[F.lit(fitted.width + k) for k in range(len(numeric))])).alias("i"),
            F.concat("_unit.values", F.array(*scaled)).alias("v"),
        ),
        lambda c: c["v"] != 0,
    )
    seen = seen.select(*[c for c in rows.columns if c not in (*numeric, "counts")], kept.alias("_cells"))
    table = _vectors(seen, "_cells.i", "_cells.v", fitted.width + len(numeric), "features")
    return table.drop("_cells"), int((had >= min_df).sum()) + len(numeric)


def width_of(features: PipelineModel, numeric: Sequence[str]) -> int:
    return len(features.stages[0].vocabulary) + len(numeric)


def balanced_weights(train: DataFrame, label: str = "target") -> DataFrame:
    """Column ``weight`` = rows / (classes * rows of the class)."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    return train.withColumn("weight", weight)


def fourier_features(df: DataFrame, width: int, gamma: float, size: int = 256, seed: int = 0) -> DataFrame:
    """Random Fourier features of an RBF kernel in column ``features``: an approximation.

    A row of the random matrix is drawn from its own index, so no task needs the whole matrix.
    """
    offsets = np.random.default_rng(seed).uniform(0, 2 * np.pi, size)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        rows: dict[int, np.ndarray] = {}

        def row(i: int) -> np.ndarray:
            if i not in rows:
                if len(rows) > 20_000:
                    rows.clear()
                rows[i] = np.random.default_rng([seed, int(i)]).normal(size=size)
            return rows[i]

        for indices, values in batches:
            out = []
            for ii, vv in zip(indices, values):
                z = np.zeros(size)
                for i, v in zip(range(len(vv)) if ii is None else ii, vv):
                    z += v * row(int(i))
                out.append(np.sqrt(2.0 / size) * np.cos(np.sqrt(2 * gamma) * z + offsets))
            yield pd.Series(out)

    raw = df.withColumn("_raw", F.unwrap_udt("features"))
    raw = raw.withColumn("_z", project(F.col("_raw.indices"), F.col("_raw.values")))
    return raw.withColumn("features", array_to_vector("_z")).drop("_raw", "_z")


def scale_gamma(df: DataFrame, width: int) -> float:
    """1 / (columns * variance of all matrix entries)."""
    raw = df.select(F.unwrap_udt("features").alias("_f")).select(
        F.aggregate("_f.values", F.lit(0.0), lambda a, x: a + x).alias("s"),
        F.aggregate("_f.values", F.lit(0.0), lambda a, x: a + x * x).alias("q"),
    )
    row = raw.agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    cells = row["n"] * width
    variance = row["q"] / cells - (row["s"] / cells) ** 2
    return 1.0 / (width * variance) if variance > 0 else 1.0


def classifier(name: str, rows: int, width: int, seed: int = 0, max_iter: int | None = None) -> Estimator:
    """A fresh estimator; penalties correspond to C = 1 on ``rows`` rows. By default the feed-forward net
    takes 49 iterations and the others 100."""
    max_iter = max_iter or (49 if name == "nn" else 100)
    reg = 1.0 / max(rows, 1)
    if name == "logreg":
        return LogisticRegression(
            labelCol="target", weightCol="weight", regParam=reg, elasticNetParam=0.0,
            standardization=False, maxIter=max_iter,
        )
    if name in ("svm_linear", "svm_rbf"):
        return LinearSVC(labelCol="target", regParam=reg, standardization=False, maxIter=max_iter)
    if name == "nn":
        return MultilayerPerceptronClassifier(
            labelCol="target", layers=[width, 64, 64, 16, 2], maxIter=max_iter, seed=seed
        )
    raise ValueError(f"unknown model {name}")


def plain_features(df: DataFrame) -> DataFrame:
    """Column ``features`` without its metadata, one attribute per feature, which every task of a fit would carry."""
    return df.withColumn("features", F.col("features").alias("features", metadata={}))


def training_rows(train: DataFrame) -> DataFrame:
    """The columns of an estimator, cut from what made them: the tasks of every iteration carry the lineage, which
    holds the vocabulary and the weight of every term."""
    return cut_lineage(plain_features(train).select("features", "target", "weight"))


# an iteration is one pass over all parts, and each sends a gradient as wide as the features: few rows in many parts
# cost scheduling, and from six parts on Spark shuffles the gradients of every iteration
ROWS_PER_PART = 50_000
MODELS = ["svm_linear", "svm_rbf", "logreg", "nn"]
# the solver of a linear machine keeps about so many numbers per feature on the driver, which folds at once share
SOLVER_NUMBERS = 30
SOLVER_BYTES = 128 << 20


def folds_at_once(name: str, width: int, most: int) -> int:
    """How many fits of a model may run side by side."""
    if name in ("logreg", "svm_linear"):
        return max(1, min(most, SOLVER_BYTES // (8 * SOLVER_NUMBERS * max(width, 1))))
    return most


def fit_predict(
    name: str,
    train: DataFrame,
    test: DataFrame,
    width: int,
    seed: int = 0,
    max_iter: int | None = None,
    cut: bool = False,
) -> tuple[DataFrame, Transformer | None]:
    """Predictions of a fresh model on ``test``; both inputs carry ``features`` and ``target``. The net is no saved
    stage and gives predictions alone. ``cut`` says that ``train`` is read from a table."""
    if name == "nn":
        return net.fit_predict(train, test, width, seed, max_iter), None
    if name == "svm_rbf":
        gamma, cut = scale_gamma(train, width), False
        train = fourier_features(train, width, gamma, seed=seed)
        test = fourier_features(test, width, gamma, seed=seed)
    train = balanced_weights(train)
    rows = train.count()
    train = train.select("features", "target", "weight") if cut else training_rows(train)
    parts = min(rows // ROWS_PER_PART + 1, train.sparkSession.sparkContext.defaultParallelism)
    model = classifier(name, rows, width, seed, max_iter).fit(train.coalesce(parts))
    return model.transform(test).withColumn("pred", F.col("prediction").cast("int")), model
