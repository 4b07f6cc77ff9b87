"""Labels, projections and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.scale import global_index, lookup_join

MAX_CLASSES = 2000


def label_codes(df: DataFrame, label: str, pos: Sequence[str]) -> DataFrame:
    """(label, code, n): every distinct non-null value numbered from 0 by first appearance."""
    first = (
        df.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.min(F.struct(*pos)).alias("_first"), F.count(F.lit(1)).alias("n"))
    )
    return global_index(first, "_first", label, out="code").select(
        F.col(label).alias("label"), "code", "n"
    )


def encode_labels(
    df: DataFrame, label: str, pos: Sequence[str], out: str = "code", codes: DataFrame | None = None
) -> DataFrame:
    """Add the code of ``label``; null labels keep a null code, no other column changes."""
    codes = label_codes(df, label, pos) if codes is None else codes
    table = codes.select(F.col("label").alias(label), F.col("code").alias(out), "n")
    return lookup_join(df, table, [label], [out], "n", list(pos))


def distinct_classes(df: DataFrame, column: str) -> list:
    """The values of a class column, for one-hot columns; refuses columns with too many."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_CLASSES + 1)
    values = sorted(r[0] for r in rows.collect())
    if len(values) > MAX_CLASSES:
        raise ValueError(f"{column} has more than {MAX_CLASSES} classes")
    return values


def one_hot(df: DataFrame, columns: Sequence[str], classes: dict | None = None) -> DataFrame:
    """A 0/1 column per class of each column, side by side."""
    added = []
    for c in columns:
        values = (classes or {}).get(c) or distinct_classes(df, c)
        added += [
            F.when(F.col(c) == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}") for v in values
        ]
    return df.select("*", *added)


def collapse_target(code: Column) -> Column:
    """Third class joined to the second."""
    return F.when(code == 2, F.lit(1)).otherwise(code)


def encode_target(df: DataFrame, code: str, classes: Sequence[int] | None = None) -> DataFrame:
    """One-hot of the label codes when there are more than two, then class 2 counted as class 1."""
    values = list(classes) if classes is not None else distinct_classes(df, code)
    if len(values) > 2:
        df = one_hot(df, [code], {code: values})
    return df.withColumn(code, collapse_target(F.col(code)))


def binary_target(df: DataFrame, column: str = "device", zero: str = "android") -> DataFrame:
    """0 for one value of ``column``, 1 for every other and for null."""
    return df.withColumn("target", F.when(F.col(column) == zero, 0).otherwise(1))


def split_xy(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Features without the label, and the label alone."""
    return df.drop(label), df.select(label)


def split_text_label(df: DataFrame, text: str, label: str, key: str) -> DataFrame:
    return df.select(key, text, label)


def feature_columns(df: DataFrame, passthrough: Sequence[str]) -> DataFrame:
    """Every column but the passthrough ones."""
    return df.drop(*passthrough)


def stack(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test rows together; columns only one of them has become null."""
    return train.unionByName(test, allowMissingColumns=True)


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def non_empty(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.length(text) > 0)


def non_empty_encoded(df: DataFrame, encoded: str = "encoded") -> DataFrame:
    return df.where(F.col(f"{encoded}.length") > 0)


def class_head(df: DataFrame, target: str, value: int, pos: str, limit: int = 50) -> DataFrame:
    """The first ``limit`` rows of one class."""
    return df.where(F.col(target) == value).orderBy(pos).limit(limit)


def parse_posts(df: DataFrame, text: str, label: str, key: str) -> DataFrame:
    """Text and label only, the text as plain words."""
    return df.select(key, T.filter_text(F.col(text).cast("string")).alias(text), label)
