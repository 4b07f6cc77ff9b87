"""Shuffles, hold-outs and folds, all seeded by md5 of the row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import draws
from quillspark.operators.scale import global_index, md5_rank


def shuffle(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in a seeded random order."""
    return df.orderBy(draws.seeded_key(seed, F.col(key)), key)


def shuffle_rank(df: DataFrame, key: str, seed: int = 0, out: str = "rank") -> DataFrame:
    """1-based place of every row in the seeded order."""
    return md5_rank(df, _seeded(key, seed), [key], out=out)


def _seeded(key: str, seed: int) -> Column:
    return F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))


def tail_split(df: DataFrame, pos: str, ratio: float = 0.2) -> DataFrame:
    """Mark the last int(ratio * n) rows by position ``test``, the others ``train``."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    test = F.floor(rows * F.lit(ratio))
    placed = global_index(df, pos, out="_at")
    return placed.withColumn(
        "part", F.when(F.col("_at") < rows - test, "train").otherwise("test")
    ).drop("_at")


def kfold(df: DataFrame, key: str, k: int = 10, seed: int = 0) -> DataFrame:
    """Seeded folds 0..k-1 whose sizes differ by at most one."""
    ranked = md5_rank(df, _seeded(key, seed), [key], out="_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k))).drop("_rank")


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 10, seed: int = 0) -> DataFrame:
    """Folds assigned inside each class."""
    ranked = md5_rank(df, _seeded(key, seed), [key], [label], out="_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k))).drop("_rank")


def fold_sets(folded: DataFrame, pos: str, test_fold: int, val: float = 0.0) -> DataFrame:
    """One fold as ``test``; of the rest the last share ``val`` by position is ``val``."""
    test = folded.where(F.col("fold") == test_fold).withColumn("part", F.lit("test"))
    rest = folded.where(F.col("fold") != test_fold)
    if val <= 0:
        return rest.withColumn("part", F.lit("train")).unionByName(test)
    marked = tail_split(rest, pos, val)
    return marked.withColumn(
        "part", F.when(F.col("part") == "test", "val").otherwise("train")
    ).unionByName(test)


def random_holdout(df: DataFrame, key: str, ratio: float = 0.1, seed: int = 0) -> DataFrame:
    """Each row is ``test`` with probability ``ratio``, decided by its own id."""
    threshold = int(ratio * (1 << 32))
    return df.withColumn(
        "part", F.when(draws.draw32(seed, F.col(key)) < threshold, "test").otherwise("train")
    )
