"""Sinks: score tables, predictions, stem counts and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_scores(df: DataFrame, path: str, append: bool = True) -> None:
    """CSV with a header, nulls written as NA."""
    mode = "append" if append else "overwrite"
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)


def write_predictions(df: DataFrame, path: str, pos: str = "pos", pred: str = "pred") -> None:
    """Predicted classes separated by spaces, in row order over the part files."""
    ordered = df.orderBy(pos).select(F.col(pred).cast("int").cast("string").alias("value"))
    ordered.write.mode("overwrite").option("lineSep", " ").text(path)


def save_stem_counts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_model(model: PipelineModel, folder: str, name: str, width: int) -> str:
    """Save under a path that names the model and its input width."""
    path = f"{folder.rstrip('/')}/{model_name(name, width)}"
    model.write().overwrite().save(path)
    return path


def model_name(name: str, width: int) -> str:
    return f"{name}__{width}"


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_best_model(spark: SparkSession, folder: str) -> tuple[str, PipelineModel]:
    """The first model of a folder, by name."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())
    if not names:
        raise FileNotFoundError(f"no model below {folder}")
    path = f"{folder.rstrip('/')}/{names[0]}"
    return path, load_model(path)
