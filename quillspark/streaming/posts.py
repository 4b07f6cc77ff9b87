"""Post streams: the row-level features need no state, so they run unchanged on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.features import extract_features
from quillspark.sources import constants as K


def read_post_stream(
    spark: SparkSession, folder: str, columns: Sequence[str] = tuple(K.TRAIN_COLUMNS)
) -> DataFrame:
    """Tab-separated post files as they arrive in a folder."""
    schema = ", ".join(f"{c} string" for c in columns)
    rows = spark.readStream.schema(schema).option("sep", "\t").option("quote", "").csv(folder)
    return rows.withColumn("time_stamp", F.try_to_timestamp("time_stamp"))


def feature_stream(posts: DataFrame, **options) -> DataFrame:
    return extract_features(posts, "tweet_text", "time_stamp", **options)
