"""Readers for posts, corpora, error pairs, confusion counts and word lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import newline_free
from quillspark.sources import constants as K

MAX_WORD_LIST = 20_000


def post_columns(path: str) -> list[str]:
    """Column names of a post file by its kind, read off its name."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "train" in name:
        return K.TRAIN_COLUMNS
    if "test" in name:
        return K.TEST_COLUMNS
    raise ValueError(f"cannot tell train from test posts: {path}")


def _string_schema(columns: Sequence[str], extra: Sequence[str] = ()) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*columns, *extra]])


def load_text(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Tab-separated posts without a header, all columns text. Lines with too many fields are left
    out, short ones padded with nulls. A quoted field may hold line breaks, so a file is read by one task:
    give large inputs as many files."""
    columns = list(columns or post_columns(path))
    raw = (
        spark.read.schema(_string_schema(columns, ["_bad"]))
        .option("sep", "\t")
        .option("header", False)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .csv(path)
    )
    return _without_long(raw, len(columns), quoted=True).select(*columns)


def _without_long(raw: DataFrame, width: int, quoted: bool) -> DataFrame:
    """Rows of at most ``width`` fields; tabs between quotes do not count."""
    line = F.regexp_replace("_bad", '"[^"]*"', "") if quoted else F.col("_bad")
    return raw.where(F.col("_bad").isNull() | (F.size(F.split(line, "\t")) <= width))


def load_dataset(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Posts without id and time stamp."""
    return load_text(spark, path, columns).drop("tweet_id", "time_stamp")


def read_posts(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    time_column: str = "time_stamp",
    time_format: str | None = None,
) -> DataFrame:
    """Tab-separated posts without header or quoting, one column parsed as a timestamp. Lines with too many
    fields are left out as in ``load_text``."""
    columns = list(columns or post_columns(path))
    raw = (
        spark.read.schema(_string_schema(columns, ["_bad"]))
        .option("sep", "\t")
        .option("quote", "")
        .option("header", False)
        .option("columnNameOfCorruptRecord", "_bad")
        .csv(path)
    )
    raw = _without_long(raw, len(columns), quoted=False).select(*columns)
    return raw.withColumn(time_column, _timestamp(F.col(time_column), time_format))


def _timestamp(text: Column, time_format: str | None) -> Column:
    return F.try_to_timestamp(text, F.lit(time_format)) if time_format else F.try_to_timestamp(text)


def read_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text): every file below the paths as one row, newlines made spaces."""
    rows = spark.read.text(list(paths), wholetext=True, recursiveFileLookup=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), newline_free(F.col("value")).alias("text"))


def read_error_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(error, correct) from tab-separated lines; a repeated error keeps its last line."""
    lines = spark.read.text(path).select(
        F.split(F.trim("value"), "\t").alias("_f"),
        F.struct(
            F.col("_metadata.file_path").alias("f"),
            F.col("_metadata.file_block_start").alias("b"),
            F.monotonically_increasing_id().alias("i"),
        ).alias("_line"),
    )
    pairs = lines.where(F.size("_f") >= 2).select(
        F.trim(F.col("_f")[0]).alias("error"), F.trim(F.col("_f")[1]).alias("correct"), "_line"
    )
    return pairs.groupBy("error").agg(F.max_by("correct", "_line").alias("correct"))


def read_confusions(spark: SparkSession, path: str) -> DataFrame:
    """(error_type, key, n) from tab-separated lines."""
    schema = "error_type string, key string, n bigint"
    rows = spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)
    return rows.where(F.col("error_type").isin(*K.ERROR_TYPES))


def confusion_table(spark: SparkSession, tables: dict[str, dict[str, int]]) -> DataFrame:
    """The same relation from nested mappings."""
    rows = [(kind, key, int(n)) for kind, keys in tables.items() for key, n in keys.items()]
    return spark.createDataFrame(rows, "error_type string, key string, n bigint")


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-empty lines."""
    return (
        spark.read.text(path)
        .select(F.trim("value").alias("word"))
        .where(F.col("word") != "")
        .distinct()
    )


def word_list(words: DataFrame) -> list[str]:
    """A word list as literals for expressions; lists beyond a fixed size are refused."""
    rows = words.select("word").limit(MAX_WORD_LIST + 1).collect()
    if len(rows) > MAX_WORD_LIST:
        raise ValueError("word list too long for literals; join it instead")
    return sorted(r[0] for r in rows)


def punct_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in K.PUNCT_WORDS], "word string")
