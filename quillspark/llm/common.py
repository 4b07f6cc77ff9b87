"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import shared_folder

#: Blank characters between words: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]+"
NO_WORD = r"^[\x20\x09-\x0D]*$"
LAST = (1 << 63) - 1
#: A table of at most so many (key, flag) rows is sent to every task; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def plain(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words of the whole text; null has none."""
    return F.filter(F.split(plain(text), BLANK), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def content_key(*parts: Column) -> Column:
    """64-bit key of one or more nullable columns; null differs from every value."""
    return F.xxhash64(*[x for p in parts for x in (p, p.isNull())])


@contextmanager
def arrow_batches(spark: SparkSession, most: str) -> Iterator[None]:
    """Arrow batches of at most ``most`` bytes for the jobs run inside: a batch of whole texts is held on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def stored(df: DataFrame, name: str = "stage", batch: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that a lost executor costs a re-read."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with arrow_batches(spark, batch) if batch else nullcontext():
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of keys, with a broadcast hint if a count shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parts(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of about ``most`` bytes of one string column; empty ones are left out. Freed memory goes
    back to the system at the end, since Spark keeps its Python workers for later stages."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            done = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
    release()


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        pass
