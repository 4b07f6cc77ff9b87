"""Building blocks that keep ranks, running totals and lookups distributed.

A plain window without a partition key, or with one hot key, ends up in a
single task. The helpers here split that work: a coarse bucket carries the
bulk of the rows, and only one total per bucket is ever ordered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut_lineage

HOT_SHARE = 0.001
#: Words of 64 bits in a filter of keys: that many rows at most are sent to every task.
FILTER_WORDS = 1 << 21
#: Up to so many keys that are asked for are sent to every task.
ASKED_ROWS = 500_000


def md5_bucket(key: Column, digits: int = 4) -> Column:
    """Leading hex digits of md5: an even split whatever the key distribution."""
    return F.substring(F.md5(key.cast("string")), 1, digits)


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def running_total(
    df: DataFrame,
    value: Column,
    order: Sequence[Column],
    bucket: Column,
    by: Sequence[str] = (),
    out: str = "running",
) -> DataFrame:
    """Inclusive running sum of ``value`` along ``order`` inside each ``by`` group.

    ``bucket`` must be non-decreasing along ``order`` and take a bounded number
    of values (16 bits of md5, say). Rows are sorted per (group, bucket); only
    the bucket totals of a group are summed in one window.
    """
    by = list(by)
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = rows.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_o_{c}") for c in by],
        F.col("_bucket").alias("_o_bucket"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"),
    )
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("_inside", F.sum("_value").over(inside))
    cond = F.col("_bucket") == F.col("_o_bucket")
    for c in by:
        cond = cond & _same(F.col(c), F.col(f"_o_{c}"))
    return rows.join(offsets, cond, "inner").select(
        *df.columns, (F.col("_offset") + F.col("_inside")).cast("long").alias(out)
    )


def md5_rank(
    df: DataFrame, key: Column, ties: Sequence[str], by: Sequence[str] = (), out: str = "rank"
) -> DataFrame:
    """1-based rank along ``md5(key), ties`` inside each ``by`` group."""
    ranked = running_total(
        df.withColumn("_md5", F.md5(key.cast("string"))),
        F.lit(1),
        [F.col("_md5"), *[F.col(c) for c in ties]],
        F.substring("_md5", 1, 4),
        by,
        out,
    )
    return ranked.drop("_md5")


def global_index(df: DataFrame, *order: Column | str, out: str = "idx") -> DataFrame:
    """0-based position of every row in the total order ``order``.

    A range-partitioned sort is materialised once; a row's position is then its
    place in its own partition plus the sizes of the partitions before it.
    ``order`` should end in a unique column so that no value is hot.
    """
    rows = cut_lineage(df.orderBy(*order)).select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_in_part"),
    )
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    # one row per sort partition, so the broadcast side is bounded by the task count
    return rows.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_in_part")).alias(out)
    )


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast ``df`` only after counting that it is small; else leave the join to Catalyst."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def _mark(key: Column) -> tuple[Column, Column]:
    """The word of the filter and the bit in it that stand for a 64-bit key."""
    at = F.pmod(key, F.lit(FILTER_WORDS * 64))
    return F.floor(at / 64).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))


def known_to(rows: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    """The rows of ``rows`` whose 64-bit key may be in ``others``: all that are and some more, the fewer the sparser the
    filter. It is a bitmap, so that most strings which nothing asks for are dropped before they are moved."""
    word, bit = _mark(F.col(other))
    bits = others.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    word, bit = _mark(F.col(key))
    marked = rows.withColumn("_at", word).withColumn("_one", bit)
    found = marked.join(F.broadcast(bits), F.col("_at") == F.col("_word"))
    return found.where(F.col("_bits").bitwiseAND(F.col("_one")) != 0).select(*rows.columns)


def asked_only(rows: DataFrame, asked: DataFrame, keys: Sequence[str], few: int | None = None) -> DataFrame:
    """The rows of ``rows`` whose ``keys`` are in ``asked``. Few keys are sent to every task; more of them first make a
    bitmap, so that of a large table only the rows which may be asked for, and some more, are moved to meet them."""
    keys = list(keys)
    asked = cut_lineage(asked.select(*keys).dropna().distinct())
    if asked.count() <= (ASKED_ROWS if few is None else few):
        return rows.join(F.broadcast(asked), keys, "left_semi")
    hashes = asked.select(F.xxhash64(*keys).alias("_o"))
    near = known_to(rows.withColumn("_k", F.xxhash64(*keys)), "_k", hashes, "_o")
    # an inner join, since Catalyst would move a semi join below the bitmap
    return near.join(asked, keys).select(*rows.columns)


def spread_scan(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan that has fewer splits than the session has cores, such as one small
    file with a long text per row; larger inputs come back as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > cores else df.repartition(2 * cores, key)


def spread_texts(df: DataFrame, key: str, pieces: int = 8) -> DataFrame:
    """Hash-partition a scan into ``pieces`` parts a split, at least two a core. A task that counts grams holds far more
    than its texts, and what it cannot hold is written and sorted; moving the texts costs less than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, pieces * df.rdd.getNumPartitions()), key)


def parts_by_rows(df: DataFrame, rows: int = 4000) -> int:
    """Parts of at most about ``rows`` texts, at least two a core: splits and shuffle partitions grow with the input, or
    stay as few as they are, so a part of a split does not bound what a task holds."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, df.count() // rows + 1)


def spread_work(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into a fixed number of parts.

    Adaptive execution merges partitions by their bytes; rows that are small but
    costly to compute on need the parts kept apart.
    """
    spark = df.sparkSession
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        2 * spark.sparkContext.defaultParallelism,
    )
    return df.repartition(parts, *keys)


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    weight: str,
    spread: Sequence[str],
    share: float = HOT_SHARE,
    total: Column | None = None,
    hint: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Left-join ``values`` of ``lookup`` (unique on string ``keys``) without a hot partition.

    Keys that carry more than ``share`` of the total ``weight`` are at most
    ``1/share`` rows, so that part is broadcast. Rows answered by it, and rows with
    a null key, are spread over the partitions of the second join by a hash of their
    ``spread`` columns instead of meeting on their key. ``total`` may be given where it is known.
    ``hint`` is Spark's join hint for the second join: ``shuffle_hash`` spares sorting ``left`` where a partition
    of the lookup fits a task's memory. ``parts`` fixes the partitions of the second join, where Spark would merge them
    by the bytes moved.
    """
    keys, values = list(keys), list(values)
    if total is None:
        total = lookup.agg(F.sum(weight).cast("double")).scalar()
    hot = lookup.where(F.col(weight) > total * share).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys],
        *[F.col(v).alias(f"_hv_{v}") for v in values],
        F.lit(True).alias("_hot"),
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_h_{k}"))
    marked = left.join(F.broadcast(hot), cond, "left")
    aside = F.concat(F.lit("\uffff"), F.pmod(F.xxhash64(*spread), F.lit(65536)).cast("string"))
    first = keys[0]
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull()
    marked = marked.withColumn(
        "_key", F.when(F.coalesce(F.col("_hot"), F.lit(False)) | empty, aside).otherwise(F.col(first))
    )
    rest = lookup.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys], *[F.col(v).alias(f"_cv_{v}") for v in values]
    )
    if parts:
        marked, rest = marked.repartition(parts, "_key"), rest.repartition(parts, f"_c_{first}")
    rest = rest.hint(hint) if hint else rest
    cond = F.col("_key") == F.col(f"_c_{first}")
    for k in keys[1:]:
        cond = cond & (F.col(k) == F.col(f"_c_{k}"))
    joined = marked.join(rest, cond, "left")
    return joined.select(
        *[F.col(c) for c in left.columns],
        *[
            F.when(F.col("_hot"), F.col(f"_hv_{v}")).otherwise(F.col(f"_cv_{v}")).alias(v)
            for v in values
        ],
    )
