"""Mixing sources to target weights by capped water-filling.

Native expressions only. Sources get a weight by their rank; the mix is as large as all documents together.
A source whose share would exceed ``max_epochs`` times its own size is clamped there, and what it leaves is
shared out again by weight until no source is above. Each round is one aggregation of the source table.

A source repeats all its documents as many whole times as its target allows; what remains is a seeded
sample. Documents of more than a hundredth of that remainder are drawn one by one with the remainder's
share as probability, and the others fill up what is then left in seeded order. The sample is a prefix of
that order, found with running totals over hash buckets, so that a hot source is split. The cut of each
source is one key, and a document is judged by comparing its own key: texts are never shuffled.

Defined results: a null source comes after all others; a null text has size 0; a source of size 0 has
target 0; a null id draws like any value; repeated rows have equal keys and are taken alike; an empty table
gives an empty result. Only the id, the source and the text are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import count_words, small, stored
from quillspark.operators.scale import global_index, running_total

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix"


def targets(sources: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size)."""
    ranked = global_index(sources, F.col("source").asc_nulls_last(), out="rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cap = wide("source_size") * max_epochs

    def above(rest: Decimal, share: Decimal) -> Column:
        return wide("weight") * F.lit(rest) > cap * F.lit(share)

    rest, share = ranked.agg(F.sum(wide("source_size")), F.sum(wide("weight"))).first()
    total = rest
    while share:
        clamped = above(rest, share)
        used, free = ranked.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(Decimal(0))),
            F.coalesce(F.sum(F.when(~clamped, wide("weight"))), F.lit(Decimal(0))),
        ).first()
        if (total - used, free) == (rest, share):
            break
        rest, share = total - used, free
    ceiling = (F.col("source_size") * max_epochs).cast("double")
    if not share:
        return ranked.withColumn("target", ceiling)
    level = F.lit(float(rest)) * F.col("weight") / F.lit(float(share))
    return ranked.withColumn("target", F.when(above(rest, share), ceiling).otherwise(level))


def _order_key(id: Column, size: Column, spare: Column, source_size: Column, seed: str) -> Column:
    """Sampling order inside a source as a string: drawn long documents, short ones, other long ones."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), id.cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    group = F.when(size * 100 <= spare, "1").when(draw * source_size < spare * float(1 << 32), "0").otherwise("2")
    return F.concat(group, digest, F.lpad(size.cast("string"), 15, "0"))


def plan(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """Per source: source_size, target, whole repetitions, spare words and the cut of the sampling order.

    ``sizes`` has (id, source, size) and should be stored, since it is read several times.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(by_source, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = stored(
        goal.withColumn("whole", F.least(whole.cast("long"), F.lit(max_epochs).cast("long"))).withColumn(
            "spare", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
        ),
        "targets",
    )
    side = small(goal.select(F.col("source").alias("of"), "source_size", "spare"))
    keyed = sizes.join(side, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "size", "spare",
        _order_key(F.col("id"), F.col("size"), F.col("spare"), F.col("source_size"), seed).alias("key"),
    )
    placed = running_total(
        keyed, F.col("size"), [F.col("key")], F.substring("key", 1, 4), ["source"], "running"
    )
    cuts = (
        placed.where(2 * F.col("running") - F.col("size") <= 2 * F.col("spare"))
        .groupBy(F.col("source").alias("of"))
        .agg(F.max("key").alias("cut"))
    )
    return goal.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "rank", "weight")


def _taken(rows: DataFrame, sizes: DataFrame, seed: str, **params) -> DataFrame:
    """``rows`` (with __id, __source, __size) and __repeats, source_size and target of their source."""
    side = small(stored(plan(sizes, seed=seed, **params), "mix"))
    side = side.select(*[F.col(c).alias(f"__p_{c}") for c in side.columns])
    key = _order_key(F.col("__id"), F.col("__size"), F.col("__p_spare"), F.col("__p_source_size"), seed)
    extra = F.coalesce(key <= F.col("__p_cut"), F.lit(False)).cast("long")
    joined = rows.join(side, F.col("__source").eqNullSafe(F.col("__p_source")))
    return joined.withColumn("__repeats", F.col("__p_whole") + extra)


def _sizes(docs: DataFrame, text: str, source: str, id: str) -> DataFrame:
    rows = docs.select(
        F.col(id).alias("id"), F.col(source).alias("source"), count_words(F.col(text)).alias("size")
    )
    return stored(rows, "sizes")


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    id: str = "doc_id",
    seed: str = SEED,
    **params,
) -> DataFrame:
    """One row per document: id, size, source_size, target of its source and taken words."""
    sizes = _sizes(docs, text, source, id)
    rows = sizes.select(*[F.col(c).alias(f"__{c}") for c in ("id", "source", "size")])
    return _taken(rows, sizes, seed, **params).select(
        F.col("__id").alias(id),
        F.col("__size").alias("size"),
        F.col("__p_source_size").alias("source_size"),
        F.col("__p_target").alias("target"),
        (F.col("__size") * F.col("__repeats")).alias("taken"),
    )


def repeat(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    id: str = "doc_id",
    seed: str = SEED,
    **params,
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    sizes = _sizes(docs, text, source, id)
    rows = docs.select(
        F.struct("*").alias("__row"),
        F.col(id).alias("__id"),
        F.col(source).alias("__source"),
        count_words(F.col(text)).alias("__size"),
    )
    copies = F.sequence(F.lit(1).cast("long"), F.col("__repeats"))
    return (
        _taken(rows, sizes, seed, **params)
        .where("__repeats > 0")
        .select("__row", F.explode(copies).alias("__copy"))
        .select("__row.*")
    )
