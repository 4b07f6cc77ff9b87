"""n-gram language model: fit, score, smooth, extend.

The model is a relation, one row per distinct gram; scoring, smoothing and
generation are joins against it. A context is matched by equality on its tokens.
``match="string"`` reproduces the older behaviour where a context matches every
gram whose text starts with it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import draws
from quillspark.functions import text as T
from quillspark.functions.let import let
from quillspark.functions.rows import each_struct
from quillspark.operators import ngrams as N
from quillspark.operators.scale import ASKED_ROWS, asked_only, lookup_join, running_total, small_side
from quillspark.session import cut_lineage, dropped, written


@dataclass(frozen=True)
class LanguageModel:
    """Grams (gram, ctx, last, n) and cleaned term frequencies (term, tf) of a corpus."""

    order: int
    chars: bool
    grams: DataFrame
    terms: DataFrame
    counted: tuple[int, int] | None = None
    marked: DataFrame | None = None  # a kept table of the grams with ``_b`` and ``_c``, by which a step finds its rows

    def sizes(self) -> tuple[Column, Column]:
        """Number of distinct grams and of all grams: numbers of a kept model, else subqueries."""
        if self.counted is not None:
            return F.lit(self.counted[0]), F.lit(self.counted[1])
        return (
            self.grams.agg(F.count(F.lit(1))).scalar(),
            self.grams.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar(),
        )

    @property
    def sep(self) -> str:
        return "" if self.chars else " "

    def model(self) -> DataFrame:
        return self.grams.select("gram", "n")

    def window_size(self) -> int:
        return self.order


def fit(
    docs: DataFrame, n: int = 3, chars: bool = False, text: str = "text", keep: bool = False
) -> LanguageModel:
    """Count grams of every document. ``keep`` writes the counts to the shared folder, which pays
    when the model is used by several jobs."""
    n = 3 if n < 1 else n
    if chars:
        pairs = each_struct(docs, N.context_grams(N.characters(F.col(text)), n, ""), "last")
        counted = pairs.groupBy("ctx", "last").agg(F.count(F.lit(1)).alias("n"))
        grams = counted.select(F.concat("ctx", "last").alias("gram"), "ctx", "last", "n")
    else:
        grams = N.word_ngram_counts(docs, n, text)
    sizes = None
    if keep:
        grams = written(grams, "grams")
        row = grams.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        sizes = (row[0], row[1])
    lm = LanguageModel(n, chars, grams, N.clean_term_counts(docs, text), sizes)
    return replace(lm, grams=_cut_again(lm, grams).select("gram", "ctx", "last", "n"))


def _parts_of(lm: LanguageModel) -> list[str]:
    """The columns of a gram's context and last unit that must be kept, since the gram alone does not tell them."""
    return ["ctx", "last"] if lm.chars else []


def _cut_again(lm: LanguageModel, grams: DataFrame) -> DataFrame:
    """Grams of words with their ``ctx`` and ``last``, which take no room in a kept table."""
    if lm.chars:
        return grams
    gram = F.col("gram")
    ctx = N.before_last(gram) if lm.order > 1 else F.lit("")
    return grams.withColumns({"ctx": ctx, "last": N.last_word(gram)})


def _prefix_rows(lm: LanguageModel, k: Column) -> Column:
    """First ``k`` units of a gram as text."""
    if lm.chars:
        return F.substring("gram", F.lit(1), k)
    return F.call_function("substring_index", F.col("gram"), F.lit(" "), k)


def prefix_counts(
    lm: LanguageModel, needed: DataFrame, match: str = "token", longest: int | None = None
) -> DataFrame:
    """Counts (prefix, last, n) of grams starting with each distinct ``needed.prefix``.

    Token mode explodes a gram into its prefixes of up to ``longest`` tokens, string mode
    into its character prefixes no longer than the longest needed one; both are then
    equality joins.
    """
    wanted = needed.select("prefix").where(F.col("prefix") != "").distinct()
    everything = lm.grams.groupBy("last").agg(F.sum("n").alias("n")).select(
        F.lit("").alias("prefix"), "last", "n"
    )
    if match == "token" or lm.chars:
        longest = lm.order if longest is None else longest
        if longest < 1:
            return everything
        sizes = F.sequence(F.lit(1), F.lit(longest))
        rows = lm.grams.select(F.explode(sizes).alias("_k"), "gram", "last", "n").select(
            _prefix_rows(lm, F.col("_k")).alias("prefix"), "last", "n"
        )
    else:
        lengths = wanted.agg(F.max(F.length("prefix")).alias("m")).scalar()
        upto = F.least(F.length("gram"), F.coalesce(lengths, F.lit(1)))
        rows = lm.grams.select(
            F.explode(F.sequence(F.lit(1), upto)).alias("_k"), "gram", "last", "n"
        ).select(F.substring("gram", F.lit(1), F.col("_k")).alias("prefix"), "last", "n")
    starting = asked_only(rows, wanted, ["prefix"])
    return starting.groupBy("prefix", "last").agg(F.sum("n").alias("n")).unionByName(everything)


def windows(lm: LanguageModel, tokens: Column) -> Column:
    """Structs (ctx, size, next) of every window of ``order`` tokens; punctuation words are left
    out of the context, so ``size`` may fall below order-1."""
    n = lm.order

    def one(units: Column, i: Column) -> Column:
        ctx = F.slice(units, i, n - 1) if n > 1 else F.array().cast("array<string>")
        if not lm.chars:
            ctx = F.filter(ctx, lambda t: ~T.is_punct_word(t))
        return F.struct(
            F.array_join(ctx, lm.sep).alias("ctx"),
            F.size(ctx).alias("ctx_size"),
            F.get(units, i + F.lit(n - 2)).alias("next"),
        )

    return let(
        tokens, lambda u: F.transform(N.window_starts(F.size(u), n), lambda i: one(u, i))
    )


def score_windows(
    lm: LanguageModel, rows: DataFrame, spread: list[str], match: str = "token", parity: bool = False
) -> DataFrame:
    """Add the probability ``p`` of ``next`` after ``ctx``: a count ratio where the pair was seen,
    else the add-one estimate over all distinct grams. Rows without a window keep a null ``p``."""
    keep = rows.columns
    full = lm.grams.select("ctx", F.col("last").alias("next"), "n")
    if match == "token":
        short = rows.where(F.col("ctx_size") < lm.order - 1).select(F.col("ctx").alias("prefix"))
        less = prefix_counts(lm, short, longest=lm.order - 2).select(
            F.col("prefix").alias("ctx"), F.col("last").alias("next"), "n"
        )
        # prefixes shorter than a full context never equal one, so the union stays unique
        pairs = full.unionByName(less) if lm.order > 1 else less
    else:
        asked = rows.select(F.col("ctx").alias("prefix"))
        if parity:
            asked = asked.unionByName(rows.select(_clipped("ctx").alias("prefix")))
        pairs = prefix_counts(lm, asked, match).select(
            F.col("prefix").alias("ctx"), F.col("last").alias("next"), "n"
        )
    # only the contexts that are asked for
    asked = rows.select("ctx")
    if parity:
        asked = asked.unionByName(rows.select(_clipped("ctx").alias("ctx")))
    pairs = asked_only(pairs, asked, ["ctx"])
    pairs = written(pairs, "asked") if lm.counted is not None else pairs  # four joins read it
    totals = pairs.groupBy("ctx").agg(F.sum("n").alias("total"))
    size, total = lm.sizes()
    # every level of context sums to the same total, so the hot share stays bounded
    hot = {"spread": spread, "total": total.cast("double")}
    hits = pairs.withColumnRenamed("n", "hit")
    rows = lookup_join(rows, hits, ["ctx", "next"], ["hit"], "hit", **hot)
    rows = lookup_join(rows, totals, ["ctx"], ["total"], "total", **hot)
    seen = F.col("hit") / F.col("total")
    if parity:
        rows = rows.withColumnRenamed("ctx", "_ctx").withColumn("ctx", _clipped("_ctx"))
        hits = pairs.withColumnRenamed("n", "hit2")
        rows = lookup_join(rows, hits, ["ctx", "next"], ["hit2"], "hit2", **hot)
        totals = totals.withColumnRenamed("total", "total2")
        rows = lookup_join(rows, totals, ["ctx"], ["total2"], "total2", **hot)
        rows = rows.drop("ctx").withColumnRenamed("_ctx", "ctx")
        unseen = (F.coalesce("hit2", F.lit(0)) + 1) / (F.coalesce("total2", F.lit(0)) + size)
    else:
        unseen = F.lit(1.0) / (F.coalesce("total", F.lit(0)) + size)
    p = F.when(F.col("hit") > 0, seen).otherwise(unseen)
    return rows.select(*keep, F.when(F.col("next").isNotNull(), p).alias("p"))


def _clipped(ctx: str) -> Column:
    """The context less its last character, as the historical smoothing reads it."""
    return F.substring(F.col(ctx), F.lit(1), F.length(ctx) - 1)


def evaluate(
    lm: LanguageModel,
    texts: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    match: str = "token",
    parity: bool = False,
) -> DataFrame:
    """Log-likelihood of every text: the sum of log window probabilities, 0 without a window."""
    tokens = N.characters(F.col(text)) if lm.chars else T.split_each_white(F.col(text))
    rows = texts.select(key, F.posexplode_outer(windows(lm, tokens)).alias("pos", "_w"))
    rows = rows.select(key, "pos", "_w.ctx", "_w.ctx_size", "_w.next")
    scored = score_windows(lm, rows, [key, "pos"], match, parity)
    return scored.groupBy(key).agg(
        F.coalesce(F.sum(F.log("p")), F.lit(0.0)).alias("loglik"),
        F.count("p").alias("windows"),
    )


def smooth(lm: LanguageModel, pairs: DataFrame) -> DataFrame:
    """Add-one probability of each (ctx, next) of ``pairs``."""
    size, total = lm.sizes()
    hot = {"spread": ["ctx", "next"], "total": total.cast("double")}
    asked = asked_only(lm.grams, pairs, ["ctx"]).select("ctx", "last", "n")
    asked = written(asked, "asked") if lm.counted is not None else asked
    totals = asked.groupBy("ctx").agg(F.sum("n").alias("total"))
    hits = asked.select("ctx", F.col("last").alias("next"), F.col("n").alias("hit"))
    rows = lookup_join(pairs, hits, ["ctx", "next"], ["hit"], "hit", **hot)
    rows = lookup_join(rows, totals, ["ctx"], ["total"], "total", **hot)
    p = (F.coalesce("hit", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + size)
    return rows.select(*pairs.columns, p.alias("p"))


def prefix_frequency(
    lm: LanguageModel, subs: DataFrame, match: str = "token", parity: bool = False
) -> DataFrame:
    """Count of grams starting with each distinct ``sub``; an unseen one gets its add-one estimate."""
    subs = subs.select("sub").distinct()
    totals = _prefix_totals(lm, subs.select(F.col("sub").alias("prefix")), match)
    seen = subs.join(totals, subs["sub"] == totals["prefix"], "left").select("sub", "total")
    words = F.split("sub", " ")
    split = seen.select(
        "sub",
        "total",
        F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ").alias("ctx"),
        F.element_at(words, -1).alias("next"),
    )
    split = split.withColumn(
        "ctx_size", F.when(F.col("ctx") == "", 0).otherwise(F.size(words) - 1)
    )
    split = cut_lineage(split) if lm.counted is not None else split
    found = split.where(F.col("total").isNotNull()).select("sub", F.col("total").cast("double").alias("tf"))
    estimate = _estimate(lm, split.where(F.col("total").isNull()), match, parity)
    return found.unionByName(estimate.select("sub", F.col("p").alias("tf")))


def _prefixes(lm: LanguageModel, wanted: DataFrame) -> DataFrame:
    """(prefix, last, n) of every gram, once for each number of units that a ``wanted.prefix`` has."""
    if lm.chars:
        units = F.length("prefix")
    else:
        units = F.when(F.col("prefix") == "", 0).otherwise(F.size(F.split("prefix", " ")))
    sizes = wanted.select(units.alias("k")).where(F.col("k") <= lm.order).distinct()
    sizes = F.array(*[F.lit(r.k) for r in sizes.collect()]).cast("array<int>")  # at most ``order`` + 1
    return lm.grams.select(F.explode(sizes).alias("_k"), "gram", "last", "n").select(
        _prefix_rows(lm, F.col("_k")).alias("prefix"), "last", "n"
    )


def _prefix_totals(lm: LanguageModel, wanted: DataFrame, match: str) -> DataFrame:
    """(prefix, total) for the prefixes of ``wanted`` that a gram starts with."""
    if match == "token":
        counts = asked_only(_prefixes(lm, wanted), wanted, ["prefix"])
    else:
        counts = prefix_counts(lm, wanted, match)
    return counts.groupBy("prefix").agg(F.sum("n").alias("total"))


def _estimate(lm: LanguageModel, rows: DataFrame, match: str, parity: bool) -> DataFrame:
    """Add-one estimate of ``next`` after ``ctx`` where the prefix itself was not found."""
    ctx = _clipped("ctx") if parity else F.col("ctx")
    rows = rows.withColumn("_prefix", ctx)
    wanted = rows.select(F.col("_prefix").alias("prefix"))
    totals = _prefix_totals(lm, wanted, match).withColumnRenamed("total", "_total")
    if match == "token":
        pairs = rows.select(F.col("_prefix").alias("prefix"), F.col("next").alias("last")).distinct()
        hits = asked_only(_prefixes(lm, wanted), pairs, ["prefix", "last"])
        hits = hits.groupBy("prefix", "last").agg(F.sum("n").alias("n"))
    else:
        hits = prefix_counts(lm, wanted, match)
    hits = hits.select("prefix", F.col("last").alias("_last"), F.col("n").alias("_hit"))
    size, _ = lm.sizes()
    rows = rows.join(totals, rows["_prefix"] == totals["prefix"], "left").drop("prefix")
    rows = rows.join(
        hits, (rows["_prefix"] == hits["prefix"]) & (rows["next"] == hits["_last"]), "left"
    ).drop("prefix")
    p = (F.coalesce("_hit", F.lit(0)) + 1) / (F.coalesce("_total", F.lit(0)) + size)
    return rows.withColumn("p", p)


def mle(docs: DataFrame, n: int = 3, text: str = "text") -> DataFrame:
    """Padded grams of orders 1..n with the ratio of each count to its context's count."""
    begin = F.array_repeat(F.lit("<s>"), n - 1)
    end = F.array_repeat(F.lit("</s>"), n - 1)
    tokens = F.concat(begin, T.words_and_marks(F.lower(F.col(text))), end)

    def of_order(units: Column, k: int) -> Column:
        return F.transform(
            F.coalesce(N.context_grams(units, k), F.array().cast("array<struct<ctx:string,last:string>>")),
            lambda g: F.struct(F.lit(k).alias("k"), g["ctx"].alias("ctx"), g["last"].alias("word")),
        )

    grams = each_struct(
        docs, let(tokens, lambda u: F.concat(*[of_order(u, k) for k in range(1, n + 1)])), "word"
    )
    counts = grams.groupBy("k", "ctx", "word").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("ctx").agg(F.sum("n").alias("total"))
    # contexts of different orders differ in their number of tokens, so ctx alone is a key
    joined = lookup_join(counts, totals, ["ctx"], ["total"], "total", ["k", "word"])
    return joined.select("k", "ctx", "word", "n", (F.col("n") / F.col("total")).alias("p"))


HOT_GRAMS = 100_000  # beyond so many grams, the running weights of a context are summed in buckets


@dataclass(frozen=True)
class Sampler:
    """Guide tables for weighted draws.

    ``contexts`` (ctx, total, bins) and ``guide`` (ctx, bin, lo, hi, gram, last). The
    running weight of a context's grams is cut into about as many equal bins as it
    has grams; a gram is listed in every bin it reaches into. A draw is then an
    equality join on (ctx, bin) that meets two grams on average, and a frequent
    context is spread over many bins.
    """

    contexts: DataFrame
    guide: DataFrame
    grams: DataFrame


def _counted(lm: LanguageModel) -> tuple[int, int]:
    if lm.counted is not None:
        return lm.counted
    row = lm.grams.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return row[0], row[1]


def sampler(lm: LanguageModel, asked: DataFrame | None = None) -> Sampler:
    """Guide tables of all contexts, or of those in ``asked.ctx``, whose grams are written once."""
    grams = lm.grams
    if asked is not None:
        asked = asked.select("ctx").dropna().distinct()
        if lm.marked is not None:
            asked = cut_lineage(asked)
            marks = small_side(asked.select(_mark(F.col("ctx")).alias("_c")).distinct(), ASKED_ROWS)
            # numbers are met first, so that a context is only made of the few rows that may be asked for
            grams = _cut_again(lm, lm.marked.join(marks, "_c"))
        grams = written(asked_only(grams, asked, ["ctx"]).select("gram", "ctx", "last", "n"), "asked")
    total = F.lit(max(_counted(lm)[1], 1))
    contexts = grams.groupBy("ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("_grams"))
    hot = F.broadcast(contexts.where(F.col("_grams") > HOT_GRAMS))
    md5 = F.md5("gram")
    # the md5 is made behind the exchange, so that it is not moved
    plain = grams.join(hot.select("ctx"), "ctx", "left_anti").repartition("ctx").withColumn("_md5", md5)
    whole = Window.partitionBy("ctx")
    upto = whole.orderBy("_md5", "gram").rowsBetween(Window.unboundedPreceding, 0)
    plain = plain.select(
        "ctx", "gram", "last", "n", F.sum("n").over(upto).alias("hi"),
        F.sum("n").over(whole).alias("total"), F.count(F.lit(1)).over(whole).alias("_grams"),
    )
    many = grams.join(hot, "ctx").withColumn("_md5", md5)
    many = running_total(many, F.col("n"), [F.col("_md5"), F.col("gram")], F.substring("_md5", 1, 4), ["ctx"], "hi")
    bins = (F.col("_grams") + F.floor(F.col("total") * 1000 / total)).cast("long").alias("bins")
    sized = plain.unionByName(many.drop("_md5")).select(
        "ctx", "gram", "last", "total", bins, (F.col("hi") - F.col("n")).alias("lo"), "hi"
    )
    guide = sized.select(
        "ctx", _reached(F.col("total"), F.col("bins")).alias("bin"), "lo", "hi", "gram", "last"
    )
    return Sampler(contexts.select("ctx", "total", bins), guide, grams)


def _bin_of(x: Column, total: Column, bins: Column) -> Column:
    return F.floor(x * bins / total).cast("long")


def _reached(total: Column, bins: Column) -> Column:
    """One row per bin that the weights from ``lo`` up to ``hi`` reach into."""
    return F.explode(F.sequence(_bin_of(F.col("lo"), total, bins), _bin_of(F.col("hi") - 1, total, bins)))


def draw_next(lm: LanguageModel, rows: DataFrame, key: str, seed: int, step: int) -> DataFrame:
    """One draw per row: a gram after ``ctx`` by weight, or any gram uniformly where ``ctx`` is new.

    Adds ``gram`` and ``last``. The draw depends only on (seed, key, step). Only the grams of the contexts that are
    asked for are ordered, and of the whole model only the buckets that a uniform draw falls into.
    """
    return _drawn(lm, sampler(lm, rows), rows, key, seed, step, lambda: _slots(lm, F.lit(1), _counted(lm)[0]))


def _drawn(
    lm: LanguageModel, s: Sampler, rows: DataFrame, key: str, seed: int, step: int, slots: Callable[[], DataFrame]
) -> DataFrame:
    """``draw_next`` with the guide tables ``s``; ``slots`` gives those of a uniform draw."""
    keep = rows.columns
    size, total = _counted(lm)
    drawn = cut_lineage(lookup_join(rows, s.contexts, ["ctx"], ["total", "bins"], "total", [key], total=F.lit(float(total))))
    known = drawn.where(F.col("total").isNotNull()).withColumn(
        "_draw", draws.draw_below(F.col("total"), seed, F.col(key), F.lit(step))
    ).withColumn("_bin", _bin_of(F.col("_draw"), F.col("total"), F.col("bins")))
    guide = s.guide.withColumnRenamed("ctx", "_ctx")
    hit = (
        (F.col("ctx") == F.col("_ctx"))
        & (F.col("_bin") == F.col("bin"))
        & (F.col("_draw") >= F.col("lo"))
        & (F.col("_draw") < F.col("hi"))
    )
    known = known.join(guide, hit, "left").select(*keep, "gram", "last")
    new = drawn.where(F.col("total").isNull()).select(*keep)
    if new.isEmpty():
        return known
    return known.unionByName(_draw_any(lm, new, F.lit(1), size, key, seed, step, slots))


def _bucketed(lm: LanguageModel, weight: Column) -> DataFrame:
    """The grams with the bucket ``_b`` of their md5, which the model may hold already, and their weight ``_w``."""
    kept = lm.grams.withColumn("_b", _bucket(F.col("gram"))) if lm.marked is None else lm.marked
    return kept.select("_b", "gram", weight.cast("long").alias("_w"), *_parts_of(lm))


def _mark(ctx: Column) -> Column:
    """A number of 24 bits for a context."""
    return F.pmod(F.xxhash64(ctx), F.lit(1 << 24)).cast("int")


def _bucket(gram: Column) -> Column:
    return F.conv(F.substring(F.md5(gram), 1, 4), 16, 10).cast("int")


def _slots(lm: LanguageModel, weight: Column, total: int) -> DataFrame:
    """Where a draw below ``total`` falls among the weights of the 65,536 buckets of md5."""
    sums = _bucketed(lm, weight).groupBy("_b").agg(F.sum("_w").alias("_t"), F.count(F.lit(1)).alias("_c"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)  # one row per bucket
    sums = sums.withColumn("hi", F.sum("_t").over(upto)).withColumn("lo", F.col("hi") - F.col("_t"))
    return cut_lineage(sums.select("*", _reached(F.lit(total), F.lit(1 << 16)).alias("_slot")))


def _draw_any(
    lm: LanguageModel,
    rows: DataFrame,
    weight: Column,
    total: int,
    key: str,
    seed: int,
    step: int,
    slots: Callable[[], DataFrame] | None = None,
) -> DataFrame:
    """``rows`` with ``gram`` and ``last``: a draw from all grams in the order of their md5, by ``weight``, whose sum is
    ``total``. The weights of 65,536 buckets of md5 tell where a draw falls; only the grams of those buckets are ordered."""
    if not total:
        return rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("gram", "last")])
    grams = _bucketed(lm, weight)
    slots = _slots(lm, weight, total) if slots is None else slots()
    draw = draws.draw_below(F.lit(total), seed, F.col(key), F.lit(step))
    placed = rows.withColumn("_draw", draw).withColumn("_mine", _bin_of(F.col("_draw"), F.lit(total), F.lit(1 << 16)))
    inside = (F.col("_mine") == F.col("_slot")) & (F.col("_draw") >= F.col("lo")) & (F.col("_draw") < F.col("hi"))
    placed = placed.join(F.broadcast(slots), inside).select(
        *rows.columns, F.col("_b").alias("_in"), (F.col("_draw") - F.col("lo")).alias("_at"), "_t", "_c"
    )
    placed = cut_lineage(placed.withColumn("_fine", _bin_of(F.col("_at"), F.col("_t"), F.col("_c"))).drop("_t", "_c"))
    asked = F.broadcast(placed.select(F.col("_in").alias("_b")).distinct())
    near = grams.join(asked, "_b", "left_semi").repartition("_b").withColumn("_md5", F.md5("gram"))
    whole = Window.partitionBy("_b")
    order = whole.orderBy("_md5", "gram").rowsBetween(Window.unboundedPreceding, 0)
    near = _cut_again(lm, near).select(
        "_b", "gram", "last", "_w", F.sum("_w").over(order).alias("hi"),
        F.sum("_w").over(whole).alias("_t"), F.count(F.lit(1)).over(whole).alias("_c"),
    ).withColumn("lo", F.col("hi") - F.col("_w"))
    near = near.select("_b", "gram", "last", "lo", "hi", _reached(F.col("_t"), F.col("_c")).alias("bin"))
    hit = (
        (F.col("_in") == F.col("_b"))
        & (F.col("_fine") == F.col("bin"))
        & (F.col("_at") >= F.col("lo"))
        & (F.col("_at") < F.col("hi"))
    )
    if placed.count() <= ASKED_ROWS:
        # every place holds a gram, so no row is lost, and the buckets need not move again
        return near.join(F.broadcast(placed), hit).select(*rows.columns, "gram", "last")
    near = asked_only(near, placed.select(F.col("_in").alias("_b"), F.col("_fine").alias("bin")), ["_b", "bin"])
    return placed.join(near, hit, "left").select(*rows.columns, "gram", "last")


def last_context(lm: LanguageModel, text: Column) -> Column:
    """The last order-1 units of ``text`` as a context."""
    n = lm.order
    if n == 1:
        return F.lit("")
    if lm.chars:
        return F.right(text, F.lit(n - 1))
    units = T.split_each_white(text)
    return F.array_join(
        F.slice(units, F.greatest(F.size(units) - F.lit(n - 2), F.lit(1)), n - 1), " "
    )


def generate(
    lm: LanguageModel,
    seeds: DataFrame,
    length: int = 20,
    seed: int = 0,
    key: str = "seed_id",
    context: str = "context",
) -> DataFrame:
    """Extend every seed to ``length`` units. A null context starts from a gram drawn by weight; a
    longer context is cut to ``length``. Every step reads the model for the contexts it asks, which costs a scan but
    no shuffle of the model, and cuts the lineage of the seeds. What all steps need of md5 is made once, and what a step
    has written of the model goes with it."""

    def units(c: Column) -> Column:
        return N.characters(c) if lm.chars else T.split_each_white(c)

    rows = seeds.select(key, F.col(context).alias("_text"))
    empty = cut_lineage(rows.where(F.col("_text").isNull()))
    rows = rows.where(F.col("_text").isNotNull())
    if not empty.isEmpty():
        started = _draw_any(lm, empty, F.col("n"), _counted(lm)[1], key, seed, 0)
        rows = rows.unionByName(started.select(key, F.col("gram").alias("_text")))
    rows = cut_lineage(
        rows.select(key, "_text", last_context(lm, F.col("_text")).alias("ctx"), F.size(units(F.col("_text"))).alias("_size"))
    )
    smallest = rows.agg(F.min("_size")).first()[0]
    steps = 0 if smallest is None else max(0, length - smallest)
    if steps > 1:
        kept = lm.grams.select(
            "gram", "n", _bucket(F.col("gram")).alias("_b"), _mark(F.col("ctx")).alias("_c"), *_parts_of(lm)
        )
        lm = replace(lm, counted=_counted(lm), marked=written(kept, "marked"))
    slots = cache(lambda: _slots(lm, F.lit(1), _counted(lm)[0]))
    for step in range(1, steps + 1):
        open_rows = rows.where(F.col("_size") < length)
        s = sampler(lm, open_rows)
        drawn = _drawn(lm, s, open_rows, key, seed, step, slots)
        longer = drawn.select(
            key,
            F.concat("_text", F.lit(lm.sep), "last").alias("_text"),
            last_context(lm, F.col("gram")).alias("ctx"),
            (F.col("_size") + 1).alias("_size"),
        )
        rows = cut_lineage(rows.where(F.col("_size") >= length).unionByName(longer))
        dropped(s.grams)
    if steps > 1:
        dropped(lm.marked)
    cut = F.array_join(F.slice(units(F.col("_text")), 1, length), lm.sep)
    return rows.select(key, cut.alias("generated"))
