"""Quality rules: text statistics and lines that many documents of one host share.

Native expressions only. The statistics of a text are array expressions inside its row; line frequencies
are two aggregations over 64-bit line keys.

Line rule. A line is normalised (lower case, blanks collapsed, trimmed) and hashed with its host. A line
that stands in more than ``max(least_docs, share * documents of the host)`` distinct texts of that host is
frequent: it goes from all of them except the text with the smallest id, as only the repetition is of no use. A
text that loses more than ``loss`` of its words is depleted and rejected; ``clean`` takes the frequent lines out of
the others. Exact copies of a text count once and get the same verdict.

Defined results: a null text is an empty one (base_failed); a null host is a host of its own; a null id
counts as the largest; texts that share the smallest id all keep the line; repeated rows are each judged;
an empty table gives an empty result. Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.let import let
from quillspark.llm.common import BLANK, LAST, NO_WORD, content_key, plain, small, stored, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
LEAST_DOCS = 10
SHARE = 0.05
LOSS = 0.5
#: The lines of at most so many texts are sent to every task.
GONE_ROWS = 100_000


def _repeated(w: Column) -> Column:
    """Words covered by the 3-word windows that occur at least twice in the array ``w``."""
    windows = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )

    def places(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            keyed,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda p, k: ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == p["h"]))
                        | (F.get(s, k + 1)["h"] == p["h"]),
                    ),
                    lambda p: p["i"],
                )
            ),
        )

    def covered(d: Column) -> Column:
        steps = F.transform(
            d, lambda p, k: F.coalesce(F.least(F.lit(3), F.get(d, k + 1) - p), F.lit(3))
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(places(h), covered)
        ),
    )


def signals(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = plain(text)
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(NO_WORD))
    counts = let(
        words(text), lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("repeated"))
    )

    def fields(c: Column) -> Column:
        return F.struct(
            c["n"].cast("long").alias("n_words"),
            F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            c["repeated"].cast("long").alias("n_repeat_words"),
            ((c["n"] < 50) | (100 * c["repeated"] > 50 * c["n"])).alias("base_failed"),
        )

    return let(counts, fields)


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), BLANK, " "))


def _line(host: Column, line: Column) -> Column:
    return F.xxhash64(host, host.isNull(), normalised(line))


def losses(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    id: str = "doc_id",
    least_docs: int = LEAST_DOCS,
    share: float = SHARE,
    loss: float = LOSS,
) -> DataFrame:
    """(content, gone, depleted): the keys of the frequent lines that a text loses, and whether they make up the
    text for the most part. ``content`` is a key of host and text; texts that lose nothing have no row."""
    lines = F.transform(
        F.filter(F.split(plain(F.col(text)), "\n"), lambda x: ~x.rlike(NO_WORD)),
        lambda x: F.struct(
            _line(F.col(host), x).alias("line"),
            F.size(words(x)).alias("n"),
        ),
    )
    contents = (
        docs.select(
            content_key(F.col(host), F.col(text)).alias("content"),
            content_key(F.col(host)).alias("host"),
            F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("id"),
            lines.alias("lines"),
        )
        .groupBy("content", "host")
        .agg(F.min("id").alias("id"), F.first("lines").alias("lines"))
    )
    contents = stored(contents, "lines")
    limits = contents.groupBy("host").agg(
        F.greatest(F.lit(float(least_docs)), F.lit(share) * F.count(F.lit(1))).alias("limit")
    )
    uses = (
        contents.select("content", "host", "id", F.inline("lines"))
        .groupBy("content", "host", "id", "line")
        .agg(F.sum("n").alias("n"))
    )
    frequent = (
        uses.groupBy("line", "host")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("id").alias("first"))
        .where(F.col("texts") > least_docs)
        .join(limits, "host")
        .where(F.col("texts") > F.col("limit"))
        .select("line", "first")
    )
    total = F.aggregate("lines", F.lit(0), lambda a, x: a + x["n"])
    lost = (
        uses.join(frequent, "line")
        .where(F.col("id") != F.col("first"))
        .groupBy("content")
        .agg(F.sum("n").alias("lost"), F.collect_list("line").alias("gone"))
    )
    return (
        contents.select("content", total.alias("total"))
        .join(lost, "content")
        .select("content", "gone", (F.col("lost") > loss * F.col("total")).alias("depleted"))
    )


def _judged(docs: DataFrame, keep: list[Column], lost: DataFrame, text: str, host: str) -> DataFrame:
    gone = small(stored(lost.where("depleted").select(F.col("content").alias("__gone")), "depleted"))
    rows = docs.select(
        *keep,
        signals(F.col(text)).alias("__signals"),
        content_key(F.col(host), F.col(text)).alias("__content"),
    )
    return rows.join(gone, F.col("__content") == F.col("__gone"), "left").withColumn(
        "__kept", ~F.col("__signals.base_failed") & F.col("__gone").isNull()
    )


def judge(
    docs: DataFrame, text: str = "text", host: str = "source", id: str = "doc_id", **limits
) -> DataFrame:
    """One row per document: id, the statistics, base_failed and kept."""
    rows = _judged(docs, [F.col(id).alias("__id")], losses(docs, text, host, id, **limits), text, host)
    return rows.select(F.col("__id").alias(id), "__signals.*", F.col("__kept").alias("kept"))


def keep_good(
    docs: DataFrame, text: str = "text", host: str = "source", id: str = "doc_id", **limits
) -> DataFrame:
    """The rows of ``docs`` that pass, whole and unchanged."""
    rows = _judged(docs, [F.struct("*").alias("__row")], losses(docs, text, host, id, **limits), text, host)
    return rows.where("__kept").select("__row.*")


def clean(docs: DataFrame, text: str = "text", host: str = "source", id: str = "doc_id", **limits) -> DataFrame:
    """The rows of ``docs`` that pass, their texts without the frequent lines; the other lines stay as they are.
    Further columns are not recomputed."""
    lost = stored(losses(docs, text, host, id, **limits), "losses")
    keep = [F.struct("*").alias("__row"), F.col(host).alias("__host"), F.col(text).alias("__text")]
    rows = _judged(docs, keep, lost, text, host).where("__kept")
    lines = small(lost.where("not depleted").select(F.col("content").alias("__of"), "gone"), GONE_ROWS)
    rows = rows.join(lines.withColumnRenamed("gone", "__lines"), F.col("__content") == F.col("__of"), "left")
    left = F.filter(
        F.split(F.col("__text"), "\n"),
        lambda x: x.rlike(NO_WORD) | ~F.array_contains(F.col("__lines"), _line(F.col("__host"), x)),
    )
    cut = F.when(F.col("__lines").isNull(), F.col("__text")).otherwise(F.array_join(left, "\n"))
    return rows.select(F.col("__row").withField(f"`{text}`", cut).alias("__row")).select("__row.*")
