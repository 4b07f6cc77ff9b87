"""Hand-made features of posts: content counters, time, corpus counters, scaling, encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import draws
from quillspark.functions import text as T
from quillspark.functions.rows import each, each_at
from quillspark.operators.scale import global_index, lookup_join
from quillspark.sources import constants as K

SMALL_TABLE = 200_000


def corpus_counters(df: DataFrame, text: str = "text") -> DataFrame:
    """Hash tags, mentions, links and capitals over all space-separated tokens; a token counts for
    the first of these it is."""
    token = F.col("token")
    is_hash, is_via = F.startswith(token, F.lit("#")), F.startswith(token, F.lit("@"))
    is_url = F.startswith(token, F.lit("http"))
    plain = ~(is_hash | is_via | is_url)
    tokens = each(df, T.split_space(F.col(text).cast("string")), "token")
    return tokens.agg(
        F.count_if(is_hash).alias("i_hash"),
        F.count_if(is_via).alias("i_via"),
        F.count_if(is_url).alias("i_url"),
        F.coalesce(
            F.sum(F.when(plain, T.count_matches(token, "[A-Z]"))), F.lit(0)
        ).alias("i_capital"),
    )


def content_features(
    df: DataFrame,
    text: str = "text",
    stopwords: Sequence[str] = (),
    mentions: Mapping[str, tuple[Sequence[str], str]] = K.MENTIONS,
) -> DataFrame:
    """Content counters of each row, in one pass over its space-separated tokens.

    A token that starts with a quote or period gives that character as content of
    its own. Mentions and hash tags are counted and become content, links are only
    counted, other tokens also count capitals, stopwords and name parts.
    """
    stop = list(stopwords)

    def look(token: Column) -> Column:
        lead = F.substring(token, 1, 1)
        has_lead = lead.isin('"', ".")
        body = F.when(has_lead, F.substring(token, F.lit(2), F.length(token))).otherwise(token)
        kind = (
            F.when(F.startswith(body, F.lit("@")), "tag")
            .when(F.startswith(body, F.lit("#")), "hash")
            .when(F.startswith(body, F.lit("http")), "url")
            .otherwise("plain")
        )
        none = F.array().cast("array<string>")
        return F.struct(
            kind.alias("kind"),
            body.alias("body"),
            F.when(has_lead, F.array(lead)).otherwise(none).alias("lead"),
            F.when(kind == "url", none)
            .when(T.is_plain(body), F.array(F.lower(body)))
            .otherwise(T.split_space(T.norm_text(body)))
            .alias("pieces"),
        )

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("_t", lambda t: t["kind"] == kind))

    def piece_sum(value) -> Column:
        plain = F.filter("_t", lambda t: t["kind"] == "plain")
        return F.size(F.filter(F.flatten(F.transform(plain, lambda t: t["pieces"])), value))

    rows = df.withColumn("_t", F.transform(T.split_space(F.col(text)), look))
    content = F.flatten(F.transform("_t", lambda t: F.concat(t["lead"], t["pieces"])))
    rows = rows.withColumn("_content", content).withColumn(
        "features_group", F.array_join("_content", " ")
    )
    plain_text = F.array_join(
        F.transform(F.filter("_t", lambda t: t["kind"] == "plain"), lambda t: t["body"]), " "
    )
    punc = T.count_matches(F.col("features_group"), "[!-?]")
    columns = {
        "i_hash": of_kind("hash"),
        "i_url": of_kind("url"),
        "i_tag": of_kind("tag"),
        "i_capital": T.count_matches(plain_text, "[A-Z]"),
        "i_punc": punc,
        "i_terms": F.size("_content") - punc,
        "i_stopword": piece_sum(lambda w: w.isin(*stop)) if stop else F.lit(0),
    }

    def mention_count(parts: Sequence[str], handle: str) -> Column:
        def named(w: Column) -> Column:
            return reduce(lambda a, b: a | b, [F.contains(w, F.lit(p)) for p in parts])

        exact = F.filter("_t", lambda t: (t["kind"] == "tag") & (t["body"] == handle))
        return piece_sum(named) + F.size(exact)

    columns |= {name: mention_count(*rule) for name, rule in mentions.items()}
    absent = F.col(text).isNull()
    rows = rows.select(
        *df.columns,
        "features_group",
        *[F.when(~absent, c).alias(n) for n, c in columns.items()],
    )
    divisor = F.when(F.col("i_terms") == 0, 1).otherwise(F.col("i_terms"))
    return rows.withColumn("puncs", F.col("i_punc") / divisor)


def time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour and day of week, Monday 0."""
    return df.withColumns({"i_hours": F.hour(ts), "i_days": F.weekday(ts)})


def timestamp_parts(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "weekday": F.weekday(ts),
            "year": F.year(ts),
            "month": F.month(ts),
        }
    )


def extract_features(df: DataFrame, text: str = "text", ts: str = "ts", **options) -> DataFrame:
    """Content and time features appended to the row."""
    return time_features(content_features(df, text, **options), ts)


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the minimum and maximum of each column."""
    return df.agg(
        *[F.min(c).cast("double").alias(f"min_{c}") for c in columns],
        *[F.max(c).cast("double").alias(f"max_{c}") for c in columns],
    )


def apply_minmax(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns on the fitted range: train values in [0, 1], others unclipped, constants 0."""
    bounds = fitted.first()
    out = {}
    for c in columns:
        low, high = bounds[f"min_{c}"], bounds[f"max_{c}"]
        if low is not None:
            span = 1.0 if high == low else high - low
            out[c] = (F.col(c).cast("double") - F.lit(low)) / F.lit(span)
    return df.withColumns(out)


def vocabulary_index(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(term, idx, n): terms numbered from 2 by first appearance, after padding 0 and unknown 1."""
    seen = each_at(df, tokens, "_pos", "term", F.col(key).alias("_key"))
    first = seen.groupBy("term").agg(
        F.min(F.struct("_key", "_pos")).alias("_first"), F.count(F.lit(1)).alias("n")
    )
    numbered = global_index(first, "_first", out="_at")
    return numbered.select("term", (F.col("_at") + 2).alias("idx"), "n")


def encode_sequences(
    df: DataFrame, key: str, tokens: Column, vocabulary: DataFrame, width: int = 70
) -> DataFrame:
    """(key, encoded struct(ids, length)): term ids cut or zero-padded to ``width``, 1 for unknown."""
    rows = df.select(key, F.slice(tokens, 1, width).alias("_tokens"))
    long = rows.select(key, F.posexplode_outer("_tokens").alias("_pos", "term"))
    looked = lookup_join(long, vocabulary, ["term"], ["idx"], "n", [key, "_pos"])
    # at most ``width`` ids per row
    ids = F.transform(
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("term").isNotNull(),
                    F.struct("_pos", F.coalesce("idx", F.lit(1)).cast("int").alias("idx")),
                )
            )
        ),
        lambda s: s["idx"],
    )
    grouped = looked.groupBy(key).agg(ids.alias("_ids"))
    padded = F.slice(F.concat("_ids", F.array_repeat(F.lit(0), width)), 1, width)
    return grouped.select(
        key, F.struct(padded.alias("ids"), F.size("_ids").alias("length")).alias("encoded")
    )


def augment_synonyms(
    df: DataFrame, key: str, synonyms: DataFrame, rate: float = 0.1, seed: int = 0, text: str = "text"
) -> DataFrame:
    """Replace a seeded share of the tokens that have synonyms by one of them.

    ``synonyms`` is (term, synonym). Each term's synonyms sit in one sorted array, so
    a token meets one row whatever its frequency.
    """
    table = synonyms.groupBy("term").agg(
        F.array_sort(F.collect_set("synonym")).alias("choices")
    )
    long = df.select(key, F.posexplode_outer(T.split_space(F.col(text))).alias("_pos", "term"))
    if table.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE:
        looked = long.join(F.broadcast(table), "term", "left")
    else:
        uses = long.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
        weighted = table.join(uses, "term")
        looked = lookup_join(long, weighted, ["term"], ["choices"], "uses", [key, "_pos"])
    threshold = int(rate * (1 << 32))
    chosen = (draws.draw32(f"{seed}:keep", F.col(key), F.col("_pos")) < threshold) & F.col(
        "choices"
    ).isNotNull()
    pick = F.get(
        "choices",
        F.pmod(draws.draw32(f"{seed}:pick", F.col(key), F.col("_pos")), F.size("choices")).cast("int"),
    )
    tokens = looked.select(
        key, "_pos", F.when(chosen, pick).otherwise(F.col("term")).alias("_token"),
        F.when(chosen, 1).otherwise(0).alias("_changed"),
    )
    # the tokens of one row of text
    ordered = F.array_sort(
        F.collect_list(F.when(F.col("_token").isNotNull(), F.struct("_pos", "_token")))
    )
    return tokens.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda s: s["_token"]), " ").alias("augmented"),
        F.sum("_changed").alias("replaced"),
    )
