r"""Phrase collocations mined with Rabin-Karp fingerprints.

A text (A-Z lower-cased) is cut into pieces at ``.,;:!?`` and line breaks and a piece into words at blanks and tabs.
Per language, a phrase of 2 to 3 words that occurs ``least`` times or more is a candidate; cut after its first k
words, its score is floor(10^6 a^2 / (l r)), a, l and r being the occurrences of the phrase and of both parts, and the
lowest cut counts. A candidate that stands in a longer one with at least half its occurrences is dropped.

1. Tasks read blocks of whole texts. Prefix polynomials over the bytes give the fingerprint of every word, prefix
   polynomials over those give the fingerprint of every n-gram (numpy, modulo 2^64, two independent bases). A block
   leaves as one row per distinct n-gram: its 64-bit key, its count and an occurrence pointer, which is 32 bits of
   the second fingerprint and 32 bits that name the document.
2. A shuffle sums the counts per key and keeps the least and the greatest pointer. Phrases of three words are
   fingerprinted in a second pass, and only where both halves are frequent (a bitmap of 16 bits a key, at most
   2^28 bits; beyond its bound it lets more n-grams through and never loses one).
3. Only frequent keys get a text. Their pointers meet the documents, whose words the fingerprints are recomputed from.
4. A key whose occurrences differ in the second fingerprint is a collision: its phrases are counted anew by their
   text. The others agree in 94 bits.
5. Counts of the parts are equality joins on the text, those of frequent words by broadcast (``lookup_join``).
   Products are exact decimals.

Defined results: a null text is empty; a null language counts as ``und``; repeated rows each count; ties of equal
score and count go by the bytes of the phrase, ties of a cut to the smaller k; an empty table gives an empty result.
Only the id, the language and the text are read; the id only names documents and may be null or repeated. Words are
bytes between separators, so any control or non-ASCII character is part of a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import shingles as S
from quillspark.llm.common import parts, plain, stored
from quillspark.operators.scale import lookup_join

LEAST = 10
LONGEST = 3
TOP = 2000
UNKNOWN = "und"
BLOCK_BYTES = 2 << 20
MAX_BITS = 28
PARTS = 64

_STEP = 1 << 16
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so that they have inverses modulo 2^64
_BYTES = np.random.default_rng(17).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_DELIMITER = re.compile(rb"[.,;:!?\x0A-\x0D]")
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2

_ROW = "key long, n long, ptr long"


class Polynomial:
    """Powers of a base and of its inverse modulo 2^64, for prefix polynomials of any length."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _table(self, base: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        low_part, high_part = self.tables.get(base, (None, np.zeros(0, np.uint64)))
        if low_part is None or len(high_part) < high:
            start = np.uint64(1)
            low_part = np.cumprod(np.concatenate(([start], np.full(_STEP - 1, base, np.uint64))))
            step = np.uint64(pow(base, _STEP, 1 << 64))
            high_part = np.cumprod(np.concatenate(([start], np.full(max(high, 64), step, np.uint64))))
            self.tables[base] = low_part, high_part
        return low_part, high_part

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Sums of values[j] * base**j over the first i values, for every i."""
        out = np.zeros(len(values) + 1, np.uint64)
        for at in range(0, len(values), _STEP):
            low, high = self._table(self.base, at // _STEP + 1)
            part = values[at : at + _STEP]
            out[at + 1 : at + 1 + len(part)] = part * (low[: len(part)] * high[at // _STEP])
        return np.cumsum(out, out=out)

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprints of the spans, the same wherever a span stands."""
        low, high = self._table(self.inverse, len(prefix) // _STEP + 1)
        return (prefix[ends] - prefix[starts]) * (low[starts & (_STEP - 1)] * high[starts >> 16])


_POLYNOMIALS = tuple(Polynomial(b) for b in _BASES)


class Block:
    """The words and n-gram fingerprints of a block of texts; ``data`` has a line break between texts."""

    def __init__(self, data: bytes, text_ends: np.ndarray) -> None:
        self.data = data.lower()  # bytes: A-Z only
        raw = np.frombuffer(self.data, np.uint8)
        kind = _KIND[raw]
        inside = np.concatenate(([False], kind == 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        self.text = np.searchsorted(text_ends, self.starts, side="right")
        self.words = []
        for polynomial, values in zip(_POLYNOMIALS, _BYTES, strict=True):
            prefix = polynomial.prefix(values[raw])
            words = S.mixed(polynomial.spans(prefix, self.starts, self.ends))
            self.words.append(polynomial.prefix(words))

    def grams(self, size: int, langs: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, key and check of every n-gram of ``size`` words that lies in one piece."""
        at = np.arange(max(len(self.starts) - size + 1, 0))
        at = at[self.piece[at] == self.piece[at + size - 1]] if len(at) else at
        lang = langs[self.text[at]]
        found = [
            S.mixed(p.spans(w, at, at + size) + lang * np.uint64(size + 3))
            for p, w in zip(_POLYNOMIALS, self.words, strict=True)
        ]
        return at, found[0] & mask | np.uint64(size), found[1] >> np.uint64(32)

    def phrase(self, at: int, size: int) -> str:
        spans = zip(self.starts[at : at + size].tolist(), self.ends[at : at + size].tolist(), strict=True)
        return b" ".join(self.data[a:b] for a, b in spans).decode()


def _cut(text: bytes, most: int) -> Iterator[bytes]:
    """``text`` in parts of at most ``most`` bytes that end at a delimiter; a longer piece stays whole."""
    at = 0
    while len(text) - at > most:
        last = max(text.rfind(bytes([d]), at, at + most) for d in np.flatnonzero(_KIND == 2).tolist())
        if last < 0:
            found = _DELIMITER.search(text, at + most)
            if not found:
                break
            last = found.start()
        yield text[at : last + 1]
        at = last + 1
    yield text[at:]


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """Blocks of whole texts with the language key and the tag of each text."""
    held: list[bytes] = []
    langs: list[int] = []
    tags: list[int] = []
    size = 0

    def block() -> tuple[Block, np.ndarray, np.ndarray]:
        ends = np.cumsum([len(p) + 1 for p in held])
        return (
            Block(b"\n".join(held) + b"\n", ends),
            np.array(langs, np.int64).view(np.uint64),
            np.array(tags, np.uint64),
        )

    for batch in parts(batches, most=most):
        rows = zip(batch.column("text"), batch.column("lang_key").to_pylist(), batch.column("tag").to_pylist(), strict=True)
        for text, lang, tag in rows:
            for part in _cut(text.as_py().encode(), most):
                held.append(part)
                langs.append(lang)
                tags.append(tag)
                size += len(part) + 1
                if size >= most:
                    yield block()
                    held, langs, tags, size = [], [], [], 0
    if held:
        yield block()


def _mask(bits: int) -> np.uint64:
    """Leading ``bits`` of a key; its last two bits hold the number of words."""
    return np.uint64(((1 << bits) - 1) << (64 - bits) & ~3)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _counting(sizes: tuple[int, ...], totals: bool, mask: np.uint64, halves, block_bytes: int):
    """Task function: (key, n, ptr) per distinct n-gram of a block; with ``halves`` (a broadcast bitmap) only n-grams
    both of whose halves may be in it. ``totals`` adds the number of words per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, langs, tags in _blocks(batches, block_bytes):
            if totals:
                kinds, which = np.unique(langs, return_inverse=True)
                n = np.bincount(which[block.text], minlength=len(kinds)).astype(np.int64)
                keys = kinds & ~np.uint64(3)
                yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(n), pa.array(np.zeros(len(n), np.int64))], names=["key", "n", "ptr"])
            for size in sizes:
                at, keys, checks = block.grams(size, langs, mask)
                if halves is not None:
                    shorter, held, _ = block.grams(size - 1, langs, mask)
                    fits = np.zeros(len(block.starts) + 1, bool)
                    fits[shorter] = S.holds(halves.value, held)
                    keep = fits[at] & fits[at + 1]
                    at, keys, checks = at[keep], keys[keep], checks[keep]
                if not len(at):
                    continue
                order = np.argsort(keys)
                keys, checks = keys[order], checks[order]
                first = np.flatnonzero(
                    np.concatenate(([True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])))
                )
                n = np.diff(np.append(first, len(keys)))
                pointers = checks[first] << np.uint64(32) | tags[block.text[at[order[first]]]]
                yield pa.RecordBatch.from_arrays(
                    [_signed(keys[first]), pa.array(n.astype(np.int64)), _signed(pointers)], names=["key", "n", "ptr"]
                )

    return run


def _summed(rows: DataFrame, least: int) -> DataFrame:
    # the blocks have summed already: another sum before the shuffle would only hold memory
    return (
        rows.repartition("key")
        .groupBy("key")
        .agg(F.sum("n").alias("n"), F.min("ptr").alias("lo"), F.max("ptr").alias("hi"))
        .where((F.col("n") >= least) | (F.col("key").bitwiseAND(F.lit(3)) == 0))
    )


def _sources(docs: DataFrame, text: str, lang: str, id: str) -> DataFrame:
    """(text, lang, lang_key, tag): ``tag`` names the document by 32 bits."""
    return docs.select(plain(F.col(text)).alias("text"), F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(id).alias("id")).select(
        "text",
        "lang",
        F.xxhash64("lang").alias("lang_key"),
        F.xxhash64("id", "text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag"),
    )


def _named(mask: np.uint64):
    """Task function: the phrases of the wanted keys of a document, one per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = []
            columns = [batch.column(c).to_pylist() for c in ("lang", "lang_key")]
            for body, wanted, name, lang in zip(batch.column("text"), batch.column("wanted"), *columns, strict=True):
                data = body.as_py().encode() + b"\n"
                block = Block(data, np.array([len(data)]))
                want = np.unique(wanted.values.to_numpy(zero_copy_only=False).view(np.uint64))
                for size in range(1, LONGEST + 1):
                    at, keys, _ = block.grams(size, np.array([lang], np.int64).view(np.uint64), mask)
                    place = np.minimum(np.searchsorted(want, keys), len(want) - 1)
                    hit = np.flatnonzero(want[place] == keys)
                    keys, first = np.unique(keys[hit], return_index=True)
                    spots = zip(keys.view(np.int64).tolist(), at[hit[first]].tolist(), strict=True)
                    found += [(k, name, block.phrase(a, size)) for k, a in spots]
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                names=["key", "lang", "phrase"],
            )

    return run


def _recounted(mask: np.uint64, known, block_bytes: int):
    """Task function: every n-gram by its text whose key may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, langs, _ in _blocks(batches, block_bytes):
            for size in range(1, LONGEST + 1):
                at, keys, _ = block.grams(size, langs, mask)
                hit = np.flatnonzero(S.holds(known.value, keys))
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(keys[hit]), _signed(langs[block.text[at[hit]]]),
                        pa.array([block.phrase(a, size) for a in at[hit].tolist()], pa.string()),
                    ],
                    names=["key", "lang_key", "phrase"],
                )

    return run


def _bits(count: int) -> int:
    return min(max(16, (16 * count).bit_length()), MAX_BITS)


def phrase_counts(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    id: str = "doc_id",
    least: int = LEAST,
    bits: int = 64,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of every phrase of up to ``LONGEST`` words that occurs ``least`` times or more, and
    (lang, n) with all words of a language. ``bits`` shortens the keys, which makes collisions."""
    spark = docs.sparkSession
    sources, mask = _sources(docs, text, lang, id), _mask(bits)
    inputs = sources.select("text", "lang_key", "tag")
    counted = [stored(_summed(inputs.mapInArrow(_counting((1, 2), True, mask, None, block_bytes), _ROW), least), "grams")]
    for size in range(3, LONGEST + 1):
        shorter = counted[-1].where(F.col("key").bitwiseAND(F.lit(3)) == size - 1).select(F.col("key").alias("hash"))
        halves = spark.sparkContext.broadcast(S.bitmap(shorter, _bits(shorter.count())))
        rows = inputs.mapInArrow(_counting((size,), False, mask, halves, block_bytes), _ROW)
        counted.append(stored(_summed(rows, least), "grams"))
        halves.destroy()
    frequent = counted[0]
    for more in counted[1:]:
        frequent = frequent.unionByName(more)
    names = sources.select("lang", "lang_key").distinct()
    totals = frequent.where(F.col("key").bitwiseAND(F.lit(3)) == 0).select("key", "n")
    names_key = F.col("lang_key").bitwiseAND(F.lit(~3))
    totals = stored(names.withColumn("key", names_key).join(totals, "key").select("lang", "n"), "totals")
    frequent = frequent.where(F.col("key").bitwiseAND(F.lit(3)) > 0)
    same = F.shiftrightunsigned("lo", 32) == F.shiftrightunsigned("hi", 32)
    # at most the n-grams of the documents of one tag
    wanted = (
        frequent.where(same)
        .groupBy(F.col("lo").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag"))
        .agg(F.collect_list("key").alias("wanted"))
    )
    texts = sources.join(wanted, "tag").select("text", "lang", "lang_key", "wanted")
    named = texts.mapInArrow(_named(mask), "key long, lang string, phrase string")
    named = named.groupBy("key").agg(F.min(F.struct("lang", "phrase")).alias("is"))
    counts = named.join(frequent.select("key", "n"), "key").select("is.lang", "is.phrase", "n")
    torn = stored(frequent.where(~same).select("key"), "collisions")
    if not torn.isEmpty():
        known = spark.sparkContext.broadcast(S.bitmap(torn.select(F.col("key").alias("hash")), _bits(torn.count())))
        again = inputs.mapInArrow(_recounted(mask, known, block_bytes), "key long, lang_key long, phrase string")
        again = again.join(torn, "key", "left_semi").groupBy("lang_key", "phrase").agg(F.count(F.lit(1)).alias("n"))
        again = again.where(F.col("n") >= least).join(names, "lang_key").select("lang", "phrase", "n")
        counts = counts.unionByName(again)
    words = F.size(F.split("phrase", " ")).cast("int")
    return stored(counts.select("lang", "phrase", words.alias("words"), F.col("n").alias("f")), "phrases"), totals


def _part(words: Column, first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    id: str = "doc_id",
    least: int = LEAST,
    top: int = TOP,
    share: int = 50,
    **params,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of every language."""
    counts, totals = phrase_counts(docs, text, lang, id, least, **params)
    known_parts = counts.select("lang", F.col("phrase").alias("part"), "f")
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    own = F.split("phrase", " ")
    cuts = phrases.select("*", own.alias("own"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "words", "a", "k", _part(F.col("own"), F.lit(1), F.col("k")).alias("part"),
        _part(F.col("own"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"),
    )
    total = F.lit(float(totals.agg(F.sum("n")).first()[0] or 0))
    for side, name in (("part", "l"), ("rest", "r")):
        known = known_parts.select("lang", F.col("part").alias(side), F.col("f").alias(name))
        cuts = lookup_join(cuts, known.withColumn("w", F.col(name)), ["lang", side], [name], "w", ["phrase", "k"], total=total)

    ratio = F.expr(
        "(cast(1000000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(a as decimal(38,0)))"
        " div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))"
    )
    lowest = F.min(F.struct(ratio.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(lowest)
    longer = phrases.where(F.col("words") > 2).select("lang", F.col("a").alias("f"), own.alias("own"), "words")
    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.col("words") - size + 1), lambda i: _part(F.col("own"), i, size)
            ),
        )
    )
    covers = longer.select("lang", "f", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = scored.join(covers, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * share)
    )
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    near = rows.withColumn("salt", salt).withColumn("near", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    near = near.where(F.col("near") <= top)  # at most ``top`` rows of each part of a language meet below
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return (
        ranked.where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
