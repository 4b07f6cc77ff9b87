"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

1. Every benchmark item gets a 64-bit SimHash of its word shingles, weighted by how often each occurs.
2. Every document is read window by window, a window being as many words as some item has. A document of fewer
   words than an item, but enough to reach the similarity, is one window for it as a whole. A window can only reach the similarity if that share of its shingles occurs in items of its length; two bitmaps of
   fixed size over the items' shingles pass every such window on and few others. Only these are hashed.
3. Distinct (length, fingerprint) pairs meet the items on radius + 1 blocks of bits: two fingerprints that
   differ in at most ``radius`` bits agree on a block, so no pair within the radius is missed.
4. For the pairs within the radius the exact weighted-shingle similarity of the words decides.

Defined results: null or wordless texts and items match nothing; an item of fewer words than a shingle is
one shingle; equal items and repeated rows match alike; ties of the best window go to the first; an empty
table gives an empty result. Only the ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import shingles as S
from quillspark.llm.common import content_key, parts, small, stored

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BITMAP_BITS = 23

_ITEM = "item long, text string, n_words int, fp long, hashes array<long>"
_WINDOW = "id long, content long, start int, n_words int, held int, fp long, text string"


def simhash(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    chosen = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little")
    return int.from_bytes(chosen.tobytes(), "little", signed=True)


def _of_length(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """Shingle hashes that are specific to items of one length."""
    return S.mixed(hashes ^ np.uint64(n_words * 0x9E3779B97F4A7C15 % (1 << 64)))


def items(benchmark: DataFrame, text: str, id: str, shingle: int) -> DataFrame:
    """One row per item with words: its fingerprint and shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, body in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (body or "").lower().encode()
                starts, ends = S.word_spans(data)
                if len(starts):
                    hashes = S.shingle_hashes(S.word_hashes(data, starts, ends), min(shingle, len(starts)))
                    rows.append((item, data.decode(), len(starts), simhash(hashes), hashes.view(np.int64).tolist()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["item", "text", "n_words", "fp", "hashes"],
            )

    rows = benchmark.select(F.col(id).cast("long").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _ITEM)


def _found(data: bytes, lengths: list[int], known: np.ndarray, sized: np.ndarray, shingle: int, least: float):
    """(first word, words of the item, words, fingerprint, text) of the windows that may match an item."""
    starts, ends = S.word_spans(data)
    words = S.word_hashes(data, starts, ends)
    whole = S.shingle_hashes(words, shingle)
    near = np.concatenate(([0], np.cumsum(S.holds(known, whole))))
    if lengths and near[-1] < least * (max(lengths[0], shingle) - shingle + 1):
        lengths = [n for n in lengths if n < shingle]
    for n in lengths:
        size = min(shingle, n)
        per = n - size + 1
        need = int(np.ceil(least * per - 1e-9))
        if len(words) < n:
            # all shingles of both are at most so many that the common ones make up the similarity
            need = int(np.ceil(least * (len(whole) + per) / (1 + least) - 1e-9))
            if size == shingle and near[-1] >= need and np.count_nonzero(S.holds(sized, _of_length(whole, n))) >= need:
                yield 0, n, len(words), simhash(whole), data[starts[0] : ends[-1]].decode()
            continue
        if size == shingle:
            at = np.flatnonzero(near[per:] - near[:-per] >= need)
            hashes = whole
        else:
            hashes = S.shingle_hashes(words, size)
            at = np.flatnonzero(S.holds(known, hashes))
        for a in at.tolist():
            own = hashes[a : a + per]
            if np.count_nonzero(S.holds(sized, _of_length(own, n))) >= need:
                yield a, n, n, simhash(own), data[starts[a] : ends[a + n - 1]].decode()


def windows(
    docs: DataFrame, bench: DataFrame, text: str, id: str, shingle: int, least: float, bits: int
) -> DataFrame:
    """Windows of the documents that may be as similar as ``least`` to an item of their length."""
    spark = docs.sparkSession
    lengths = sorted(r[0] for r in bench.select("n_words").distinct().collect())
    exploded = bench.select("n_words", F.explode("hashes").alias("hash"))

    def run_sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            step = batch.column("n_words").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            yield pa.RecordBatch.from_arrays([pa.array(S.mixed(hashes ^ step).view(np.int64))], names=["hash"])

    tables = spark.sparkContext.broadcast(
        (S.bitmap(exploded, bits), S.bitmap(exploded.mapInArrow(run_sized, "hash long"), bits))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sized = tables.value
        for batch in parts(batches):
            rows = []
            for i, body in enumerate(batch.column("text")):
                data = (body.as_py() or "").lower().encode()
                rows += [(i, *w) for w in _found(data, lengths, known, sized, shingle, least)]
            place, start, n, held, fp, part = list(zip(*rows, strict=True)) or [()] * 6
            place = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(place), batch.column("content").take(place), pa.array(start, pa.int32()),
                    pa.array(n, pa.int32()), pa.array(held, pa.int32()), pa.array(fp, pa.int64()), pa.array(part, pa.string()),
                ],
                names=["id", "content", "start", "n_words", "held", "fp", "text"],
            )

    rows = docs.select(
        F.col(id).cast("long").alias("id"), content_key(F.col(text)).alias("content"), F.col(text).alias("text")
    )
    found = stored(rows.mapInArrow(run, _WINDOW), "windows", batch="8m")
    tables.destroy()
    return found


def _block_keys(radius: int) -> F.Column:
    """One (block, bits) struct per block; radius + 1 blocks cover the 64 bits."""
    cuts = np.array_split(np.arange(64), radius + 1)
    masks = [sum(1 << int(b) for b in c) for c in cuts]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
            for i, m in enumerate(signed)
        ]
    )


def within_radius(prints: DataFrame, bench: DataFrame, radius: int) -> DataFrame:
    """(n_words, fp, item_fp, distance) of all fingerprints of one length within the radius."""
    left = prints.select("n_words", "fp", F.inline(_block_keys(radius)))
    marks = bench.select("n_words", "fp").distinct()
    right = marks.select("n_words", F.col("fp").alias("item_fp"), F.inline(_block_keys(radius)))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    return (
        left.join(right, ["n_words", "block", "bits"])
        .select("n_words", "fp", "item_fp", distance.cast("int").alias("distance"))
        .where(F.col("distance") <= radius)
        .distinct()
    )


def _verify(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bag(text: str):
            data = text.encode()
            starts, ends = S.word_spans(data)
            return S.counted([data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], shingle)

        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("item_text").to_pylist(), strict=True)
            found = [S.weighted_similarity(bag(a), bag(b)) for a, b in pairs]
            kept = batch.select(["id", "content", "item", "start", "n_words", "distance"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(found, pa.float64())], names=[*kept.schema.names, "similarity"]
            )

    return run


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    shingle: int = SHINGLE,
    least: float = SIMILARITY,
    radius: int = RADIUS,
    bits: int = BITMAP_BITS,
) -> DataFrame:
    """(id, content, item, start, n_words, distance, similarity): the best window of each document and item."""
    bench = stored(items(benchmark, item_text, item_id, shingle), "items")
    rows = windows(docs, bench, text, id, shingle, least, bits)
    pairs = within_radius(rows.select("n_words", "fp").distinct(), bench, radius)
    known = small(bench.select("item", "n_words", F.col("text").alias("item_text"), F.col("fp").alias("item_fp")))
    joined = rows.join(pairs, ["n_words", "fp"]).join(known, ["n_words", "item_fp"])
    joined = joined.drop("n_words").withColumnRenamed("held", "n_words")
    schema = "id long, content long, item long, start int, n_words int, distance int, similarity double"
    best = F.max(F.struct("similarity", (-F.col("start")).alias("rank"), "n_words", "distance")).alias("best")
    return (
        joined.mapInArrow(_verify(shingle), schema)
        .where(F.col("similarity") >= least)
        .groupBy("id", "content", "item")
        .agg(best)
        .select(
            "id", "content", "item", (-F.col("best.rank")).alias("start"), "best.n_words", "best.distance",
            "best.similarity",
        )
    )


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", **params
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, whole and unchanged."""
    found = matches(docs, benchmark, text, id, **params)
    gone = found.select(F.col("id").alias("__i"), F.col("content").alias("__c")).distinct()
    rows = docs.select(
        F.struct("*").alias("__row"),
        F.col(id).cast("long").alias("__id"),
        content_key(F.col(text)).alias("__content"),
    )
    same = (F.col("__content") == F.col("__c")) & F.col("__id").eqNullSafe(F.col("__i"))
    return rows.join(small(stored(gone, "leaks")), same, "left_anti").select("__row.*")
