"""Token-id files with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by id; one Arrow pass per partition tokenises them and cuts the
stream into segments of about ``segment_tokens`` ids. A segment is one row of the written table:

* ``shard``, ``segment``: its place in the order; ``n_docs``, ``n_tokens``, ``n_null`` (leading null ids)
* ``tokens``: the ids one after the other, little-endian unsigned, ``width`` bytes each
* ``ends``: Elias-Fano code of the exclusive end of each document inside the segment
* ``names``: Elias-Fano code of the document ids, less ``first_id``

The rows are written by Spark's Parquet committer, so the files can be in any store Spark writes to and a
lost executor leaves no half file. No table of 64-bit offsets exists: the start of a document is the sum of
the shards and segments before it (one row each) plus one select on ``ends``.

Tokenising. The tokenizer drops blanks and never joins characters across them, so blank-separated pieces
are encoded on their own and remembered in a bounded dictionary per worker; tests compare this with
encoding whole texts.

Defined results: a null text is empty and holds the end id only; null ids come first; equal ids are ordered
by a key of their text and each keeps its own entry; an empty table gives no segments. Only the id and the
text are read. Ids are 64-bit integers.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_batches

SEGMENT_TOKENS = 1 << 20
SEGMENT_DOCS = 1 << 16
REMEMBERED = 800_000
#: Marks that may follow a word, and the first letter that normalisation or lower-casing may join with others.
MARKS = ".,;:!?)"
LATIN_END = "\u0250"
SAMPLE = 256

SEGMENT = (
    "shard int, segment int, width int, n_docs int, n_null int, n_tokens long, first_id long, "
    "tokens binary, ends binary, names binary"
)


KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
LAYOUT = pa.schema([(name, KINDS[kind]) for name, kind in (field.split() for field in SEGMENT.split(", "))])


class EliasFano:
    """Non-decreasing integers: low bits packed, high parts in unary, and a sampled select."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.count, self.low_bits, self.low, self.high = count, low_bits, low, high
        total = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.uint32))).astype(np.uint32)
        #: the byte of ``high`` with every SAMPLE-th one, and the ones before that byte
        self.samples = np.searchsorted(total[1:], np.arange(0, count, SAMPLE), side="right").astype(np.uint32)
        self.before = total[self.samples]

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if int(values[-1]) >= n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((values[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"))

    def dumps(self) -> bytes:
        head = np.array([self.count, self.low_bits, len(self.low)], "<u4").tobytes()
        return head + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def loads(cls, data: bytes) -> EliasFano:
        count, low_bits, size = np.frombuffer(data, "<u4", 3).tolist()
        body = np.frombuffer(data, np.uint8, offset=12)
        return cls(count, low_bits, body[:size], body[size:])

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        part = self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes()
        return int.from_bytes(part, "little") >> (first & 7) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, without decoding the others."""
        at = int(self.samples[i // SAMPLE])
        left = i - int(self.before[i // SAMPLE])
        while (ones := int(self.high[at]).bit_count()) <= left:
            left -= ones
            at += 1
        place = np.flatnonzero(np.unpackbits(self.high[at : at + 1], bitorder="little"))[left]
        return ((8 * at + int(place) - i) << self.low_bits) | self._low(i)

    def values(self) -> np.ndarray:
        if not self.count:
            return np.zeros(0, np.uint64)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        high = (places - np.arange(self.count)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[: self.count * self.low_bits]
        bits = bits.reshape(self.count, self.low_bits).astype(np.uint64)
        return high | (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Remembered(dict):
    """Answers to ``ask`` in two generations: what was used since the last turn is kept when the younger one is full."""

    def __init__(self, ask: Callable[[Any], bytes], most: int) -> None:
        self.ask, self.most, self.old = ask, most // 2, {}

    def __missing__(self, key: Any) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.ask(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Pieces:
    """Token ids of whole texts from those of their blank-separated pieces.

    A piece of Latin letters with marks at its end is one word and one run of marks to the tokenizer, whose
    model is asked for both directly; any other piece goes through the whole tokenizer. Both kinds of answers
    are remembered, up to ``remembered`` pieces and half as many words (about 150 bytes each).
    """

    def __init__(self, path: str, width: int, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype(f"<u{width}")
        self.letters = _byte_letters()
        self.known = _Remembered(self._piece, remembered)
        self.runs = _Remembered(self._run, remembered // 2)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _run(self, run: str) -> bytes:
        coded = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
        return self._bytes([t.id for t in self.model.tokenize(coded)]) if run else b""

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        word = text.rstrip(MARKS)
        low = word.lower()
        if low.isalpha() and (word.isascii() or max(word) < LATIN_END):  # lower-casing can split a mark off a letter
            ids = self.runs[low]
            return ids + self.runs[text[len(word) :]] if len(word) < len(text) else ids
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, text.encode().split()))


@lru_cache(maxsize=2)
def _pieces(path: str, width: int, remembered: int) -> Pieces:
    return Pieces(path, width, remembered)


def _segment(shard: int, number: int, width: int, ids: list[int | None], parts: list[bytes]) -> dict:
    known = np.array([i for i in ids if i is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // width
    return {
        "shard": shard, "segment": number, "width": width, "n_docs": len(ids), "n_null": len(ids) - len(known),
        "n_tokens": int(ends[-1]), "first_id": first, "tokens": b"".join(parts),
        "ends": EliasFano.of(ends).dumps(), "names": EliasFano.of(known.view(np.uint64) - np.uint64(first % (1 << 64))).dumps(),
    }


def segments(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    text: str = "text",
    id: str = "doc_id",
    width: int = 2,
    segment_tokens: int = SEGMENT_TOKENS,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """The segment rows of ``docs`` in ascending id order. ``width`` 2 fits vocabularies up to 65,536. Fewer
    ``remembered`` pieces take less memory and more time; the ids are the same."""
    end = np.array([end_id], f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, shard, number = _pieces(tokenizer, width, remembered), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        parts: list[bytes] = []
        size = 0
        for batch in batches:
            for name, body in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                code = pieces.encode(body.as_py() or "") + end
                ids.append(name)
                parts.append(code)
                size += len(code)
                if size >= segment_tokens * width or len(ids) >= SEGMENT_DOCS:
                    yield pa.RecordBatch.from_pylist([_segment(shard, number, width, ids, parts)], LAYOUT)
                    ids, parts, size, number = [], [], 0, number + 1
        if ids:
            yield pa.RecordBatch.from_pylist([_segment(shard, number, width, ids, parts)], LAYOUT)

    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, SEGMENT)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, **params) -> None:
    with arrow_batches(docs.sparkSession, "8m"):
        segments(docs, tokenizer, end_id, **params).write.parquet(folder)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            tokens = np.frombuffer(row["tokens"], f"<u{row['width']}").astype("<u4")
            ends = EliasFano.loads(row["ends"]).values().astype(np.int64)
            begins = np.concatenate(([0], ends[:-1]))
            names = EliasFano.loads(row["names"]).values() + np.uint64(row["first_id"] % (1 << 64))
            raw = memoryview(tokens.tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            n, size = row["n_null"], row["n_docs"]
            ids = pa.array([None] * n + names.view(np.int64).tolist(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, row["shard"], np.int32)),
                    pa.array(np.full(size, row["segment"], np.int32)),
                    ids,
                    pa.array(begins),
                    pa.array(ends - begins),
                    pa.array(np.array(sums, np.int64)),
                ],
                names=["shard", "segment", "id", "at", "n_tokens", "crc"],
            )


def read(spark: SparkSession, folder: str, id: str = "doc_id") -> DataFrame:
    """Per document of the files: id, start, n_tokens and the crc32 of its ids as 32-bit integers."""
    files = spark.read.schema(SEGMENT).parquet(folder)
    sizes = files.select("shard", "segment", "n_tokens")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    zero = F.lit(0).cast("long")
    shards = shards.select(
        "shard", F.coalesce(F.sum("n").over(before.orderBy("shard")), zero).alias("base")
    )
    inside = before.partitionBy("shard").orderBy("segment")
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), zero)).join(shards, "shard")
    starts = starts.select("shard", "segment", (F.col("base") + F.col("inside")).alias("base"))
    found = files.mapInArrow(
        _digests, "shard int, segment int, id long, at long, n_tokens long, crc long"
    )
    return found.join(starts, ["shard", "segment"]).select(
        F.col("id").alias(id),
        (F.col("base") + F.col("at")).alias("start"),
        "n_tokens",
        F.col("crc").alias("ids_crc32"),
    )
