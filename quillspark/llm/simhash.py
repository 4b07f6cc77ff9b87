"""Near-duplicates: copies of a shingle similarity, and SimHash with sharded BK-trees.

``near_duplicates`` and ``keep_one`` link copies by the exact similarity of their 5-word shingles (``near_copies``).
``within_bits`` links fingerprints that differ in a few bits, which finds only the closest copies:

1. Every text gets a 64-bit fingerprint of its word shingles (Arrow batches, numpy). Equal fingerprints are
   one class from here on, so copies never meet each other as pairs.
2. Two fingerprints within the radius r agree on at least 3 of r + 3 bit blocks. Every choice of 3 blocks is
   a shard key; the fingerprints of a shard are sorted next to each other by one shuffle.
3. Each shard builds a BK-tree whose children are keyed by their integer Hamming distance to the parent. A
   fingerprint follows only edges within the radius, is linked to what it meets, and is then inserted. A
   subtree whose members already belong to the fingerprint's own component is skipped, so a dense group of
   near copies costs about one path per member, and a shard gives at most one link per member.
4. Links become components by contraction (``components``).

The trees stay where the shuffle puts their shard instead of being broadcast, since they grow with the
corpus. A shard of more than ``shard_rows`` fingerprints is dealt anew on 5 of the 8 parts of its free
bits, which leaves 12 free bits, so that no tree can exceed 4,096 members.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; repeated rows
each get a row; a null id is ignored in the smallest id (a component of null ids only has a null id); an
empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import content_key, small, stored
from quillspark.llm.components import components
from quillspark.llm.near_copies import SIMILARITY, near_copies

SHINGLE = 3
RADIUS = 3
SHARD_ROWS = 20_000
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint: a bit is set if more than half of the shingle hashes have it."""
    parts = (text or "").encode().lower().split()
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(0, min(n, shingle) - 1)
    spans = zip(starts[: n - k].tolist(), ends[k:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    chosen = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int.from_bytes(chosen.tobytes(), "little")


def fingerprints(
    docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = SHINGLE
) -> DataFrame:
    """(id, content, fp): ``content`` is a key of the text, ``fp`` the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            fps = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("content"), fps], names=["id", "content", "fp"]
            )

    rows = docs.select(
        F.col(id).cast("long").alias("id"), content_key(F.col(text)).alias("content"), F.col(text).alias("text")
    )
    return rows.mapInArrow(run, "id long, content long, fp long")


# --- shards


def _masks(blocks: list[int], agree: int) -> list[int]:
    return [reduce(int.__or__, c) for c in combinations(blocks, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(count: int, bits: list[int]) -> list[int]:
    """Masks of ``count`` runs of nearly equal length over the given bit positions."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), count)]


def _keys(fp: Column, number: int, mask: int) -> Column:
    return F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(_signed(mask))))


def shards(classes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, fp): every two fingerprints within the radius share a key."""
    masks = _masks(_blocks(radius + 3, list(range(64))), 3)
    fp = F.col("fp")
    first = classes.select(
        "fp",
        F.inline(
            F.array(*[F.struct(F.lit(i).alias("mask"), _keys(fp, i, m).alias("key")) for i, m in enumerate(masks)])
        ),
    )
    large = stored(
        first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).select("key"),
        "shards",
    )
    if large.isEmpty():
        return first.select("key", "fp")
    finer = []
    for i, m in enumerate(masks):
        free = _blocks(radius + 5, [b for b in range(64) if not m >> b & 1])
        keys = [_keys(fp, 1000 * (i + 1) + j, m | s) for j, s in enumerate(_masks(free, 5))]
        finer.append(F.when(F.col("mask") == i, F.array(*keys)))
    split = first.join(large, "key", "left_semi").select(F.explode(F.coalesce(*finer)).alias("key"), "fp")
    return first.join(large, "key", "left_anti").select("key", "fp").unionByName(split)


class BKTree:
    """BK-tree of integers that links each new value to the components it meets."""

    def __init__(self, radius: int) -> None:
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.uniform: list[bool] = []  # all members of the subtree are in one component
        self.parent: list[int] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, value: int) -> None:
        """Links ``value`` to every member within the radius, then inserts it. Values must be distinct."""
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        self.uniform.append(True)
        self.parent.append(new)
        if not new:
            return
        seen, stack, radius = [], [0], self.radius
        while stack:
            node = stack.pop()
            if self.uniform[node] and self.find(node) == self.find(new):
                continue
            seen.append(node)
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                self.parent[max(self.find(node), self.find(new))] = min(self.find(node), self.find(new))
            edges = self.children[node]
            stack += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        for node in reversed(seen):
            root = self.find(node)
            self.uniform[node] = all(self.uniform[c] and self.find(c) == root for c in self.children[node].values())
        node, path = 0, [0]
        while (d := (self.values[node] ^ value).bit_count()) in self.children[node]:
            node = self.children[node][d]
            path.append(node)
        self.children[node][d] = new
        for node in path:
            self.uniform[node] = self.uniform[node] and self.find(node) == self.find(new)

    def links(self) -> list[tuple[int, int]]:
        """At most one link per member: to the first member of its component."""
        found = ((i, self.find(i)) for i in range(len(self.values)))
        return [(self.values[i], self.values[r]) for i, r in found if i != r]


def _linked(keys: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links inside the runs of equal keys; a run of one has none."""
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    out: list[tuple[int, int]] = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            tree = BKTree(radius)
            for value in fps[a:b].tolist():
                tree.add(value)
            out += tree.links()
    return out


def links(classes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints that span all components within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not len(batch):
                continue
            keys = np.concatenate((held_k, batch.column("key").to_numpy()))
            fps = np.concatenate((held_f, batch.column("fp").to_numpy().view(np.uint64)))
            whole = np.searchsorted(keys, keys[-1])  # the last run may go on in the next batch
            yield _batch(_linked(keys[:whole], fps[:whole], radius) if whole else [])
            held_k, held_f = keys[whole:], fps[whole:]
        yield _batch(_linked(held_k, held_f, radius) if len(held_k) else [])

    def _batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        flat = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])

    dealt = shards(classes, radius, shard_rows).repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def within_bits(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(id, content, fp, component_id) for every row; component_id is the smallest id of its component."""
    rows = stored(fingerprints(docs, text, id, shingle), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("id").alias("first"))
    found = components(links(classes.select("fp"), radius, shard_rows))
    rooted = classes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select(F.col("fp").alias("of"), "component_id", "root")
    return rows.join(named, F.col("fp") == F.col("of")).select("id", "content", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """(id, content, fp, component_id, root) for every row; the copies reach the exact similarity ``least``."""
    return near_copies(docs, text, id, least)


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id", **params) -> DataFrame:
    """One row of ``docs`` per component: that with the smallest id (ties: smallest text key, then any)."""
    found = near_duplicates(docs, text, id, **params)
    rows = stored(found.groupBy("root", "id", "content").agg(F.count(F.lit(1)).alias("n")), "members")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "content")
    chosen = rows.groupBy(F.col("root").alias("of")).agg(F.min(order).alias("one"))
    same = (F.col("content") == F.col("one.content")) & F.col("id").eqNullSafe(F.col("one.id"))
    gone = rows.join(chosen, F.col("root") == F.col("of")).where(~same).select("id", "content")
    gone = small(stored(gone.select(F.col("id").alias("__i"), F.col("content").alias("__c")), "copies"))
    kept = docs.select(
        F.struct("*").alias("__row"),
        F.col(id).cast("long").alias("__id"),
        content_key(F.col(text)).alias("__content"),
    ).join(gone, (F.col("__content") == F.col("__c")) & F.col("__id").eqNullSafe(F.col("__i")), "left_anti")
    if not rows.where("n > 1").isEmpty():  # repeated rows: any one of them
        one = Window.partitionBy("__content", "__id").orderBy(F.lit(1))
        kept = kept.withColumn("__n", F.row_number().over(one)).where("__n = 1")
    return kept.select("__row.*")
