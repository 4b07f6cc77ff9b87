"""Repeated passages: paragraph MinHash with banding, exact verification and components.

Line breaks do not mark the passages that documents share: they stand in the middle of other text. So a
paragraph here is a stretch of ``PARAGRAPH`` words that starts at an anchor: a place whose shingle hash is the
smallest of ``ANCHORS`` places in a row. The anchors follow from the words alone, so a passage gets the same
paragraphs wherever it stands, and every passage of at least PARAGRAPH + ANCHORS - 1 words (50) holds one.

1. Tasks hash the paragraphs of their documents, count equal ones per batch (a hot passage leaves a batch as
   one row), and emit one row per band of MinHashes. 4 bands of 2 find a pair of similarity 0.8 with
   probability 0.98 and equal paragraphs always.
2. Rows of one band key meet by one shuffle. Only band keys that more than one document has go on; most rows
   end here, among them those that overlapping paragraphs of one text share.
3. A bitmap of fixed size over those paragraphs lets a second pass over the texts emit their places and
   shingles.
4. Different paragraphs of one band key are verified by the exact Jaccard similarity of their shingles (32-bit
   hashes). A key's members are grouped by search from member to member, all keys of a batch at once, so that a link
   is tested unless it is already implied. Members of a key with many are compared only if they share one of their
   rarest shingles, as similar ones do, so that most pairs of a large key cost nothing.
5. Components are the clusters. A cluster that stands in two documents or more is a repeated passage; the
   place with the smallest id and position is kept; all that do not overlap it are removals, also in its text.
6. The places carry one hash of the 20 words on either side. An exact passage of 50 words or more begins and ends
   within them, so a removal that goes on as far as they equal those of the first equal paragraph covers the passage
   word by word. Equal hashes mean all of them; only for the others, at the ends of passages, does a third pass over
   the texts that have them look up the words themselves.

Defined results: null texts and texts shorter than a paragraph have no passages; a null id is its own
document and comes last; passages that repeat inside one document only are not reported; repeated rows
(equal id and text) are one document; an empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import shingles as S
from quillspark.llm.common import LAST, content_key, stored
from quillspark.llm.components import components

SHINGLE = 5
PARAGRAPH = 30
ANCHORS = 21
EDGE = ANCHORS - 1
BANDS = 4
ROWS = 2
SIMILARITY = 0.8
CROWD = 64  # members of a band key that are compared without an index
BITMAP_BITS = 25

_EDGE_SLOTS = S.mixed(np.arange(101, EDGE + 101, dtype=np.uint64)) | np.uint64(1)
_SLOTS = S.mixed(np.arange(1, PARAGRAPH - SHINGLE + 2, dtype=np.uint64)) | np.uint64(1)
_HELD = np.uint64((1 << 24) - 1)
BLOCK = 1 << 16  # bytes of text, so that the arrays of a call stay in a cache
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _windows(x: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)


def _smallest(hashes: np.ndarray, size: int) -> np.ndarray:
    """Place of the smallest hash, the first of equal ones, of every ``size`` places in a row."""
    if len(hashes) > _HELD:
        return _windows(hashes, size).argmin(axis=1) + np.arange(len(hashes) - size + 1)
    least, width = _placed(hashes), 1
    while 2 * width <= size:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < size:
        least = np.minimum(least[: len(least) - (size - width)], least[size - width :])
    return (least & _HELD).astype(np.int64)


def _placed(hashes: np.ndarray) -> np.ndarray:
    """Hashes with their places in the low bits; of those equal in 40 bits, the first is the smallest."""
    return (hashes & ~_HELD) | np.arange(len(hashes), dtype=np.uint64)


def _once(x: np.ndarray) -> np.ndarray:
    """Values that never go back, each once."""
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def anchors(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places of the smallest hash, the first of equal ones, of every ``size`` places in a row."""
    return _once(_smallest(hashes, size))


class Block(NamedTuple):
    """Paragraphs of some texts, in order of text and place."""

    of: np.ndarray  # the text of each
    starts: np.ndarray  # its first word, counted in its text
    at: np.ndarray  # the same, counted in ``words``
    left: np.ndarray  # number of words after it in its text
    keys: np.ndarray
    inside: np.ndarray  # its shingle hashes, one row each
    words: np.ndarray  # hashes of the words of all texts


def block(texts: list[bytes], number: int = 0) -> Block:
    """Paragraphs of lower-cased texts, which are numbered from ``number``."""
    per = PARAGRAPH - SHINGLE + 1
    data = b" ".join(texts)
    begins, ends = S.word_spans(data)
    words = S.word_hashes(data, begins, ends)
    bounds = np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    hashes = S.shingle_hashes(words, SHINGLE)  # those over the end of a text are not used
    first, room = bounds[:-1], np.diff(bounds) - PARAGRAPH + 1
    count = np.maximum(room - ANCHORS + 1, 0)
    at = np.zeros(0, np.int64)
    if count.any():
        rows = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
        at = _once(_smallest(hashes, ANCHORS)[rows])
    if len(short := np.flatnonzero((room > 0) & (count == 0))):  # a short text has fewer places to choose from
        sides = np.stack([first[short], first[short] + room[short]], axis=1).ravel()
        least = np.minimum.reduceat(_placed(hashes), sides)[::2] & _HELD
        at = np.sort(np.concatenate((at, least.astype(np.int64))))
    of = np.searchsorted(bounds, at, side="right") - 1
    inside = _windows(hashes, per)[at] if len(at) else np.zeros((0, per), np.uint64)
    left = bounds[of + 1] - at - PARAGRAPH
    return Block(of + number, at - bounds[of], at, left, S.mixed(inside @ _SLOTS), inside, words)


def blocks(texts: Iterable[pa.StringScalar]) -> Iterator[Block]:
    """Paragraphs of all texts, of about BLOCK bytes at once: most texts are short, and the calls would cost more than
    their words. A longer text comes alone."""
    number, held, size = 0, [], 0
    for i, body in enumerate(texts):
        data = (body.as_py() or "").lower().encode()
        if held and size + len(data) > BLOCK:
            yield block(held, number)
            number, held, size = i, [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield block(held, number)


def paragraphs(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words, keys and shingle hashes (one row each) of the paragraphs of one text; hashes of its words."""
    found = block([(text or "").lower().encode()])
    return found.starts, found.keys, found.inside, found.words


def around(x: Block, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the up to EDGE words before and after some paragraphs (2 x paragraphs x EDGE), the nearest first, zero
    beyond the text; one key for each side of a paragraph (2 x paragraphs)."""
    none, at = np.zeros(EDGE, np.uint64), x.at[rows]
    runs = _windows(np.concatenate((none, x.words, none)), EDGE)
    found = np.stack([runs[at][:, ::-1], runs[at + EDGE + PARAGRAPH]])
    for side, n in zip(found, (x.starts[rows], x.left[rows]), strict=True):
        near = np.flatnonzero(n < EDGE)
        side[near] *= np.arange(EDGE) < n[near, None]
    return found, S.mixed(found @ _EDGE_SLOTS)


def band_keys(inside: np.ndarray) -> np.ndarray:
    """Keys (paragraphs x bands) from the MinHashes of the shingles of each paragraph."""
    turned = np.ascontiguousarray(inside.T)
    least = [(turned * s).min(axis=0) for s in _SEEDS]
    out = np.empty((len(inside), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(inside), b + 1, np.uint64)
        for r in range(ROWS):
            key = S.mixed(key + least[b * ROWS + r])
        out[:, b] = key
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(values: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    """One list of 32-bit hashes per row."""
    ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values).view(np.int32)))


def band_rows(docs: DataFrame, text: str, id: str) -> DataFrame:
    """(band, key, doc): one row per band and distinct paragraph of an Arrow batch. ``doc`` is a tag of the
    document, 0 for several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, found = batch.column("doc").to_numpy(), []
            for x in blocks(batch.column("text")):
                order = np.argsort(x.keys, kind="stable")
                keys, of = x.keys[order], x.of[order]
                if not len(keys):
                    continue
                at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                one = of[at] == of[np.append(at[1:], len(of)) - 1]  # the texts of a key ascend
                found.append((keys[at], np.where(one, tags[of[at]], np.int32(0)), band_keys(x.inside[order[at]])))
            if not found:
                continue
            keys, tags, bands = (np.concatenate(x) for x in zip(*found, strict=True))
            keys, first, n = np.unique(keys, return_index=True, return_counts=True)
            tags = np.where(n > 1, np.int32(0), tags[first])
            yield pa.RecordBatch.from_arrays(
                [_signed(bands[first].ravel()), _signed(np.repeat(keys, BANDS)), pa.array(np.repeat(tags, BANDS))],
                names=["band", "key", "doc"],
            )

    tag = content_key(F.col(id), F.col(text)).bitwiseAND(F.lit(0x7FFFFFFE)).cast("int") + 1
    return docs.select(F.col(text).alias("text"), tag.alias("doc")).mapInArrow(run, "band long, key long, doc int")


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[dict[str, pa.Array]]:
    """Batches sorted by ``column`` cut anew so that no run of equal values is torn."""
    held: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        values = table.column(column).to_numpy()
        cut = int(np.searchsorted(values, values[-1]))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def collisions(rows: DataFrame) -> DataFrame:
    """(band, key): paragraphs of band keys that more than one document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "band"):
            band, key, doc = (table.column(c).to_numpy() for c in ("band", "key", "doc"))
            at = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
            least, most = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
            several = np.repeat((least != most) | (least == 0), np.diff(np.append(at, len(band))))
            kept = several & np.concatenate(([True], (band[1:] != band[:-1]) | (key[1:] != key[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(band[kept]), pa.array(key[kept])], names=["band", "key"])

    return rows.repartition("band").sortWithinPartitions("band", "key").mapInArrow(run, "band long, key long")


def places(docs: DataFrame, text: str, id: str, wanted: DataFrame, several: DataFrame, bits: int) -> DataFrame:
    """(id, content, start, key, before, after, room, shingles) of every place of the paragraphs whose key may be in
    ``wanted``: the keys of the words on either side and the number of those after it; the shingles, as 32-bit
    hashes, are at the first place in a text if the key may be in ``several``."""
    tables = docs.sparkSession.sparkContext.broadcast(
        tuple(S.bitmap(x.select(F.col("key").alias("hash")), bits) for x in (wanted, several))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, compared = tables.value
        for batch in batches:
            at, start, key, inside, sizes, edges, room = [], [], [], [], [], [], []
            for x in blocks(batch.column("text")):
                hit = np.flatnonzero(S.holds(known, x.keys))
                if not len(hit):
                    continue
                maybe = np.flatnonzero(S.holds(compared, x.keys[hit]))
                maybe = maybe[np.lexsort((x.keys[hit[maybe]], x.of[hit[maybe]]))]
                texts, keys = x.of[hit[maybe]], x.keys[hit[maybe]]
                first = np.ones(len(maybe), bool)
                first[1:] = (texts[1:] != texts[:-1]) | (keys[1:] != keys[:-1])
                with_set = np.zeros(len(hit), bool)
                with_set[maybe[first]] = True
                at.append(x.of[hit])
                start.append(x.starts[hit])
                key.append(x.keys[hit])
                inside.append((x.inside[hit[with_set]].ravel() >> np.uint64(32)).astype(np.uint32))
                sizes.append(with_set * x.inside.shape[1])
                edges.append(around(x, hit)[1])
                room.append(np.minimum(x.left[hit], EDGE))
            if not at:
                continue
            at = pa.array(np.concatenate(at))
            before, after = np.concatenate(edges, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(at), batch.column("content").take(at),
                    pa.array(np.concatenate(start).astype(np.int32)), _signed(np.concatenate(key)),
                    _signed(before), _signed(after), pa.array(np.concatenate(room).astype(np.int8)),
                    _lists(inside, sizes),
                ],
                names=["id", "content", "start", "key", "before", "after", "room", "shingles"],
            )

    rows = docs.select(
        F.col(id).cast("long").alias("id"), content_key(F.col(text)).alias("content"), F.col(text).alias("text")
    )
    return rows.mapInArrow(
        run,
        "id long, content long, start int, key long, before long, after long, room byte, shingles array<int>",
    )


def edges(docs: DataFrame, text: str, asked: DataFrame, bits: int) -> DataFrame:
    """(edge, words): the words, as 64-bit hashes, of the edges (content, edge) that are ``asked`` for. The bitmaps may
    let others through; an edge may come from several batches."""
    tables = docs.sparkSession.sparkContext.broadcast(
        tuple(S.bitmap(asked.select(F.col(c).alias("hash")), bits) for c in ("content", "edge"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, sides = tables.value
        for batch in batches:
            content = batch.column("content").to_numpy().view(np.uint64)
            keys, words = [], []
            asked = pa.array(np.flatnonzero(S.holds(texts, content)))
            for x in blocks(batch.column("text").take(asked)):
                found, edge = around(x, np.arange(len(x.at)))
                hit = S.holds(sides, edge)
                keys.append(edge[hit])
                words.append(found[hit])
            if not keys:
                continue
            keys, first = np.unique(np.concatenate(keys), return_index=True)
            words = np.ascontiguousarray(np.concatenate(words)[first])
            ends = np.arange(0, words.size + 1, EDGE, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [_signed(keys), pa.ListArray.from_arrays(ends, _signed(words.ravel()))], names=["edge", "words"]
            )

    rows = docs.select(content_key(F.col(text)).alias("content"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "edge long, words array<long>")


def meetings(band: np.ndarray, sets: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and groups: all similar sets of one band have a group in common; equal groups stand together.

    A small band is a group. Most members of a large one share only what is common in it, so they are grouped by their
    rarest values: of two similar sets, these have one in common (prefix filter, exact), and most others meet nobody.
    """
    at = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1]))) if len(band) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(band)))
    group = np.repeat(np.arange(len(at)), count)
    large, width = count > CROWD, sets.shape[1]
    rows, groups, last = [np.flatnonzero(~large[group])], [group[~large[group]]], len(at)
    for begin, n in zip(at[large].tolist(), count[large].tolist(), strict=True):
        _, place, often = np.unique(sets[begin : begin + n], return_inverse=True, return_counts=True)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        ranks = np.sort(rank[place.reshape(n, width)], axis=1)
        single = np.concatenate((np.ones((n, 1), bool), ranks[:, 1:] != ranks[:, :-1]), axis=1)
        sizes = single.sum(axis=1)
        if sizes.min() == width:
            first = np.full(n, width - _common(width, least) + 1)
        else:  # the other set may be smaller
            first = sizes - np.ceil(sizes * least - 1e-9).astype(np.int64) + 1
        member, column = np.nonzero(single & (single.cumsum(axis=1) <= first[:, None]))
        value = ranks[member, column]
        order = np.argsort(value, kind="stable")
        met = np.bincount(value)[value[order]] > 1
        rows.append(begin + member[order][met])
        groups.append(last + value[order][met])
        last += len(often)
    return np.concatenate(rows), np.concatenate(groups)


def _common(width: int, least: float) -> int:
    """How many values two similar sets of ``width`` have in common at least."""
    return int(np.ceil(2 * width * least / (1 + least) - 1e-9))


def links(band: np.ndarray, sets: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (member, earlier member) that join all sets of one band whose Jaccard similarity reaches ``least``.

    ``band`` is sorted, ``sets`` holds one set per row, of equally many values with repeats.
    """
    rows, groups = meetings(band, sets, least)
    a, b = _joined(groups, sets[rows], least)
    return rows[a], rows[b]


def _joined(band: np.ndarray, sets: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups, whose rows stand together: one member of every group is compared with those left in it, in
    turn: first the members already reached, then the next one. Two sets without repeats that are similar have a value
    in common among the first few of either (prefix filter)."""
    sets = np.sort(sets, axis=1)
    single = np.concatenate((np.ones((len(sets), 1), bool), sets[:, 1:] != sets[:, :-1]), axis=1)
    sizes = single.sum(axis=1)
    width = sets.shape[1]
    heads = np.ascontiguousarray(sets[:, : width - _common(width, least) + 1].T)
    rows, reached, out = np.arange(len(band)), np.zeros(len(band), bool), ([], [])
    while len(rows):
        at = np.flatnonzero(np.concatenate(([True], band[rows[1:]] != band[rows[:-1]])))
        count = np.diff(np.append(at, len(rows)))
        order = np.arange(len(rows)) + np.where(reached[rows], 0, len(rows))
        pivot = np.minimum.reduceat(order, at) % len(rows)
        left = ~reached[rows]
        left[pivot] = False
        a, b = rows[left], rows[np.repeat(pivot, count)[left]]
        maybe = (sizes[a] < width) | (sizes[b] < width)
        for x in heads[:, a]:
            for y in heads:
                maybe |= x == y[b]
        a, b = a[maybe], b[maybe]
        similar = np.zeros(len(a), bool)
        for i in range(0, len(a), 1 << 14):
            x, y = a[i : i + (1 << 14)], b[i : i + (1 << 14)]
            own, other = sets[x], np.ascontiguousarray(sets[y].T)
            common = np.zeros(own.shape, bool)
            for value in other:
                common |= own == value[:, None]
            n = (common & single[x]).sum(axis=1)
            similar[i : i + len(x)] = n >= least * (sizes[x] + sizes[y] - n)
        out[0].append(a[similar])
        out[1].append(b[similar])
        reached[a[similar]] = True
        open_ = np.ones(len(rows), bool)
        open_[pivot] = False
        waits = np.add.reduceat(~reached[rows] & open_, at) > 0  # bands with members not reached
        rows = rows[open_ & np.repeat(waits, count)]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links between different paragraphs of one band key whose exact similarity suffices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "band"):
            band, keys = table.column("band").to_numpy(), table.column("key").to_numpy()
            values = table.column("shingles").combine_chunks().flatten().to_numpy().view(np.uint32)
            a, b = links(band, values.reshape(len(band), -1), least)
            yield pa.RecordBatch.from_arrays([pa.array(keys[a]), pa.array(keys[b])], names=["a", "b"])

    rows = pairs.join(sets, "key").repartition("band").sortWithinPartitions("band", "key")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _same_text(place: str) -> Column:
    return (F.col("id_") == F.col(f"{place}.id_")) & (F.col("content") == F.col(f"{place}.content"))


def _agreeing(x: str, y: str) -> Column:
    """How many words of two different edges agree."""
    equal = F.zip_with(x, y, lambda a, b: (a == b) & (a != 0))
    return (F.array_position(equal, F.lit(False)) - 1).cast("int")


def repeated(
    docs: DataFrame, text: str = "text", id: str = "doc_id", least: float = SIMILARITY, bits: int = BITMAP_BITS
) -> DataFrame:
    """(id, start, n_words, cluster, n_docs, removed): one row per place of a repeated paragraph.

    ``start`` counts the words of the normalised text; ``cluster`` names the passage; ``removed`` is false at the
    place that is kept and at those that overlap it. A removal goes on over the words next to the paragraph as far
    as they equal those next to the first equal paragraph (the kept place if there is none), which reaches the ends
    of a passage; it leaves out the words of that place itself.
    """
    pairs = stored(collisions(band_rows(docs, text, id)), "bands")
    shared = pairs.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    several = stored(pairs.join(shared, "band", "left_semi"), "several")
    found = stored(places(docs, text, id, pairs, several, bits), "places")
    sets = found.where(F.size("shingles") > 0).groupBy("key").agg(F.first("shingles").alias("shingles"))
    roots = components(verified(several, sets, least))
    spots = (
        found.drop("shingles")
        .distinct()
        .join(roots, F.col("key") == F.col("node"), "left")
        .drop("node")
        .select("*", F.coalesce("root", "key").alias("cluster"))
        .drop("root")
    )
    spots = stored(spots, "spots").withColumn("id_", F.coalesce("id", F.lit(LAST)))
    place = F.struct("id_", "content", "start", "before", "after")
    per_doc = spots.groupBy("cluster", "id", "content").agg(F.min(place).alias("kept"))
    clusters = (
        per_doc.groupBy(F.col("cluster").alias("of"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("kept").alias("kept"))
        .where("n_docs > 1")
    )
    firsts = spots.groupBy(F.col("key").alias("same_key"), "cluster").agg(F.min(place).alias("first"))
    known = firsts.join(clusters, F.col("cluster") == F.col("of")).select("same_key", "n_docs", "kept", "first")
    rows = spots.join(known, F.col("key") == F.col("same_key"))
    is_first = _same_text("first") & (F.col("start") == F.col("first.start"))
    rows = rows.withColumns(
        {
            "model": F.when(is_first, F.col("kept")).otherwise(F.col("first")),
            "removed": ~(_same_text("kept") & (F.col("start") < F.col("kept.start") + PARAGRAPH)),
        }
    )
    floor = [F.when(_same_text(x), F.col(f"{x}.start") + PARAGRAPH).otherwise(0) for x in ("kept", "model")]
    differ = [F.col("removed") & (F.col(c) != F.col(f"model.{c}")) for c in ("before", "after")]
    own = [F.when(d, F.col(c)).alias(c) for d, c in zip(differ, ("before", "after"), strict=True)]
    other = [F.when(d, F.col(f"model.{c}")).alias(f"model_{c}") for d, c in zip(differ, ("before", "after"), strict=True)]
    rows = rows.select(
        "id", "content", F.col("model.content").alias("model_content"), "start", "room", "cluster", "n_docs", "removed",
        F.greatest(*floor).alias("floor"), *own, *other,
    )
    rows = stored(rows, "rows")
    partial = F.col("before").isNotNull() | F.col("after").isNotNull()

    # the edges that differ, each looked up in one text that has it
    ends = rows.where(partial)
    pairs = [ends.select(F.col(c).alias("x"), F.col(f"model_{c}").alias("y")) for c in ("before", "after")]
    pairs = pairs[0].union(pairs[1]).where(F.col("x").isNotNull()).distinct()
    sides = F.array(
        *[F.struct(F.col(t).alias("content"), F.col(c).alias("edge"))
          for t, p in (("content", ""), ("model_content", "model_")) for c in (f"{p}before", f"{p}after")]
    )
    asked = ends.select(F.inline(sides)).where(F.col("edge").isNotNull())
    asked = stored(asked.groupBy("edge").agg(F.min("content").alias("content")), "asked")
    words = edges(docs, text, asked, bits).join(asked, "edge", "left_semi").dropDuplicates(["edge"])
    words = stored(words, "edges")
    equal = (
        pairs.join(words.select(F.col("edge").alias("x"), F.col("words").alias("of_x")), "x")
        .join(words.select(F.col("edge").alias("y"), F.col("words").alias("of_y")), "y")
        .select("x", "y", _agreeing("of_x", "of_y").alias("n"))
    )
    equal = stored(equal, "agreeing")
    ends = ends.withColumns({"n_before": F.lit(None).cast("int"), "n_after": F.lit(None).cast("int")})
    for c in ("before", "after"):
        # the side that agrees as a whole looks for a pair that is not there, in many places
        x = F.coalesce(c, F.xxhash64("id", "start"))
        known = equal.select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("n").alias("__n"))
        ends = ends.withColumn("__own", x).join(
            known, (F.col("__own") == F.col("__x")) & (F.coalesce(f"model_{c}", F.lit(0)) == F.col("__y")), "left"
        )
        ends = ends.withColumn(f"n_{c}", F.when(F.col(c).isNotNull(), F.col("__n"))).drop("__own", "__x", "__y", "__n")
    whole = rows.where(~partial).withColumns({"n_before": F.lit(None).cast("int"), "n_after": F.lit(None).cast("int")})
    rows = whole.unionByName(ends)
    begin = F.greatest(F.col("start") - F.coalesce("n_before", F.least("start", F.lit(EDGE))), "floor")
    end = F.col("start") + PARAGRAPH + F.coalesce("n_after", F.col("room").cast("int"))
    return rows.select(
        "id",
        F.when(F.col("removed"), begin).otherwise(F.col("start")).alias("start"),
        F.when(F.col("removed"), end - begin).otherwise(PARAGRAPH).alias("n_words"),
        "cluster",
        "n_docs",
        "removed",
    )
