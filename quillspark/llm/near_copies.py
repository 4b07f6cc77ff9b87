"""Near copies by the exact similarity of their word shingles.

Two texts of similarity 0.8 differ in about 10 of the 64 bits of their SimHash, and fingerprints that may differ in so
many bits agree on no block that would divide a corpus. So the shards here are bands of MinHashes; inside a shard a
BK-tree of the SimHash fingerprints finds the partners, and no pair is linked without its exact similarity.

1. Tasks hash every text to its set of 5-word shingles and its SimHash. Texts of equal sets are one class from here on.
2. 25 bands of 5 MinHashes: a pair of similarity 0.8 shares one with probability 0.99995.
3. (band, class) is all that is shuffled of every text. Bands that hold the same classes are verified once; only for
   classes that share a band do the sets of shingles move.
4. Each band grows a BK-tree of its members' fingerprints. A member follows only edges within ``RADIUS`` bits (pairs of
   0.8 lie about 5 standard deviations inside) and is compared with what it meets by the exact Jaccard similarity of
   the sets, unless the link is already implied. Sets of fewer than ``FEW`` shingles have no steady fingerprint; a band
   that holds one compares at any distance.
5. Links become components by contraction (``components``).

Words are those of ``shingles`` (lower case, without ASCII punctuation). Sets are compared by 32-bit hashes.

Defined results: a text of fewer words than a shingle is one shingle; null and wordless texts are copies of each
other; repeated rows each get a row; a null id is ignored in the smallest id; an empty table gives an empty result.
Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import shingles as S
from quillspark.llm.bk_tree import VerifiedTree
from quillspark.llm.common import content_key, parts, release, small, stored
from quillspark.llm.components import components
from quillspark.llm.decontaminate import simhash
from quillspark.llm.passages import _runs

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
RADIUS = 24
FEW = 32

_SEEDS = np.random.default_rng(13).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ROW = "id long, content long, class long, fp long, bands array<long>, shingles array<int>"


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingle hashes of a text, in rising order; a wordless text has the one hash 0."""
    data = (text or "").lower().encode()
    words = S.word_hashes(data, *S.word_spans(data))
    return np.unique(S.shingle_hashes(words, min(SHINGLE, len(words)))) if len(words) else np.zeros(1, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least = np.array([S.mixed(hashes * s).min() for s in _SEEDS])
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = S.mixed(keys + least[r::ROWS])
    return keys


def sets(docs: DataFrame, text: str, id: str) -> DataFrame:
    """(id, content, class, fp, bands, shingles) for every row; ``fp`` is the SimHash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [shingle_set(t.as_py()) for t in batch.column("text")]
            kinds = np.array([S.mixed(h + np.uint64(len(h))).sum(dtype=np.uint64) for h in found], np.uint64)
            bands = np.concatenate([band_keys(h) for h in found])
            short = [np.unique((h >> np.uint64(32)).astype(np.uint32)) for h in found]
            ends = np.cumsum([0, *map(len, short)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("content"), pa.array(kinds.view(np.int64)),
                    pa.array([simhash(h) for h in found], pa.int64()),
                    pa.ListArray.from_arrays(
                        np.arange(0, len(bands) + 1, BANDS, dtype=np.int32), pa.array(bands.view(np.int64))
                    ),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(short).view(np.int32))),
                ],
                names=["id", "content", "class", "fp", "bands", "shingles"],
            )

    rows = docs.select(
        F.col(id).cast("long").alias("id"), content_key(F.col(text)).alias("content"), F.col(text).alias("text")
    )
    return rows.mapInArrow(run, _ROW)


def _groups(flat: np.ndarray, ends: np.ndarray, prints: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (member, earlier member) that join all sets whose Jaccard similarity reaches ``least``; set i is
    ``flat[ends[i]:ends[i + 1]]``."""
    size = np.diff(ends)

    def similar(i: int, j: int) -> bool:
        if min(size[i], size[j]) < least * max(size[i], size[j]):
            return False
        common = len(np.intersect1d(flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]], assume_unique=True))
        return common >= least * (size[i] + size[j] - common) - 1e-9

    tree = VerifiedTree(RADIUS if size.min() >= FEW else 64, similar)
    for value in prints.view(np.uint64).tolist():
        tree.add(value)
    return tree.links


def shared_bands(dealt: DataFrame) -> DataFrame:
    """(band, class, n, who, least) of the rows (band, class) whose band holds several classes; the last three name what
    the band holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "band"):
            band, kind = (table.column(c).to_numpy() for c in ("band", "class"))
            at = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
            n = np.diff(np.append(at, len(band)))
            who = np.bitwise_xor.reduceat(S.mixed(kind.view(np.uint64)), at).view(np.int64)
            kept = np.repeat(n > 1, n)
            columns = [band, kind, *(np.repeat(x, n) for x in (n.astype(np.int64), who, np.minimum.reduceat(kind, at)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[kept]) for c in columns], names=["band", "class", "n", "who", "least"]
            )

    rows = dealt.repartition("band").sortWithinPartitions("band")
    return rows.mapInArrow(run, "band long, class long, n long, who long, least long")


def links(classes: DataFrame, rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b): links between classes that span all components of the pairs that share a band and are similar. ``rows``
    (class, fp, shingles) are read only for classes that share a band; equal rows of a class are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "band"):
            band, kind, fp = (table.column(c).to_numpy() for c in ("band", "class", "fp"))
            lists = table.column("shingles").combine_chunks()
            edges = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1], [True])))
            found = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = lists.slice(a, b - a)
                ends = np.concatenate(([0], np.cumsum(part.value_lengths().to_numpy())))
                found += [(kind[a + i], kind[a + j]) for i, j in _groups(part.flatten().to_numpy(), ends, fp[a:b], least)]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        release()

    # (band, class) is all that moves of every band; bands of one class, which are most, end there
    members = stored(shared_bands(classes.select(F.explode("bands").alias("band"), "class")), "shared")
    once = members.groupBy("n", "who", "least").agg(F.min("band").alias("band")).select("band")
    wanted = stored(members.select("band", "class").join(small(stored(once, "shards")), "band"), "members")
    asked = small(stored(wanted.select("class").distinct(), "asked"))
    sets = rows.join(asked, "class", "left_semi").groupBy("class").agg(
        F.first("fp").alias("fp"), F.first("shingles").alias("shingles")
    )
    rows = wanted.join(sets, "class").select("band", "class", "fp", "shingles")
    return rows.repartition("band").sortWithinPartitions("band", "class").mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame, text: str = "text", id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """(id, content, fp, component_id, root) for every row; component_id is the smallest id of its component."""
    rows = stored(sets(docs, text, id), "sets", batch="8m")
    # the sets of shingles are as large as the texts and stay where they are
    classes = stored(rows.groupBy("class").agg(F.min("id").alias("first"), F.first("bands").alias("bands")), "classes")
    found = components(links(classes, rows.select("class", "fp", "shingles"), least))
    rooted = classes.join(found, F.col("class") == F.col("node"), "left").select(
        "class", "first", F.coalesce("root", "class").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select(F.col("class").alias("of"), "component_id", "root")
    return rows.join(named, F.col("class") == F.col("of")).select("id", "content", "fp", "component_id", "root")

