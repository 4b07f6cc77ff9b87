"""Word and shingle hashes of one text with numpy, and a fixed-size bitmap of hashes.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text; blanks and ASCII
punctuation separate them. The hashes are for finding candidates; verification compares words.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_IN_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_BYTE = np.where(_IN_WORD, np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64), np.uint64(0))
_PLACE = np.random.default_rng(8).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)
_SLOT = np.random.default_rng(9).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a lower-cased text."""
    inside = np.concatenate(([False], _IN_WORD[np.frombuffer(data, np.uint8)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per word; long texts go through in pieces of whole words."""
    raw, out, first = np.frombuffer(data, np.uint8), [], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _CHUNK)))
        begin, stop = int(starts[first]), int(ends[last - 1])
        piece = raw[begin:stop]
        own = starts[first:last] - begin
        place = np.arange(len(piece)) - np.repeat(own, np.diff(np.append(own, len(piece))))
        values = _BYTE[piece] * _PLACE[place & (len(_PLACE) - 1)]  # 0 between words
        out.append(mixed(np.add.reduceat(values, own)))
        first = last
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total += words[k : k + count] * _SLOT[k]
    return mixed(total)


def counted(words: list[str], size: int) -> Counter:
    """Shingles with their weights (how often each occurs); a shorter text is one shingle."""
    size = min(size, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if size else Counter()


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller weights over the sum of the larger ones; 0 for two empty texts."""
    low = sum(min(n, b[x]) for x, n in a.items())
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


# --- a bitmap of hashes; its size is fixed, whatever it holds


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of 2**bits places for the long column ``hash``: at most 2**(bits - 6) rows reach the driver."""
    place = F.shiftrightunsigned("hash", 64 - bits)
    rows = (
        hashes.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("word"))
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    for at, word in rows.toLocalIterator():
        out[at] = word
    return out.view(np.uint64)


def holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the bitmap; none that is in it is missed."""
    bits = int(table.size * 64).bit_length() - 1
    place = hashes >> np.uint64(64 - bits)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
