"""Word shingles, MinHash bands and exact similarity, shared by the
near-duplicate operators.

Words are what white space separates, ASCII letters in lower case; a set has
the distinct five-word shingles, or, of a shorter text, all its words as one.
Sets hold 64-bit hashes in order. All of it runs on numpy arrays inside
tasks; nothing here sees more than one text at a time.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
THRESHOLD = 75  # percent: 100 * intersection >= THRESHOLD * union
WORDS_KEPT = 500_000  # word hashes that a worker remembers
ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


WORDS = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().lower().split()  # of bytes: ASCII letters, ASCII white space
    return np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's word hashes."""
    n = len(words)
    if not n:
        return words
    size = min(SHINGLE_WORDS, n)
    rolled = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        rolled = mixed(rolled * ODD + words[i : n - size + 1 + i])
    return np.unique(rolled)


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def tuned(recall: float, rows: int, threshold: float = THRESHOLD / 100) -> int:
    """Bands of ``rows`` samples that a pair at the threshold needs in order
    to share one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class Banding:
    """``bands`` times ``rows`` MinHash samples."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        seeds = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * ODD)
        self.times, self.plus = seeds[::2] | np.uint64(1), seeds[1::2]

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        """The minimum under each hash function; long sets go block by block."""
        least = np.full(len(self.times), np.iinfo(np.uint64).max, dtype=np.uint64)
        for start in range(0, len(shingles), 2048):
            block = shingles[start : start + 2048, None] * self.times + self.plus
            np.minimum(least, block.min(axis=0), out=least)
        return least

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """One 64-bit key per band, of one or many lists of samples."""
        parts = samples.reshape(*samples.shape[:-1], self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for i in range(self.rows):
            key = mixed(key * ODD + parts[..., i])
        return key.view(np.int64)

    def of_many(self, words: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Set digests and band keys of consecutive texts at once: ``words``
        are their word hashes, ``counts`` how many each has (all at least
        ``SHINGLE_WORDS``). A set's digest adds up two hashes of its members."""
        own = np.repeat(np.arange(len(counts)), counts)
        rolled = np.full(len(words) - SHINGLE_WORDS + 1, SHINGLE_WORDS, dtype=np.uint64)
        for i in range(SHINGLE_WORDS):
            rolled = mixed(rolled * ODD + words[i : len(rolled) + i])
        inside = own[: len(rolled)] == own[SHINGLE_WORDS - 1 :]
        held, own = rolled[inside], own[: len(rolled)][inside]
        order = np.lexsort((held, own))
        held, own = held[order], own[order]
        fresh = np.r_[True, (held[1:] != held[:-1]) | (own[1:] != own[:-1])]
        held, own = held[fresh], own[fresh]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sums = np.stack([np.add.reduceat(mixed(held ^ times), starts) for times in self.times[:2]], axis=1)
        samples = np.stack([np.minimum.reduceat(held * t + p, starts) for t, p in zip(self.times, self.plus, strict=True)], axis=1)
        return [row.tobytes() for row in sums], self.keys(samples)


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether 100 * intersection >= threshold * union, of sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those ``pairs`` (``a``, ``b``) whose full sets are similar enough.
    ``sets``: ``id`` and ``shingles`` (binary, little-endian 64-bit)."""
    import pyarrow as pa

    def verify(batches):
        for batch in batches:
            sides = [[np.frombuffer(x.as_buffer(), dtype="<u8") for x in batch.column(c)] for c in ("set_a", "set_b")]
            keep = pa.array([linked(x, y) for x, y in zip(*sides, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    a, b = (sets.select(F.col("id").alias(s), F.col("shingles").alias(f"set_{s}")) for s in "ab")
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(verify, f"a {kind}, b {kind}")


def shared_bits(a: Column, b: Column, longs: int) -> Column:
    """Bits in which two sketches (arrays of ``longs`` numbers) differ."""
    differ = [F.bit_count(F.element_at(a, i).bitwiseXOR(F.element_at(b, i))) for i in range(1, longs + 1)]
    return sum(differ[1:], differ[0])
