"""Bloom filters as bitmap aggregates: built, merged and probed by built-in functions.

A filter is a set of bitmaps of up to 32768 bits, one for each segment; an id belongs to one segment, so that nodes of any
size keep their error rate by having more segments, and small ones have a shorter bitmap.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32768
#: Hash functions for each bit of budget, and the fewest and most of them.
HASHES_PER_BIT, FEWEST, MOST = 0.69, 1, 30
#: Words of 64 bits of bitmaps that are built as so many numbers.
MAX_WORDS = 32


def hash_count(bits_per_key: float) -> int:
    return min(MOST, max(FEWEST, int(bits_per_key * HASHES_PER_BIT)))


def segments_for(rows: int, bits_per_key: float) -> int:
    return max(1, -(-int(rows * bits_per_key) // BITS))


def bits_for(rows: int, bits_per_key: float) -> int:
    """Bits of a segment's bitmap: whole bytes, at least eight."""
    return min(BITS, 8 * max(8, -(-int(rows * bits_per_key) // 8)))


def segment_of(id_: Column, segments: Column | int) -> Column:
    return F.pmod(F.xxhash64(id_, F.lit(-1)), F.lit(segments) if isinstance(segments, int) else segments).cast("int")


def probes(id_: Column, k: int, bits: int = BITS, seed: int = 0) -> Column:
    return F.array(*(F.pmod(F.xxhash64(id_, F.lit(n)), F.lit(bits)).cast("long") for n in range(seed, seed + k)))


def build(ids: DataFrame, by: list[str], id_col: str = "id", segments: int = 1, k: int = 7, bits: int = BITS, seed: int = 0) -> DataFrame:
    """(by..., segment, bitmap) from rows (by..., id). A bitmap aggregate takes 4 KB for each partial sum, which compresses well, so
    that Spark joins many of them to one task: short bitmaps are built as 64-bit words instead."""
    rows = ids.select(*by, segment_of(F.col(id_col), segments).alias("segment"), F.explode(probes(F.col(id_col), k, bits, seed)).alias("bit"))
    words = -(-bits // 64)
    if words > MAX_WORDS:
        return rows.groupBy(*by, "segment").agg(F.substring(F.bitmap_construct_agg("bit"), 1, bits // 8).alias("bitmap"))
    # bit b of byte a of a word, whose hexadecimal form has the bytes in order
    rows = rows.selectExpr(*(f"`{c}`" for c in by), "segment", "bit >> 6 AS word", "shiftleft(1L, cast((7 - ((bit >> 3) & 7)) * 8 + (bit & 7) AS int)) AS mask")
    held = rows.groupBy(*by, "segment").agg(*(F.bit_or(F.when(F.col("word") == w, F.col("mask"))).alias(f"_{w}") for w in range(words)))
    whole = F.unhex(F.concat(*(F.lpad(F.hex(F.coalesce(f"_{w}", F.lit(0).cast("long"))), 16, "0") for w in range(words))))
    return held.select(*by, "segment", F.substring(whole, 1, bits // 8).alias("bitmap"))


def merge(filters: DataFrame, by: list[str]) -> DataFrame:
    """Filters of larger groups: the union of their parts' bits."""
    return filters.groupBy(*by, "segment").agg(F.substring(F.bitmap_or_agg("bitmap"), F.lit(1), F.max(F.octet_length("bitmap"))).alias("bitmap"))


def _is_set(bitmap: Column, p: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(p, F.lit(8)).cast("int")) == 1


def words_of(bitmap: Column) -> Column:
    """A bitmap (of a multiple of 64 bits) as an array of numbers, in which a bit is found without making strings: a probe of many
    ids turns a bitmap into numbers once."""
    word = lambda digits: F.conv(digits, 16, -10).cast("long")
    return F.when(F.octet_length(bitmap) == 8, F.array(word(F.hex(bitmap)))).otherwise(F.transform(F.regexp_extract_all(F.hex(bitmap), F.lit("(.{16})"), F.lit(1)), word))


def _is_set_in(words: Column, p: Column) -> Column:
    """As _is_set, for words_of the bitmap, whose bytes run from the highest to the lowest."""
    return F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56)).cast("int")) == 1


def may_contain(bitmap: Column, bits: Column) -> Column:
    """Whether all probed bits are set: false is certain."""
    return F.forall(bits, lambda p: _is_set(bitmap, p))


def _power(n: float) -> int:
    """The smallest power of two that is at least n."""
    return 1 << max(0, math.ceil(n) - 1).bit_length()


@dataclass(frozen=True)
class FilterShape:
    """Sizes of the filters of a packed tree, by level: leaves (level 0) hold about `leaf_rows` ids, nodes of the next level
    `capacity` times as many. A leaf's filter has `bits_per_key` bits for an id, and each level above one bit less.

    Sizes are powers of two, and all bits of an id come from the same two hashes, so that a child's bits are a fold of its
    parent's and an id is hashed once for all levels. An id belongs to one segment of a filter."""

    leaf_rows: int
    capacity: int
    bits_per_key: float
    seed: int = 0

    def per_key(self, level: int) -> float:
        return max(1.0, self.bits_per_key - level)

    def _total(self, level: int) -> float:
        return self.leaf_rows * self.capacity**level * self.per_key(level)

    def segments(self, level: int) -> int:
        return _power(self._total(level) / BITS)

    def bits(self, level: int) -> int:
        return min(BITS, max(64, _power(self._total(level))))

    def hashes(self, level: int) -> int:
        return hash_count(self.per_key(level))

    def hashed(self, id_: Column) -> dict[str, Column]:
        """The two hashes that all levels use: one for the segment, one for the bits."""
        return {"_g": F.xxhash64(id_, F.lit(-1 - self.seed)), "_h": F.xxhash64(id_, F.lit(self.seed))}

    def segment(self, level: int) -> Column:
        return F.col("_g").bitwiseAND(F.lit(self.segments(level) - 1)).cast("int")

    def may_hold(self, words: Column, level: int) -> Column:
        """Whether all bits of an id are set in `words_of` a bitmap, one condition for each: the first clear bit ends the probe.
        False is certain."""
        low, high = F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("_h", 32).bitwiseOR(F.lit(1))
        return reduce(lambda x, y: x & y, (_is_set_in(words, (low + high * n).bitwiseAND(F.lit(self.bits(level) - 1))) for n in range(self.hashes(level))))

    def bitmaps(self, level: int, node: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(node, segment, bitmap) of ids, given by their nodes and hashes, that are all of a tree."""
        segments, bits = self.segments(level), self.bits(level)
        keys, at = np.unique(node * segments + (g & (segments - 1)), return_inverse=True)
        held = np.zeros(len(keys) * (bits // 8), np.uint8)
        low, high = h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF | 1
        for n in range(self.hashes(level)):
            bit = (low + high * n) & (bits - 1)
            np.bitwise_or.at(held, at * (bits // 8) + (bit >> 3), (1 << (bit & 7)).astype(np.uint8))
        return keys // segments, keys % segments, [row.tobytes() for row in held.reshape(len(keys), -1)]
