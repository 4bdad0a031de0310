"""Word and shingle hashes, in numpy, for code that runs inside tasks; and fixed-size
bitmaps that spare tasks rows which cannot match."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
PRIME = 0x9E3779B97F4A7C15
CACHED_WORDS = 400_000


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered for so many words at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=U, count=len(ws))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive values; none if there are fewer."""
    if len(h) < n:
        return np.empty(0, dtype=U)
    out, p = np.zeros(len(h) - n + 1, dtype=U), U(PRIME)
    for k in range(n):
        out = out * p + h[k : len(h) - n + 1 + k]
    return mixed(out)


def split_words(text: bytes | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of UTF-8 text: bytes.split() parts at just these."""
    return text.split() if text else []


#: Bits of a bitmap per key, and the most bits of one: 64 MB.
BITS_PER_KEY, MOST_BITS = 64, 1 << 29


def bitmap(df: DataFrame, key: Column) -> tuple[np.ndarray, int]:
    """A bitmap with the bit of every long key set, and its number of bits: a power of two
    that follows the number of keys up to MOST_BITS. It is gathered as rows of 4 kB."""
    bits = 1 << 20
    n = df.count()
    while bits < min(n * BITS_PER_KEY, MOST_BITS):
        bits *= 2
    place = key.bitwiseAND(F.lit(bits - 1)) + 1
    rows = (df.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")))
    size = 32768 // 8
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows.collect():
        # places from 1 on have buckets from 1 on
        out[(r["bucket"] - 1) * size : r["bucket"] * size] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out, bits


def in_bitmap(bits_set: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which int64 keys may be in the bitmap."""
    k = keys.astype(np.int64, copy=False) & (bits - 1)
    return (bits_set[k >> 3] >> (k & 7).astype(np.uint8)) & 1 > 0
