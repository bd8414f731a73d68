"""What the corpus operators share: inputs, row numbers, word hashes."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deleted or split on: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(text: str = "text") -> Column:
    """A text column as UTF-8 bytes; null as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def fractions_of(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


class Remembered(dict):
    """What a task remembers of strings, within so many bytes; beyond them it starts over."""

    #: Bytes that an entry costs beside its key and value, and the share of all bytes that one entry may take.
    OWN, SHARE = 150, 64

    def __init__(self, most_bytes: int) -> None:
        super().__init__()
        self.most_bytes, self.held = most_bytes, 0

    def remember(self, key, value, size: int):
        size += self.OWN
        if size <= self.most_bytes // self.SHARE:
            if self.held + size > self.most_bytes:
                self.clear()
                self.held = 0
            self[key] = value
            self.held += size
        return value


class WordHashes(Remembered):
    """64-bit hashes of words."""

    def __init__(self, most_bytes: int = 24 << 20) -> None:
        super().__init__(most_bytes)

    def __missing__(self, word: bytes) -> int:
        return self.remember(word, xxhash.xxh64_intdigest(word), len(word))

    def of(self, words: Iterable[bytes], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, n)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Scrambled polynomial hashes of all runs of ``k`` words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(0x100000001B3)
        h += words[j : j + n]
    return mixed(h)
