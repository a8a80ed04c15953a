"""Bloom filter sizes as expressions, and a filter over keys with mergeable bits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.records import fnv1a_64


def bits(n: Column, rate: Column) -> Column:
    """m = -n ln p / (ln 2)^2, rounded up."""
    return F.ceil(-n * F.log(rate) / F.lit(math.log(2) ** 2)).cast("long")


def hashes(m: Column, n: Column) -> Column:
    """k = m/n ln 2, rounded, at least 1."""
    return F.greatest(F.lit(1), F.round(m / n * math.log(2))).cast("long")


def false_positives(m: Column, k: Column, n: Column) -> Column:
    return F.pow(1 - F.exp(-(k * n) / m), k)


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class BloomFilter:
    """Membership of byte keys; never a false no. Filters of one size can be joined bit by bit."""

    def __init__(self, expected: int, rate: float):
        if expected < 1 or not 0 < rate < 1:
            raise ValueError("expected must be positive and rate between 0 and 1")
        self.m = max(1, math.ceil(-expected * math.log(rate) / math.log(2) ** 2))
        self.k = max(1, round(self.m / expected * math.log(2)))
        self.array, self.added = np.zeros(self.m, bool), 0

    def _at(self, keys: list[bytes]) -> np.ndarray:
        """k positions for each key: steps of one hash from another, both finished so that all their bits differ."""
        h = fnv1a_64(keys)
        a, b = _finished(h), _finished(h ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return np.stack([(a + np.uint64(i) * b) % np.uint64(self.m) for i in range(self.k)])

    def add(self, *keys: bytes) -> None:
        if keys:
            self.array[self._at(list(keys)).ravel().astype(np.int64)] = True
            self.added += len(keys)

    def contains(self, key: bytes) -> bool:
        return bool(self.array[self._at([key]).ravel().astype(np.int64)].all())

    def clear(self) -> None:
        self.array[:] = False
        self.added = 0

    def estimated_rate(self) -> float:
        return (1 - math.exp(-self.k * self.added / self.m)) ** self.k

    def union(self, other: BloomFilter) -> BloomFilter:
        if (self.m, self.k) != (other.m, other.k):
            raise ValueError("filters of different sizes cannot be joined")
        self.array |= other.array
        self.added += other.added
        return self

    def dumps(self) -> bytes:
        return b"".join(x.to_bytes(8, "little") for x in (self.m, self.k, self.added)) + np.packbits(self.array).tobytes()

    @classmethod
    def loads(cls, raw: bytes) -> BloomFilter:
        out = cls.__new__(cls)
        out.m, out.k, out.added = (int.from_bytes(raw[i : i + 8], "little") for i in (0, 8, 16))
        out.array = np.unpackbits(np.frombuffer(raw[24:], np.uint8))[: out.m].astype(bool)
        return out
