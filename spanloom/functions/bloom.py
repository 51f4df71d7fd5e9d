"""A Bloom filter of bounded size, to keep most rows that can't match out of a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.functions.hashing import mix

_PROBES = 4


class Bloom:
    """Members are 64-bit hashes. It may pass others, never misses one."""

    def __init__(self, log2_bits: int, data: np.ndarray | None = None) -> None:
        self.mask = np.uint64((1 << log2_bits) - 1)
        self.bits = np.zeros(1 << (log2_bits - 3), np.uint8) if data is None else data

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        h = keys
        for _ in range(_PROBES):
            h = mix(h + np.uint64(0x9E3779B97F4A7C15))
            yield h & self.mask

    def add(self, keys: np.ndarray) -> None:
        for p in self._places(keys):
            np.bitwise_or.at(self.bits, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self._places(keys):
            out &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def build_bloom(keys: DataFrame, count: int, most_log2_bits: int = 27) -> Bloom:
    """Of a one-column table of longs. At most 16 MB whatever the count: beyond some 10 million
    members more of the others pass, which costs shuffle but no correctness."""
    log2_bits = min(most_log2_bits, max(13, (12 * max(1, count)).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Bloom(log2_bits)
        for b in batches:
            part.add(b.column(0).to_numpy().astype(np.int64).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([part.bits.tobytes()])], ["bits"])

    whole = Bloom(log2_bits)
    for (bits,) in keys.coalesce(4).mapInArrow(fill, "bits binary").toLocalIterator():
        whole.bits |= np.frombuffer(bits, np.uint8)
    return whole
