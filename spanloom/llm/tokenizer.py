"""A corpus as token ids of a byte-level BPE vocabulary.

Texts are split into pre-tokens by the vocabulary's pattern. Lookup has two tiers. A minimal perfect
hash over the vocabulary resolves a pre-token that is itself a token: one slot to compare. Others are
merged: a heap holds the ranks of adjacent pairs, over bytes linked to their neighbours, so that a
pre-token of n bytes takes n log n steps, however long it is. What a task has resolved it remembers,
within bounds. Nothing is shuffled.

The vocabulary file (base64 token and rank on each line) and its pattern are parameters. The tables
built from it have a fixed size and are broadcast.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.hashing import mix
from spanloom.functions.text import decode
from spanloom.operators.parallel import spread

_REMEMBERED = 300_000
_REMEMBERED_LENGTH = 64
_CHUNK_CHARS = 1_000_000


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: each gets its own slot of 0 to n - 1.

    In each level the keys are thrown at twice as many bits as there are keys; those that meet no
    other key stay, the rest go on to the next level. A key's slot is the rank of its bit.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, used = keys, 0
        while len(rest):
            place = self._place(rest, len(self.levels), 2 * len(rest))
            alone = np.bincount(place, minlength=2 * len(rest)) == 1
            self.levels.append((alone, used + np.cumsum(alone, dtype=np.int64) - 1))
            used += int(alone.sum())
            rest = rest[~alone[place]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        turn = np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
        return (mix(keys + turn) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that isn't one of them any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            place = self._place(keys[rest], level, len(bits))
            hit = bits[place]
            out[rest[hit]] = rank[place[hit]]
            rest = rest[~hit]
            if not len(rest):
                break
        return out


class Encoder:
    """Encodes pre-tokens; ``ranks`` maps the bytes of each token to its id, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        tokens = list(ranks)
        keys = self._keys(tokens)
        self.hash = PerfectHash(keys)
        self.tokens: list[bytes] = [b""] * len(tokens)
        self.ids: list[int] = [0] * len(tokens)
        for token, slot in zip(tokens, self.hash.slots(keys).tolist()):
            self.tokens[slot], self.ids[slot] = token, ranks[token]

    @staticmethod
    def _keys(tokens: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        slots = self.hash.slots(self._keys(pieces)).tolist()
        tokens, ids = self.tokens, self.ids
        return [[ids[s]] if s >= 0 and tokens[s] == p else self.merge(p) for p, s in zip(pieces, slots)]

    def merge(self, piece: bytes) -> list[int]:
        """Merges the adjacent pair of the lowest rank, the leftmost of equals, until none is left."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends
        before = list(range(-1, n))  # before[i]: where the part to the left of i starts
        heap = []
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                heap.append((r, i, i + 1, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue  # one of the two parts has changed since
            end[i], end[j], before[k] = k, -1, i
            if k < n and (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, k, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:k])) is not None:
                heapq.heappush(heap, (r, h, i, k))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _encode_texts(shared, pattern: str):
    split = regex.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder: Encoder = shared.value
        known: dict[str, list[int]] = {}

        def encoded(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
            nonlocal known
            if len(known) > _REMEMBERED:
                known = {}
            new = list(set(chain.from_iterable(texts)).difference(known))
            found = dict(zip(new, encoder.encode([t.encode("utf-8", "surrogatepass") for t in new])))
            short = {t: v for t, v in found.items() if len(t) <= _REMEMBERED_LENGTH}
            known.update(short)
            look = known.__getitem__ if len(short) == len(found) else lambda t: found.get(t) or known[t]
            lists = [list(chain.from_iterable(map(look, t))) for t in texts]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = decode(raw)
                ids.append(doc_id)
                texts.append(split.findall(text))
                size += len(text)
                if size > _CHUNK_CHARS:
                    yield encoded(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield encoded(ids, texts)

    return run


def encode_corpus(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row of ``documents``.

    Null and empty texts give an empty array; a null id stays null, repeated rows repeat. Special
    tokens are never produced: their spellings are ordinary text. Bytes that aren't UTF-8 count as
    U+FFFD. Other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Encoder(load_ranks(vocabulary)))
    narrow = spread(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")))
    return narrow.mapInArrow(_encode_texts(shared, pattern), "doc_id long, ids array<int>")
