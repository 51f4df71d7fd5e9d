"""Evaluation items inside a corpus: n-gram seeds, then Smith-Waterman alignment.

Items are a stated query set; they are worked off in blocks of bounded size, each of which is
broadcast. Every n-gram of a block's items is a seed, however common it is, so an edited copy is met
by any ``n`` words left in a row. A scan looks up the seeds in each whole document, groups the hits
by diagonal and aligns the item with the words around them, many pairs at a time. The score of the
alignment decides whether a pair is a finding.

Where only runs of ``span`` words matter, fewer seeds do: a scan before counts in how many documents
each n-gram occurs, and the rarest that does occur in every window of ``span`` words of an item
becomes a seed. Documents never move; only counts and findings leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.arrow import arrow_schema, batch_of
from spanloom.functions.hashing import WordHasher, shingles
from spanloom.functions.text import decode
from spanloom.operators.parallel import spread

_FOUND = "doc_id long, item_id long, score long, share double, longest_run int, at_word long"
_CHUNK_CHARS = 500_000
_NEVER = 2**62
_CELLS = 200_000  # of a step of the alignment, over all pairs in it
MATCH, MISMATCH, GAP = 2, -1, -1


@dataclass
class Block:
    """Some items: their ids, word hashes, and the n-grams by hash."""

    ids: list[int]
    words: list[np.ndarray]
    grams: np.ndarray  # sorted distinct
    seeds: np.ndarray  # sorted (gram, item, place) rows, by gram
    item: np.ndarray
    place: np.ndarray


def _align_batch(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """``align`` of each pair as a row. Beyond a shorter item or text nothing is equal, so no score grows."""
    rows, n = len(items), max(map(len, texts))
    text, real = np.zeros((rows, n), np.uint64), np.zeros((rows, n), bool)
    item, lengths = np.zeros((rows, max(map(len, items))), np.uint64), np.array([len(x) for x in items])
    for k, (x, t) in enumerate(zip(items, texts)):
        item[k, : len(x)], text[k, : len(t)], real[k, : len(t)] = x, t, True
    reach = np.arange(n + 1, dtype=np.int32) * -GAP
    above, runs = np.zeros((rows, n + 1), np.int32), np.zeros((rows, n + 1), np.int32)
    out, each = np.zeros((rows, 3), np.int64), np.arange(rows)
    for i in range(item.shape[1]):
        equal = (text == item[:, i : i + 1]) & real & (lengths > i)[:, None]
        here = np.zeros((rows, n + 1), np.int32)
        here[:, 1:] = np.maximum(above[:, :-1] + np.where(equal, np.int32(MATCH), np.int32(MISMATCH)), above[:, 1:] + np.int32(GAP))
        np.maximum(here, 0, out=here)
        # a gap in the item: the best start to the left, less the way from it
        here = np.maximum.accumulate(here + reach, axis=1) - reach
        now = np.zeros((rows, n + 1), np.int32)
        now[:, 1:] = np.where(equal, runs[:, :-1] + 1, 0)
        out[:, 2] = np.maximum(out[:, 2], now.max(axis=1))
        at = here.argmax(axis=1)
        top = here[each, at]
        better = top > out[:, 0]
        out[better, 0], out[better, 1] = top[better], at[better]
        above, runs = here, now
    return out


def align_many(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Of each pair: best local alignment score, the place in the text where it ends, longest common run."""
    out, order, at = np.zeros((len(items), 3), np.int64), sorted(range(len(texts)), key=lambda k: len(texts[k])), 0
    while at < len(order):
        past = at + 1
        while past < len(order) and (past + 1 - at) * len(texts[order[past]]) <= _CELLS:
            past += 1
        part = order[at:past]
        out[part] = _align_batch([items[k] for k in part], [texts[k] for k in part])
        at = past
    return out


def align(item: np.ndarray, text: np.ndarray, run: int) -> tuple[int, int, int]:
    """Best local alignment score, the place in the text where it ends, and the longest common run."""
    score, end, longest = align_many([item], [text])[0].tolist()
    return score, end, longest


def _numbers(texts: list[str], hasher: WordHasher) -> list[np.ndarray]:
    flat, counts = hasher.of_texts(texts)
    return np.split(flat, np.cumsum(counts)[:-1]) if len(texts) else []


def _texts(batches: Iterator[pa.RecordBatch], id_column: int, text_column: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, raw in zip(batch.column(id_column).to_pylist(), batch.column(text_column).to_pylist()):
            ids.append(i)
            texts.append(decode(raw))
            size += len(texts[-1])
            if size > _CHUNK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _occurrences(texts: list[str], grams: np.ndarray, n: int, hasher: WordHasher):
    """Where the texts hold one of the n-grams: (its number, text, place), and the texts' words."""
    hashes, counts = hasher.of_texts(texts)
    h, text, place = shingles(hashes, counts, n)
    at = np.searchsorted(grams, h)
    at[at == len(grams)] = 0
    hit = grams[at] == h if len(grams) else np.zeros(len(h), bool)
    return at[hit], text[hit], place[hit], hashes, np.cumsum(counts) - counts, counts


def _count_grams(grams: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = WordHasher(), np.zeros(len(grams), np.int64)
        for _, texts in _texts(batches, 0, 1):
            gram, text, *_ = _occurrences(texts, grams, n, hasher)
            once = np.unique(np.stack([gram, text]), axis=1)
            total += np.bincount(once[0], minlength=len(grams))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["gram", "n"])

    return run


def _find(block: Block, n: int, slack: int, least: list[float]):
    schema = arrow_schema(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        seeds = np.unique(block.seeds)
        for ids, texts in _texts(batches, 0, 1):
            gram, text, place, hashes, starts, counts = _occurrences(texts, seeds, n, hasher)
            if not len(gram):
                continue
            # each hit meets every item with that seed
            first = np.searchsorted(block.seeds, seeds[gram], "left")
            many = np.searchsorted(block.seeds, seeds[gram], "right") - first
            which = np.repeat(np.arange(len(gram)), many)
            seed = np.repeat(first, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            begin = place[which] - block.place[seed]  # where the item's first word would stand
            item, owner = block.item[seed], text[which]
            order = np.lexsort((begin, item, owner))
            begin, item, owner = begin[order], item[order], owner[order]
            near, i = [], 0  # text, item, and the part of the text to align
            while i < len(begin):
                d, k, lo = int(owner[i]), int(item[i]), int(begin[i])
                words = block.words[k]
                while i < len(begin) and owner[i] == d and item[i] == k:
                    lo = hi = int(begin[i])
                    while i < len(begin) and owner[i] == d and item[i] == k and begin[i] <= hi + len(words) + 2 * slack:
                        hi = int(begin[i])
                        i += 1
                    near.append((d, k, max(0, lo - slack), min(int(counts[d]), hi + len(words) + slack)))
            aligned = align_many([block.words[k] for _, k, _, _ in near], [hashes[starts[d] + a : starts[d] + b] for d, _, a, b in near])
            found: dict[tuple[int, int], tuple[int, int, int]] = {}
            for (d, k, a, _), (score, end, longest) in zip(near, aligned.tolist()):
                best = found.get((d, k), (0, 0, 0))
                found[d, k] = (max(best[0], score), a + end if score > best[0] else best[1], max(best[2], longest))
            yield batch_of(
                [(ids[d], block.ids[k], score, score / (MATCH * len(block.words[k])), longest, at) for (d, k), (score, at, longest) in found.items() if score >= least[k]],
                schema,
            )

    return run


def _block(ids: list[int], texts: list[str], n: int) -> Block:
    words = _numbers(texts, WordHasher())
    flat, counts = np.concatenate(words), np.array([len(w) for w in words], np.int64)
    h, item, place = shingles(flat, counts, n)
    order = np.argsort(h, kind="stable")
    return Block(ids, words, np.unique(h), h[order], item[order], place[order])


def _choose_seeds(block: Block, counts: dict[int, int], n: int, span: int) -> None:
    """Keeps the rarest n-gram of every window, of equals the last; short items are one window.
    What occurs in no document can't be met."""
    number = np.searchsorted(block.grams, block.seeds)
    often = np.array([counts.get(int(g), _NEVER) for g in number], np.int64)
    keep = np.zeros(len(often), bool)
    for k in range(len(block.ids)):
        mine = np.flatnonzero(block.item == k)
        mine = mine[np.argsort(block.place[mine])]
        width = max(1, min(span - n + 1, len(mine)))
        for i in range(len(mine) - width + 1):
            window = mine[i : i + width]
            keep[window[width - 1 - int(np.argmin(often[window][::-1]))]] = True
    keep &= often < _NEVER
    block.seeds, block.item, block.place = block.seeds[keep], block.item[keep], block.place[keep]


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    *,
    n: int = 5,
    span: int = 12,
    least_share: float = 0.5,
    only_runs: bool = False,
    slack: int = 16,
    block_chars: int = 5_000_000,
) -> DataFrame:
    """(document, item) pairs that align as well as ``span`` words in a row do.

    Any ``n`` consecutive words in common make a pair a candidate; it is a finding if its alignment
    scores at least what ``span`` matching words do, or ``least_share`` of the best score of a short
    item. So exact passages of ``span`` words are found, and longer ones with edits in them.
    ``only_runs``: exact passages of ``span`` words are wanted, and of the others only some are met;
    this saves most of the alignments.

    Output: ``doc_id``, ``item_id``, ``score`` (matching words count 2, others and gaps -1), its
    ``share`` of the item's best possible score, ``longest_run`` of common consecutive words (exact
    from ``span`` words on) and ``at_word``, where the best alignment ends in the document.

    Null, empty and shorter texts than ``n`` words, of documents or items, give no rows. Repeated
    rows of either table repeat findings. ``block_chars``: how much item text a pass may carry.
    Other columns are ignored.
    """
    docs = spread(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")))
    found: DataFrame | None = None

    def search(ids: list[int], texts: list[str]) -> DataFrame:
        block = _block(ids, texts, n)
        least = [MATCH * min(span, least_share * len(w)) for w in block.words]
        if not only_runs:
            return docs.mapInArrow(_find(block, n, slack, least), _FOUND)
        tallies = docs.mapInArrow(_count_grams(block.grams, n), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        _choose_seeds(block, {r.gram: r.n for r in tallies.toLocalIterator()}, n, span)
        return docs.mapInArrow(_find(block, n, slack, least), _FOUND)

    ids, texts, size = [], [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("item_text").cast("binary")).toLocalIterator():
        ids.append(row[0])
        texts.append(decode(bytes(row[1]) if row[1] is not None else None))
        size += len(texts[-1])
        if size > block_chars:
            part = search(ids, texts)
            found = part if found is None else found.unionByName(part)
            ids, texts, size = [], [], 0
    if ids:
        part = search(ids, texts)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else documents.sparkSession.createDataFrame([], _FOUND)
