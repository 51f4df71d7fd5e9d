"""64-bit hashing of words, shingles and sets in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from spanloom.functions.text import words

_WORDS_KEPT = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)  # odd constant near 2**64 / golden ratio


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes of words, remembered for as many as a worker's memory should hold."""

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The word hashes of all texts in a row, and the number of words of each."""
        if len(self._known) > _WORDS_KEPT:
            self._known.clear()
        known, flat, counts = self._known, [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            ws = words(t)
            counts[i] = len(ws)
            try:
                flat.extend([known[w] for w in ws])
            except KeyError:
                for w in ws:
                    if w not in known:
                        known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                flat.extend([known[w] for w in ws])
        return np.array(flat, np.uint64), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``k`` consecutive words: (hash, text, place of its first word in the text)."""
    n = len(hashes)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    if n < k:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * _ODD + hashes[i : n - k + 1 + i])
    inside = place[: n - k + 1] + k <= counts[text[: n - k + 1]]
    return out[inside], text[: n - k + 1][inside], place[: n - k + 1][inside]


def distinct_by_text(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted within the text."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[fresh], t[fresh]


def set_hashes(hashes: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """One hash for each text's set of hashes, whatever their order."""
    sums = np.zeros(n_texts, np.uint64)
    np.add.at(sums, text, mix(hashes ^ _ODD))
    sizes = np.bincount(text, minlength=n_texts).astype(np.uint64)
    return mix(sums + mix(sizes))
