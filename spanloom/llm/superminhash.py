"""SuperMinHash signatures of many sets at once.

Every element walks through a random permutation of the slots, one slot a step; in step ``j`` it
offers ``j`` plus a random fraction to its slot. As an element offers different ranks to different
slots, estimates vary less than with independent slots. A set stops as soon as every slot holds
less than any later step could offer, which for sets of some fifty elements is after a few steps.
"""

from __future__ import annotations

import numpy as np

from spanloom.functions.hashing import mix

_STEP = np.uint64(0xD1342543DE82EF95)  # odd multiplier that tells the steps' random numbers apart


def signatures(elements: np.ndarray, owner: np.ndarray, n_sets: int, slots: int) -> np.ndarray:
    """(n_sets, slots) values; ``owner`` is the set of each element, sorted. Empty sets stay infinite."""
    best = np.full(n_sets * slots, np.inf)
    if not len(elements):
        return best.reshape(n_sets, slots)
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(elements), 1))
    live = np.arange(len(elements))
    for j in range(slots):
        seeds, who = elements[live], owner[live]
        with np.errstate(over="ignore"):
            random = mix(seeds + np.uint64(j + 1) * _STEP)
        fraction = (random & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32
        swap = j + ((random >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        slot = order[live, swap]
        order[live, swap] = order[live, j]
        np.minimum.at(best, who * slots + slot, fraction + j)
        going = best.reshape(n_sets, slots).max(axis=1) > j + 1
        keep = going[who]
        if not keep.all():
            live = live[keep]
            if not len(live):
                break
    return best.reshape(n_sets, slots)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of common elements: that of equal slots."""
    return float(np.mean(a == b))


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """(n_sets, bands) keys, one for every ``rows`` slots; equal only if all of them are."""
    bits = np.ascontiguousarray(values).view(np.uint64)
    n, slots = bits.shape
    bits = bits.reshape(n, slots // rows, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, slots // rows + 1, dtype=np.uint64) * _STEP, bits.shape[:2])
        for r in range(rows):
            key = mix(key * _STEP + bits[:, :, r])
    return key
