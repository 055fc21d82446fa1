"""Word shingles of texts and their MinHash labels, as numpy arrays inside tasks."""

from __future__ import annotations

import numpy as np

SHINGLE = 5

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_STEPS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, hash and row of every word: ASCII letters in lower case, digits, all beyond ASCII."""
    solid = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & ~(np.concatenate([[False], solid[:-1]]) & ~edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid & ~(np.concatenate([solid[1:], [False]]) & ~edge[1:])) + 1 if len(data) else starts
    # Polynomial hash of each word: its bytes times powers counted from the word's end.
    value = np.zeros(len(starts), np.uint64)
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    longest = int(length.max()) if len(length) else 0
    live = np.searchsorted(-length[order], -np.arange(longest), side="left") if longest else []
    for i in range(longest):
        at = order[: live[i]]
        value[at] = (value[at] + _LOWER[data[starts[at] + i]].astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, mix(value), rows


def shingle_sets(
    hashes: np.ndarray, offsets: np.ndarray, size: int = SHINGLE
) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each stretch of words and their offsets.

    A stretch of fewer words than ``size`` has one shingle of all its words, an empty one none.
    """
    found, ends = [], [0]
    n = len(hashes)
    full = np.zeros(max(n - size + 1, 0), np.uint64)
    for t in range(size):
        full += hashes[t : n - size + 1 + t] * np.uint64(_STEPS[t % 5]) if len(full) else full
    full = mix(full)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= size:
            own = np.unique(full[a : b - size + 1])
        elif b > a:
            total = sum(int(h) * _STEPS[t] for t, h in enumerate(hashes[a:b])) + int(b - a)
            own = mix(np.array([total % 2**64], np.uint64))
        else:
            own = full[:0]
        found.append(own)
        ends.append(ends[-1] + len(own))
    return np.concatenate(found) if found else full[:0], np.array(ends)


def set_ids(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, as signed numbers; of an empty set the same one always."""
    totals = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(_STEPS[0])), dtype=np.uint64)])
    size = np.diff(offsets).astype(np.uint64)
    return mix(totals[offsets[1:]] - totals[offsets[:-1]] + size * np.uint64(_BASE)).view(np.int64)


def labels(values: np.ndarray, offsets: np.ndarray, groups: int, width: int, seed: int = 1) -> np.ndarray:
    """For each non-empty set ``groups`` hashes, each of ``width`` MinHash values and the group's number."""
    rng = np.random.default_rng(seed)
    short = (values >> np.uint64(32)).astype(np.uint32)
    starts = offsets[:-1]
    found = np.zeros((len(starts), groups), np.uint64)
    for g in range(groups):
        total = np.full(len(starts), g * 0x9E37 + 1, np.uint64)
        for _ in range(width):
            flip, factor = rng.integers(0, 2**32, 2, dtype=np.uint32)
            least = np.minimum.reduceat((short ^ flip) * (factor | np.uint32(1)), starts)
            total = mix(total * np.uint64(_BASE) + least)
        found[:, g] = total
    return found.view(np.int64)


def recall(similarity: float, groups: int, width: int) -> float:
    """Chance that two sets of this Jaccard similarity agree in a whole group."""
    return 1 - (1 - similarity**width) ** groups
