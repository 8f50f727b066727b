"""Recompression of word sequences: locally consistent parsing, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: Position marks between texts have this name; it never takes part in a rule.
BOUNDARY = U(0)


class WordNames(dict):
    """Names of words: their XXH64, never zero. Forgets all when full, which changes no name."""

    def __init__(self, seed: int = 42, most: int = 300_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        name = self[word] = xxhash.xxh64_intdigest(word, self.seed) or 1
        return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit names (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def combine(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return np.maximum(mix(mix(a + U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * U(3) + b), U(1))


def concatenated(names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All names with a boundary before each text and after the last, and the start of each text."""
    sizes = np.array([len(x) for x in names], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] + 1
    flat = np.zeros(int(sizes.sum()) + len(names) + 1, dtype=U)
    for s, x in zip(starts, names, strict=True):
        flat[s : s + len(x)] = x
    return flat, starts


def runs(ids, left, right, salt):
    """Replace each maximal run of one name; a block is known once its neighbours are."""
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (ids[1:] == BOUNDARY)]))
    last = np.concatenate([first[1:], [len(ids)]]) - 1
    count = (last - first + 1).astype(U)
    new = np.where(count > 1, combine(ids[first], count, salt), ids[first])
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(ids) - 1)
    return new, np.minimum(left[first], left[before]), np.maximum(right[last], right[after])


def pairs(ids, left, right, salt):
    """Merge each left-class name with a right-class name after it. A class is a bit of the scrambled name."""
    right_class = (mix(ids + U(salt)) >> U(17)) & U(1) == U(1)
    inner = ids != BOUNDARY
    merged = np.zeros(len(ids), dtype=bool)
    merged[:-1] = ~right_class[:-1] & right_class[1:] & inner[:-1] & inner[1:]
    second = np.concatenate([[False], merged[:-1]])
    before = np.concatenate([[0], np.arange(len(ids) - 1)])
    after = np.concatenate([np.arange(1, len(ids)), [len(ids) - 1]])
    # A left-class name looks at its successor only, a right-class name at its predecessor only.
    lo = np.where(right_class & inner, np.minimum(left, left[before]), left)
    hi = np.where(~right_class & inner, np.maximum(right, right[after]), right)
    new = ids.copy()
    at = np.flatnonzero(merged)
    new[at] = combine(ids[at], ids[at + 1], salt)
    lo[at], hi[at] = left[at], right[at + 1]
    keep = ~second
    return new[keep], lo[keep], hi[keep]


def parse(flat: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names after all rounds; for each, the first and last position on which it depends.

    Where two texts agree on those positions they hold the same name there: names come
    from hashes of what they stand for, so that all tasks agree on them without a dictionary.
    """
    ids, left = flat, np.arange(len(flat), dtype=np.int64)
    ids, left, right = runs(ids, left, left, 1)
    for r in range(rounds):
        ids, left, right = pairs(ids, left, right, 2 + r)
    inner = ids != BOUNDARY
    return ids[inner], left[inner], right[inner]
