"""Minimal perfect hashing of 64-bit keys in numpy: n distinct keys get the numbers 0 .. n - 1, in about five bits a key.

Each level is a bit array of twice as many places as keys are left; a key alone at its place is settled there, the others go
to the next level. A key's number is the count of set bits before its own. A key outside the set gets any number or -1, so
users compare the stored key at that number.
"""

from __future__ import annotations

import numpy as np

_LEVELS = 64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """The splitmix64 finaliser (its public constants) of the keys, different for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Mphf:
    def __init__(self, words: list[np.ndarray]):
        #: bits of each level, 64 to a word, and the count of set bits before each word
        self.words = words
        self.before, total = [], 0
        for level in words:
            ones = np.bitwise_count(level).astype(np.int64)
            self.before.append((total + np.cumsum(ones) - ones).astype(np.uint32))
            total += int(ones.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> Mphf:
        """For distinct keys, in any order."""
        words, left = [], keys
        while len(left):
            if len(words) == _LEVELS:
                raise ValueError("keys are not distinct")
            places = 64 * max(1, -(-2 * len(left) // 64))
            at = (mix(left, len(words)) % np.uint64(places)).astype(np.int64)
            alone = np.bincount(at, minlength=places) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(words)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where no level has it."""
        out, left, todo = np.full(len(keys), -1, np.int64), np.asarray(keys), np.arange(len(keys))
        for k, (level, before) in enumerate(zip(self.words, self.before)):
            if not len(todo):
                break
            at = mix(left, k) % np.uint64(64 * len(level))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            found = level[word]
            hit = (found >> bit) & np.uint64(1) == 1
            lower = found[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = before[word[hit]] + np.bitwise_count(lower)
            todo, left = todo[~hit], left[~hit]
        return out

    def pack(self) -> bytes:
        sizes = np.array([len(self.words), *map(len, self.words)], "<u4")
        return sizes.tobytes() + b"".join(w.astype("<u8").tobytes() for w in self.words)

    @classmethod
    def unpack(cls, data: bytes) -> Mphf:
        levels = int(np.frombuffer(data, "<u4", 1)[0])
        sizes = np.frombuffer(data, "<u4", levels, 4).tolist()
        rest = np.frombuffer(data, np.uint8, offset=4 * (levels + 1)).copy().view("<u8")
        return cls(np.split(rest, np.cumsum(sizes)[:-1]) if levels else [])
