"""Minimal perfect hashes over the 64-bit hashes of a shard's keys, with the keys stored by slot so that strangers are told apart."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_GAMMA = 2  # places of a level for each key that it is offered
_GOLDEN = 0x9E3779B97F4A7C15


def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    x = hashes + np.uint64((level + 1) * _GOLDEN & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) % np.uint64(size)


class PerfectHash:
    """Different hashes 0..n-1, by levels: a key takes its place on the first level where it has it alone; its slot is the place's rank."""

    def __init__(self, sizes: Sequence[int], words: np.ndarray):
        self.sizes, self.words = [int(s) for s in sizes], words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        """The hashes must differ from one another."""
        sizes, parts, left = [], [], hashes
        while len(left):
            size = -(-max(64, _GAMMA * len(left)) // 64) * 64
            at = _place(left, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(parts) if parts else np.empty(0, np.uint64))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each known hash; one that is not known gets any slot, or -1."""
        out, left, first = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            at = _place(hashes[left], level, size)
            word, bit = first + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = self.words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[word] + below)[hit]
            left, first = left[~hit], first + size // 64
            if not len(left):
                break
        return out


class Shard:
    """A perfect hash with its keys. Keys beyond the first of one hash follow in a short list that is compared as a whole."""

    def __init__(self, sizes: Sequence[int], words: bytes, keys: Sequence[bytes], clashing: int):
        self.hash, self.n = PerfectHash(sizes, np.frombuffer(words, np.uint64)), len(keys)
        self.keys = np.empty(len(keys), object)
        self.keys[:] = keys
        self.more = {k: i for i, k in enumerate(keys[len(keys) - clashing :], len(keys) - clashing)} if clashing else {}

    @staticmethod
    def pack(keys: Sequence[bytes], hashes: np.ndarray) -> tuple[list[int], bytes, list[bytes], int]:
        """(sizes, words, keys in slot order, clashing) of different keys, as `Shard` takes them."""
        known, first = np.unique(hashes, return_index=True)
        made = PerfectHash.build(known)
        ordered: list[bytes] = [b""] * len(first)
        for i, slot in zip(first, made.slots(known), strict=True):
            ordered[slot] = keys[i]
        rest = np.ones(len(keys), bool)
        rest[first] = False
        clashing = [keys[i] for i in np.flatnonzero(rest)]
        return made.sizes, made.words.tobytes(), ordered + clashing, len(clashing)

    def find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key (an object array), -1 for those that are not stored."""
        slots = self.hash.slots(hashes)
        same = (slots >= 0) & (self.keys[slots] == keys) if self.n else np.zeros(len(keys), bool)
        slots[~same] = -1
        if self.more:
            for i in np.flatnonzero(~same):
                slots[i] = self.more.get(keys[i], -1)
        return slots
