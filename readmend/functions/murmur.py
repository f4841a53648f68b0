"""MurmurHash3 x86_32 of many equally long keys at once, and its seeds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

_U = np.uint32
_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(32 - r))


def _scramble(word: np.ndarray) -> np.ndarray:
    return _rotl(word * _U(0xCC9E2D51), 15) * _U(0x1B873593)


@cache
def _scrambled_bases(n: int) -> np.ndarray:
    """Of every word of n bases, up to four, as characters: what a hash takes in."""
    digits = np.arange(4 ** n)[:, None] >> 2 * np.arange(n - 1, -1, -1) & 3
    return _scramble((_LETTERS[digits].astype(_U) << 8 * np.arange(n, dtype=_U)).sum(axis=1, dtype=_U))


@dataclass(frozen=True)
class Keys:
    """Equally long keys as every seed takes them in: the scrambled words of four bytes, then what is left, if any."""

    words: tuple[np.ndarray, ...]
    width: int

    @staticmethod
    def of_bytes(keys: np.ndarray) -> Keys:
        """The rows of an (n, width) uint8 matrix."""
        n, width = keys.shape
        whole = width // 4
        words = []
        if whole:
            words = list(_scramble(np.ascontiguousarray(keys[:, : whole * 4]).view("<u4")).T)
        if width % 4:
            tail = np.zeros(n, dtype=_U)
            for i in range(width % 4):
                tail |= keys[:, whole * 4 + i].astype(_U) << _U(8 * i)
            words.append(_scramble(tail))
        return Keys(tuple(words), width)

    @staticmethod
    def of_packed(values: np.ndarray, k: int) -> Keys:
        """The bases of packed k-mers, k up to 31, without spelling them."""
        values = values.view(np.uint64)
        words = [_scrambled_bases(4)[(values >> np.uint64(2 * left)).astype(np.uint8)]
                 for left in range(k - 4, -1, -4)]
        if k % 4:
            words.append(_scrambled_bases(k % 4)[(values & np.uint64(4 ** (k % 4) - 1)).astype(np.uint8)])
        return Keys(tuple(words), k)

    def __len__(self) -> int:
        return len(self.words[0])

    def take(self, rows) -> Keys:
        return Keys(tuple(w[rows] for w in self.words), self.width)

    def hashes(self, seed: int) -> np.ndarray:
        """Standard 32-bit variant."""
        whole = self.width // 4
        h = np.full(len(self), seed, dtype=_U)
        for word in self.words[:whole]:
            h ^= word
            high = h >> _U(19)
            h <<= _U(13)
            h |= high
            h *= _U(5)
            h += _U(0xE6546B64)
        for word in self.words[whole:]:
            h ^= word
        h ^= _U(self.width)
        h ^= h >> _U(16)
        h *= _U(0x85EBCA6B)
        h ^= h >> _U(13)
        h *= _U(0xC2B2AE35)
        h ^= h >> _U(16)
        return h

    def places(self, seed: int, width: int) -> np.ndarray:
        """The hashes modulo `width`, as int64."""
        h = self.hashes(seed)
        if width < 1 << 32:
            h -= h // _U(width) * _U(width)
        return h.astype(np.int64)


def murmur3_32(keys: np.ndarray, seed: int) -> np.ndarray:
    """Hash each row of an (n, width) uint8 matrix."""
    return Keys.of_bytes(keys).hashes(seed)


def libc_random(seed: int, count: int) -> list[int]:
    """The first values of the C library's additive-feedback `rand()`.

    The recurrence is r[i] = r[i-3] + r[i-31] mod 2**32 over a table filled by
    the Lehmer generator 16807 mod 2**31-1; the first 310 outputs are dropped
    and the lowest bit of each value is discarded.
    """
    r = [seed if seed else 1]
    for _ in range(30):
        r.append(r[-1] * 16807 % 2147483647)
    r += r[:3]
    while len(r) < 344 + count:
        r.append((r[-3] + r[-31]) & 0xFFFFFFFF)
    return [v >> 1 for v in r[344:]]
