"""Hashes of all words of a text at once, with NumPy.

The hash of a word is a polynomial of its bytes modulo 2^64, with a random number for each
byte value; prefix sums give it for every word of a block of text. Values are fixed by
seeds, so all workers and all runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from readmend.llm.common import SPACE

BLOCK = 1 << 18
_RANDOM = np.random.default_rng(20240601)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACE]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least n of them."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, BLOCK + 1)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        _powers[base] = got = np.multiply.accumulate(got)
    return got


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _blocks(data: bytes) -> Iterator[bytes]:
    """Pieces of about BLOCK bytes that end at white space."""
    at = 0
    while len(data) - at > BLOCK:
        cut = max(data.rfind(bytes([c]), at, at + BLOCK) for c in SPACE.encode())
        if cut <= at:  # one word longer than a block
            after = [p for c in SPACE.encode() if (p := data.find(bytes([c]), at + BLOCK)) >= 0]
            cut = min(after, default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_hashes(data: bytes, lower: bool = True) -> np.ndarray:
    """One 64-bit hash a word; `lower` takes A-Z for a-z."""
    if len(data) <= BLOCK:
        return _block_hashes(data, lower)
    return np.concatenate([_block_hashes(b, lower) for b in _blocks(data)])


def _block_hashes(data: bytes, lower: bool) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    solid = np.empty(len(b) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_IS_SPACE[b], out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[b] * _power(_BASE, len(b))[:len(b)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _power(_BASE_INVERSE, len(b))[starts])


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of all words as one run where there are fewer."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out += words[j:n - k + 1 + j] * _PLACES[j]
    return mixed(out)
