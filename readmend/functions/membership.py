"""Membership tests inside tasks, against data shipped to every executor.

The data (a filter's bit vector, or the sorted k-mers) is added to the session
as a file, so an executor fetches it once and its Python workers map the same
pages instead of holding a copy each. Callers check its size before shipping.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles

from readmend.config import PACKED_MAX_K
from readmend.functions import kmer_codes as kc
from readmend.functions.murmur import Keys
from readmend.sources import files

_MAPPED: dict[str, np.ndarray] = {}
#: k-mers that are looked up at once, so that what is made on the way stays in the cache.
_LOOKED_UP = 1 << 17


def _mapped(name: str, dtype) -> np.ndarray:
    """The shipped file as an array; a zero-length file is an empty array."""
    if name not in _MAPPED:
        path = SparkFiles.get(name)
        with open(path, "rb") as f:
            f.seek(0, 2)
            size = f.tell()
        _MAPPED[name] = np.memmap(path, dtype=dtype, mode="r") if size else np.zeros(0, dtype)
    return _MAPPED[name]


def keys_of(col: pa.Array, k: int) -> Keys:
    """Canonical k-mers, packed or strings."""
    if pa.types.is_integer(col.type):
        return Keys.of_packed(col.to_numpy(zero_copy_only=False).astype(np.int64, copy=False), k)
    return Keys.of_bytes(np.frombuffer("".join(col.to_pylist()).encode(), np.uint8).reshape(len(col), k))


def _all_set(bits: np.ndarray, keys: Keys, width_bits: int, seeds) -> np.ndarray:
    """Which keys have every seed's bit set."""
    found = np.zeros(len(keys), dtype=bool)
    left = np.arange(len(keys))
    for seed in seeds:
        position = keys.places(seed, width_bits)
        hit = np.flatnonzero((bits[position >> 3] >> (position & 7).astype(np.uint8)) & 1)
        left, keys = left[hit], keys.take(hit)
        if not len(left):
            break
    found[left] = True
    return found


_PART: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class FilterParts:
    """A filter's files. A worker holds the last part it was asked for."""

    prefix: str
    k: int
    part_bits: int
    seeds: tuple[int, ...]
    parts: int
    part_seed: int

    def path(self, part: int) -> str:
        return f"{self.prefix}.bf.data" + (f".{part:05d}" if self.parts > 1 else "")

    def part_of(self, keys: Keys | np.ndarray) -> np.ndarray:
        """Of keys or the rows of a byte matrix."""
        keys = keys if isinstance(keys, Keys) else Keys.of_bytes(keys)
        return (keys.hashes(self.part_seed) % np.uint32(self.parts)).astype(np.int32)

    def _bits(self, part: int) -> np.ndarray:
        path = self.path(part)
        if path not in _PART:
            _PART.clear()
            data = np.frombuffer(files.read_bytes(path), np.uint8)
            if 8 * len(data) != self.part_bits:
                raise ValueError(f"{path}: {self.part_bits // 8} bytes expected")
            _PART[path] = data
        return _PART[path]

    def contains(self, keys: Keys | np.ndarray, part: np.ndarray) -> np.ndarray:
        keys = keys if isinstance(keys, Keys) else Keys.of_bytes(keys)
        found = np.zeros(len(keys), dtype=bool)
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            found[mine] = _all_set(self._bits(int(p)), keys.take(mine), self.part_bits, self.seeds)
        return found


@dataclass(frozen=True)
class ShippedFilter:
    """Bloom bit vector: every seed's bit must be set."""

    file: str
    k: int
    width_bits: int
    seeds: tuple[int, ...]

    def contains(self, values: np.ndarray) -> np.ndarray:
        bits = _mapped(self.file, np.uint8).view(np.ndarray)
        found = np.empty(len(values), bool)
        for at in range(0, len(values), _LOOKED_UP):
            cut = slice(at, at + _LOOKED_UP)
            keys = (Keys.of_packed(values[cut].astype(np.uint64, copy=False), self.k) if self.k <= PACKED_MAX_K
                    else Keys.of_bytes(kc.to_bytes(values[cut], self.k)))
            found[cut] = _all_set(bits, keys, self.width_bits, self.seeds)
        return found


#: k-mers that share a prefix, about.
_A_PREFIX = 5


@dataclass(frozen=True)
class WordLayout:
    """Packed k-mers, mixed so that they lie evenly, sorted, and without what neighbours share: how many lie before
    each prefix (4 bytes), then the low `low_bits` bits of every k-mer, end to end."""

    k: int
    prefix_bits: int

    @staticmethod
    def of(num_kmers: int, k: int) -> WordLayout:
        """No more than `_A_PREFIX` k-mers a prefix on average, as far as there are prefixes."""
        return WordLayout(k, min((-(-max(num_kmers, 1) // _A_PREFIX) - 1).bit_length(), 2 * k - 1))

    @property
    def low_bits(self) -> int:
        return 2 * self.k - self.prefix_bits

    @property
    def table_bytes(self) -> int:
        """Of the table of prefixes, filled up to whole words."""
        return 4 * ((1 << self.prefix_bits) + 1) + 7 & ~7

    def size(self, num_kmers: int) -> int:
        return self.table_bytes + -(-num_kmers * self.low_bits // 64) * 8 + 16

    def mixed(self, values: np.ndarray) -> np.ndarray:
        """One to one, and spread over all words of 2 k bits."""
        mask, half = np.uint64((1 << 2 * self.k) - 1), np.uint64(self.k)
        out = values.astype(np.uint64, copy=False) * np.uint64(0x9E3779B97F4A7C15)
        out &= mask
        out ^= out >> half
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out &= mask
        out ^= out >> half
        return out

    def packed(self, mixed: np.ndarray) -> bytes:
        """The low bits of mixed k-mers, whose number is a multiple of 8, end to end, lowest bits first."""
        bits = self.low_bits
        rows = np.zeros((-(-len(mixed) // 64), 64), np.uint64)
        rows.ravel()[:len(mixed)] = mixed & np.uint64((1 << bits) - 1)
        out = np.zeros((len(rows), bits), "<u8")
        for j, low in enumerate(np.ascontiguousarray(rows.T)):
            word, at = divmod(j * bits, 64)
            out[:, word] |= low << np.uint64(at)
            if at + bits > 64:
                out[:, word + 1] |= low >> np.uint64(64 - at)
        return out.tobytes()[:len(mixed) * bits // 8]


@dataclass(frozen=True)
class ShippedWords:
    """The solid k-mers themselves, packed, in a `WordLayout`; no false positives."""

    file: str
    layout: WordLayout
    num_kmers: int
    k: int

    def contains(self, values: np.ndarray) -> np.ndarray:
        data, layout = _mapped(self.file, np.uint8).view(np.ndarray), self.layout
        before = data[:4 * ((1 << layout.prefix_bits) + 1)].view(np.uint32)
        words = data[layout.table_bytes:].view("<u8")
        out = np.empty(len(values), bool)
        for at in range(0, len(values), _LOOKED_UP):
            cut = slice(at, at + _LOOKED_UP)
            out[cut] = self._found(layout.mixed(values[cut]), before, words)
        return out

    def _found(self, mixed: np.ndarray, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        """As many k-mers of a prefix as fit a word are compared at once: a field that is equal is zero after `^`, and
        a borrow marks the lowest such field; marks above it may be wrong, so only whether there is one counts."""
        bits = np.uint64(self.layout.low_bits)
        fields = 64 // self.layout.low_bits
        ones = np.uint64(sum(1 << j * self.layout.low_bits for j in range(fields)))
        tops = np.array([sum(1 << (j + 1) * self.layout.low_bits - 1 for j in range(n))
                         for n in range(fields + 1)], np.uint64)
        mask, last = np.uint64((1 << int(bits)) - 1), np.uint64((fields - 1) * int(bits))
        prefix = (mixed >> bits).view(np.int64)
        at = before[prefix].astype(np.int64)
        prefix += 1
        left = before[prefix] - at
        wanted = mixed & mask
        found = np.zeros(len(mixed), bool)
        rows = None  # all
        while len(at):
            bit = at.view(np.uint64) * bits
            place = (bit >> np.uint64(6)).view(np.int64)
            bit &= np.uint64(63)
            here = words[place] >> bit
            place += 1
            bit ^= np.uint64(63)
            here |= (words[place] << np.uint64(1)) << bit
            differ = wanted * ones
            differ ^= here
            marks = differ - ones
            np.invert(differ, out=differ)
            marks &= differ
            marks &= tops[np.minimum(left, fields)]
            hit = marks != 0
            if rows is None:
                found[:] = hit
            else:
                found[rows] = hit
            here >>= last
            here &= mask
            on = np.flatnonzero((left > fields) & (here < wanted) & ~hit)
            rows = on if rows is None else rows[on]
            at, left, wanted = at[on] + fields, left[on] - fields, wanted[on]
        return found


@dataclass(frozen=True)
class ShippedKmers:
    """The solid k-mers above 31 bases, sorted strings; no false positives."""

    file: str
    k: int

    def contains(self, values: np.ndarray) -> np.ndarray:
        keys = _mapped(self.file, f"S{self.k}")
        values = kc.to_bytes(values, self.k).view(f"S{self.k}").ravel()
        if not len(keys):
            return np.zeros(len(values), dtype=bool)
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        return keys[at] == values
