"""2-bit k-mer arithmetic on whole Arrow batches.

A k-mer is an unsigned integer with two bits a base (A, C, G, T = 0..3), first
base highest, so integer order is base order and the canonical form is the
smaller of a k-mer and its reverse complement. Up to 31 bases this is a uint64
array; beyond that NumPy object arrays of Python integers take its place and
the same expressions apply.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from readmend.config import PACKED_MAX_K

_CODE_OF = np.full(256, 255, dtype=np.uint8)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    for _ch in _pair:
        _CODE_OF[ord(_ch)] = _i
_BASE_OF = np.frombuffer(b"ACGT", dtype=np.uint8)


def word_type(k: int):
    return np.uint64 if k <= PACKED_MAX_K else object


def _word(value: int, k: int):
    return np.uint64(value) if k <= PACKED_MAX_K else value


def _narrow(bases: int, k: int):
    """The narrowest type on the way to a k-mer that holds so many bases."""
    if k > PACKED_MAX_K:
        return object
    return next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if 2 * bases <= 8 * t().itemsize)


def _shift(bits: int, word):
    return bits if word is object else word(bits)


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of a string column end to end, and offsets; null is ''."""
    col = col.cast(pa.large_string()).fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    return data, off - off[0]


def string_codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`string_bytes` as base codes; 255 is no base."""
    data, offsets = string_bytes(col)
    return _CODE_OF[data], offsets


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Packed value of every k-long run of a code array, by doubling."""
    power, span = codes.astype(_narrow(1, k)), 1
    out, done, left = None, 0, k
    while True:
        if left & 1:
            if out is None:
                out, done = power, span
            else:
                n, word = max(len(codes) - done - span + 1, 0), _narrow(done + span, k)
                out = (out[:n].astype(word) << _shift(2 * span, word)) | power[done:done + n]
                done += span
        left >>= 1
        if not left:
            return out.astype(word_type(k), copy=False)
        n, word = max(len(power) - span, 0), _narrow(2 * span, k)
        power = (power[:n].astype(word) << _shift(2 * span, word)) | power[span:span + n]
        span *= 2


def canonical_windows(codes: np.ndarray, offsets: np.ndarray, k: int):
    """Canonical k-mers of all strings laid end to end.

    Returns (values, start position in `codes`, counts per string, clean): only
    windows inside one string appear; `clean` marks those without odd characters.
    """
    bad = codes > 3
    codes = np.where(bad, 0, codes).astype(np.uint8)
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - k + 1, 0)
    total = int(counts.sum())
    if total == 0:
        return (np.zeros(0, word_type(k)), np.zeros(0, np.int64), counts, np.zeros(0, bool))
    first = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    start = np.arange(total) + first
    forward = rolling(codes, k)[start]
    reverse = rolling((3 - codes)[::-1], k)[::-1][start]
    bad_before = np.concatenate(([0], np.cumsum(bad)))
    clean = bad_before[start + k] == bad_before[start]
    return np.minimum(forward, reverse), start, counts, clean


def word_bases(k: int) -> list[int]:
    """Bases in each word of a k-mer that is kept as several words, first bases first."""
    return [PACKED_MAX_K] * ((k - 1) // PACKED_MAX_K) + [(k - 1) % PACKED_MAX_K + 1]


def clean_starts(codes: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Where in `codes` a window without odd characters begins, of all strings laid end to end."""
    clean = np.ones(max(len(codes) - k + 1, 0), bool)
    odd = np.flatnonzero(codes > 3)
    for at in (odd, offsets[1:-1] - 1):  # a window may begin at neither of the k - 1 places before such a one ...
        for back in range(k - 1):
            here = at - back
            clean[here[(here >= 0) & (here < len(clean))]] = False
    first = odd - (k - 1)  # ... and an odd character may not be its last one
    clean[first[(first >= 0) & (first < len(clean))]] = False
    return np.flatnonzero(clean)


def canonical_words(codes: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Canonical k-mers that begin at `start`, a row of words each; the order of rows, word by
    word, is base order at every k."""
    widths = word_bases(k)
    if not len(start):
        return np.zeros((0, len(widths)), np.uint64)
    codes = np.where(codes > 3, 0, codes).astype(np.uint8)
    back = (3 - codes)[::-1]
    rolled = {w: (rolling(codes, w), rolling(back, w)) for w in set(widths)}
    begins = np.cumsum([0, *widths[:-1]])
    there = np.stack([rolled[w][0][start + b] for w, b in zip(widths, begins)], 1)
    end = len(codes) - k - start  # where the window begins in `back`
    other = np.stack([rolled[w][1][end + b] for w, b in zip(widths, begins)], 1)
    less, same = np.zeros(len(start), bool), np.ones(len(start), bool)
    for a, b in zip(there.T, other.T):
        less |= same & (b < a)
        same &= a == b
    there[less] = other[less]
    return there


_NIBBLES, _PAIRS = np.uint64(0x0F0F0F0F0F0F0F0F), np.uint64(0x3333333333333333)


def _other_strand(words: np.ndarray, bases: int) -> np.ndarray:
    """Reverse complement of packed words of so many bases."""
    out = (~words).byteswap()
    out = ((out >> np.uint64(4)) & _NIBBLES) | ((out & _NIBBLES) << np.uint64(4))
    out = ((out >> np.uint64(2)) & _PAIRS) | ((out & _PAIRS) << np.uint64(2))
    return out >> np.uint64(64 - 2 * bases)


def packed_words(data: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """`canonical_words` of bases that lie four to a byte in `data`, first bases highest."""
    data = np.concatenate((data, np.zeros(9, np.uint8)))
    eight = np.ndarray((len(data) - 8,), ">u8", data, 0, (1,))

    def cut(at, bases):
        byte, bits = at >> 2, ((at & 3) << 1).astype(np.uint64)
        out = eight[byte].astype(np.uint64) << bits
        if bases > 29:  # the last ones may lie in a ninth byte
            out |= data[byte + 8].astype(np.uint64) >> (np.uint64(8) - bits)
        return out >> np.uint64(64 - 2 * bases)

    widths = word_bases(k)
    there = np.empty((len(start), len(widths)), np.uint64)
    other = np.empty_like(there)
    begin = 0
    for i, w in enumerate(widths):
        there[:, i] = cut(start + begin, w)
        other[:, i] = _other_strand(there[:, i] if k == w else cut(start + (k - begin - w), w), w)
        begin += w
    if len(widths) == 1:
        return np.minimum(there, other)
    less, same = np.zeros(len(start), bool), np.ones(len(start), bool)
    for a, b in zip(there.T, other.T):
        less |= same & (b < a)
        same &= a == b
    there[less] = other[less]
    return there


def _mixed(words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words), np.uint64)
    for word in words.T:
        h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def counted(words: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each row of `words` once with its sum of `n` (or how often it comes). Several words are sorted
    by a hash of them; where two different rows share one, by all their words."""
    if not len(words):
        return words, np.zeros(0, np.int64)
    if n is None and words.shape[1] == 1:
        words = np.sort(words, axis=0)
        new = words[1:, 0] != words[:-1, 0]
    else:
        if words.shape[1] == 1:
            keys = words[:, 0]
            order = np.argsort(keys)
            keys = keys[order]
        else:  # the low bits of the hash make room for the place, so that values are sorted and no places
            places = np.uint64((1 << (len(words) - 1).bit_length()) - 1)
            keys = np.sort((_mixed(words) & ~places) | np.arange(len(words), dtype=np.uint64))
            order, keys = (keys & places).astype(np.int64), keys & ~places
        ordered = words[order]
        new = (ordered[1:] != ordered[:-1]).any(axis=1)
        if (new & (keys[1:] == keys[:-1])).any():
            order = np.lexsort(words.T[::-1])
            ordered = words[order]
            new = (ordered[1:] != ordered[:-1]).any(axis=1)
        words, n = ordered, None if n is None else n[order]
    first = np.flatnonzero(np.concatenate(([True], new)))
    sums = np.diff(np.append(first, len(words))) if n is None else np.add.reduceat(n, first)
    return words[first], sums.astype(np.int64)


def to_bytes(values: np.ndarray, k: int) -> np.ndarray:
    """Packed k-mers to an (n, k) matrix of base characters."""
    out = np.empty((len(values), k), dtype=np.uint8)
    for j in range(k):
        digit = (values >> _word(2 * (k - 1 - j), k)) & _word(3, k)
        out[:, j] = _BASE_OF[digit.astype(np.int64)]
    return out


def list_array(counts: np.ndarray, values: pa.Array) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def strings_from_codes(codes: np.ndarray, lengths: np.ndarray,
                       alphabet: np.ndarray = _BASE_OF) -> pa.Array:
    """Codes of many strings laid end to end, to a string array."""
    data = alphabet[codes].tobytes()
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.StringArray.from_buffers(
        len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
