"""Block gzip: gzip members of at most 64 KiB that state their size, so that a file can be cut.

A range of a file's bytes owns the blocks that begin in it. A block is found by its header and
taken only if it decodes whole, checksum included. A byte's place in the file is its block's place
times 65536, plus its place in the block's text: the same at every range size, and in file order.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from readmend.config import InputError

# --- fixed values of the format ------------------------------------------------
_MAGIC = b"\x1f\x8b\x08\x04"      # gzip, deflate, an extra field and nothing else
_SIZE_FIELD = b"BC"
LARGEST = 1 << 16
# -------------------------------------------------------------------------------
_PIECE = 1 << 20


def block_size(head: bytes) -> int | None:
    """Bytes of the block whose header begins `head`; None if it is none."""
    if len(head) < 12 or head[:4] != _MAGIC:
        return None
    extra = head[12:12 + struct.unpack_from("<H", head, 10)[0]]
    while len(extra) >= 4:
        name, size = extra[:2], struct.unpack_from("<H", extra, 2)[0]
        if name == _SIZE_FIELD and size == 2 and len(extra) >= 6:
            return struct.unpack_from("<H", extra, 4)[0] + 1
        extra = extra[4 + size:]
    return None


def decoded(block: bytes) -> bytes | None:
    """The block's text; None if it is no whole gzip member."""
    member = zlib.decompressobj(31)
    try:
        text = member.decompress(block)
    except zlib.error:
        return None
    return text if member.eof and not member.unused_data else None


class BlockStream:
    """Text of the blocks that begin in [start, end), then of those behind, as `read` asks.

    It begins with the last byte before the range, if there is one (`before`): whether a line
    begins with the range depends on it. `limit` is where the owned text ends, once that is known.
    Offsets count from the first owned byte.
    """

    def __init__(self, file, size: int, start: int, end: int, path: str):
        self.file, self.size, self.end, self.path = file, size, end, path
        self.limit = None
        self.near, self.near_at = b"", 0
        self.begins, self.places, self.at_text = [], [], 0
        self.at, last = self._first(start) if start else (0, b"")
        self.before = bool(last)
        self.held = [last] if last else []

    def _block(self, at: int) -> tuple[bytes, int] | None:
        """(text, next block) of the block at `at`."""
        head = self._bytes(at)
        size = block_size(head)
        text = decoded(head[:size]) if size and size <= len(head) else None
        return None if text is None else (text, at + size)

    def _bytes(self, at: int) -> bytes:
        """What a block at `at` can take up; the file is read in pieces of 1 MiB."""
        a = at - self.near_at
        if a < 0 or a + LARGEST > len(self.near) and self.near_at + len(self.near) < self.size:
            self.file.seek(at)
            self.near, self.near_at, a = self.file.read(_PIECE), at, 0
        return self.near[a:a + LARGEST]

    def _first(self, start: int) -> tuple[int, bytes]:
        """Where the first block at or behind `start` begins, and the byte of text before it."""
        back = LARGEST
        while True:
            at, last = self._some_block(max(start - back, 0), start), b""
            while at < min(start, self.size):
                found = self._block(at)
                if found is None:
                    raise InputError(f"{self.path}: no whole block at byte {at}")
                last, at = found[0][-1:] or last, found[1]
            if last or back >= start:
                return at, last
            back *= 2  # only empty blocks so far

    def _some_block(self, low: int, start: int) -> int:
        """A block that begins at `low` or soon after it."""
        if low == 0:
            return 0
        self.file.seek(low)
        near = self.file.read(start - low + len(_MAGIC))
        at = near.find(_MAGIC)
        while at >= 0:
            if self._block(low + at) is not None:
                return low + at
            at = near.find(_MAGIC, at + 1)
        raise InputError(f"{self.path}: no block between bytes {low} and {start}")

    def read(self, n: int) -> bytes:
        """At least `n` bytes, less where the owned text or the file ends; b'' after the end."""
        out, self.held = self.held, []
        got = sum(map(len, out))
        while got < n and self.at < self.size:
            if self.limit is None and self.at >= self.end:
                self.limit = self.at_text
                if got:
                    break
            found = self._block(self.at)
            if found is None:
                raise InputError(f"{self.path}: no whole block at byte {self.at}")
            text, after = found
            self.begins.append(self.at_text)
            self.places.append(self.at)
            self.at_text += len(text)
            self.at = after
            out.append(text)
            got += len(text)
            if got and self.limit is not None:
                break
        if self.limit is None and self.at >= min(self.end, self.size):
            self.limit = self.at_text
        return b"".join(out)

    def place(self, offsets: np.ndarray) -> np.ndarray:
        """Places in the file of bytes of the text."""
        begins = np.asarray(self.begins, np.int64)
        block = np.searchsorted(begins, offsets, side="right") - 1
        return np.asarray(self.places, np.int64)[block] * LARGEST + offsets - begins[block]
