"""Token ids of documents in binary files with Elias-Fano coded boundaries.

A shard holds the ids of consecutive documents (ascending doc_id, nulls first, equal ones
by text), 16 or 32 bits each, then two Elias-Fano sequences, the document boundaries and
the doc_ids, then a footer:

    ids | low bits, high bits, select samples of the boundaries | the same of the doc_ids
    | footer (struct FOOTER) | its length, 4 bytes | magic, 4 bytes

Elias-Fano keeps the l lowest bits of each of n non-decreasing numbers below u in an array
and the rest in unary, 2 + log2(u / n) bits a number in all. The i-th number is found by
`select`: a sample names the place of every `SAMPLE`-th one-bit of the unary part, and the
bits from there are counted. There is no table of 64-bit offsets.

A shard's place among all ids follows from the sums of the shards before it, one row a
shard. A null text is an empty one: its document has just the end id. An empty table
writes nothing and gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmend.llm import shards
from readmend.llm.common import scratch_path, stored
from readmend.llm.tokens import END_ID, open_tokenizer

MAGIC = b"RMT1"
SAMPLE = 256
#: width of an id in bytes; documents, documents without id, ids; then of each sequence:
#: base, low bits, bytes of the low part, bits of the high part
FOOTER = struct.Struct("<B QQQ qBQQ qBQQ")
#: Documents of one reading task.
SLICE = 2000
SHARDS = "part int, path string, docs long, ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(0, np.uint8)
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")


def _unpacked(data: np.ndarray, first: int, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint64)
    at = first * width
    bits = np.unpackbits(data[at // 8:(at + n * width + 7) // 8], bitorder="little")
    bits = bits[at % 8:at % 8 + n * width].reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)


@dataclass
class EliasFano:
    """Non-decreasing integers."""

    n: int
    base: int
    width: int          # low bits of a number
    low: np.ndarray     # uint8
    high: np.ndarray    # uint8; number i sets bit (value >> width) + i
    high_bits: int
    samples: np.ndarray  # uint32: bits before the one-bits 0, SAMPLE, 2 * SAMPLE, ...

    @classmethod
    def of(cls, values) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        base = int(values[0]) if n else 0
        rest = (values - base).astype(np.uint64)
        top = int(rest[-1]) + 1 if n else 1
        width = max((top // max(n, 1)).bit_length() - 1, 0)
        ones = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high_bits = int(ones[-1]) + 1 if n else 0
        bits = np.zeros(high_bits, np.uint8)
        bits[ones] = 1
        return cls(n, base, width, _packed(rest & np.uint64((1 << width) - 1), width),
                   np.packbits(bits, bitorder="little"), high_bits, ones[::SAMPLE].astype("<u4"))

    def slice(self, first: int, n: int) -> np.ndarray:
        """Numbers first, first + 1, ..., by select from the nearest sample on."""
        if not n:
            return np.zeros(0, np.int64)
        begin = int(self.samples[first // SAMPLE])
        skip = first % SAMPLE
        found, at = np.zeros(0, np.int64), begin // 8
        while len(found) < skip + n:
            step = max((skip + n) // 2, 64)  # two bits a number or more
            bits = np.unpackbits(self.high[at:at + step], bitorder="little")
            ones = np.flatnonzero(bits) + 8 * at
            found = np.concatenate([found, ones[ones >= begin]])
            at += step
        ones = found[skip:skip + n]
        high = (ones - np.arange(first, first + n)).astype(np.uint64)
        low = _unpacked(self.low, first, n, self.width)
        return ((high << np.uint64(self.width)) | low).astype(np.int64) + self.base

    def select(self, i: int) -> int:
        return int(self.slice(i, 1)[0])

    def parts(self) -> bytes:
        return self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @property
    def spec(self) -> tuple[int, int, int, int]:
        return self.base, self.width, len(self.low), self.high_bits

    @classmethod
    def read(cls, data: memoryview, n: int, base: int, width: int, low: int, high_bits: int):
        """The sequence at the start of `data`, and its length in bytes."""
        high, samples = (high_bits + 7) // 8, 4 * ((n + SAMPLE - 1) // SAMPLE)
        whole = np.frombuffer(data[:low + high + samples], np.uint8)
        return cls(n, base, width, whole[:low], whole[low:low + high], high_bits,
                   whole[low + high:].copy().view("<u4")), low + high + samples


def write_shard(path: str, rows, width: int) -> tuple[int, int]:
    """`rows`: (doc_id, ids as little-endian 32-bit bytes) in order, nulls first. Ids go
    to the file as they come; only lengths and doc_ids are kept."""
    kind = {2: "<u2", 4: "<u4"}[width]
    doc_ids, bounds, nulls = [], [0], 0
    with shards.writer(path) as f:
        for doc_id, ids in rows:
            whole = np.frombuffer(ids, "<u4")
            if width == 2 and len(whole) and whole.max() >= 1 << 16:
                raise ValueError(f"id {whole.max()} does not fit 2 bytes: width=4 is needed")
            f.write(whole.astype(kind).tobytes())
            bounds.append(bounds[-1] + len(ids) // 4)
            if doc_id is None:
                nulls += 1
            else:
                doc_ids.append(doc_id)
        ends, names = EliasFano.of(bounds), EliasFano.of(doc_ids)
        f.write(ends.parts() + names.parts())
        f.write(FOOTER.pack(width, len(bounds) - 1, nulls, bounds[-1], *ends.spec, *names.spec))
        f.write(struct.pack("<I", FOOTER.size) + MAGIC)
    return len(bounds) - 1, bounds[-1]


class Shard:
    """A shard open for reading: only the parts asked for are read."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        f.seek(size - 8 - FOOTER.size)
        tail = f.read(FOOTER.size + 8)
        if tail[-4:] != MAGIC:
            raise ValueError("not a token shard")
        self.width, self.docs, self.nulls, self.ids, *spec = FOOTER.unpack(tail[:FOOTER.size])
        f.seek(self.width * self.ids)
        data = memoryview(f.read(size - 8 - FOOTER.size - self.width * self.ids))
        self.bounds, used = EliasFano.read(data, self.docs + 1, *spec[:4])
        self.names, _ = EliasFano.read(data[used:], self.docs - self.nulls, *spec[4:])

    def doc_ids(self, first: int, n: int) -> list[int | None]:
        nulls = min(max(self.nulls - first, 0), n)
        return [None] * nulls + self.names.slice(
            max(first - self.nulls, 0), n - nulls).tolist()

    def tokens(self, first: int, after: int) -> np.ndarray:
        self.f.seek(self.width * first)
        data = self.f.read(self.width * (after - first))
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None,
                      width: int = 2) -> DataFrame:
    """Write the shards; the manifest has (part, path, docs, ids, first id, first doc)."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")

    def write(batches):
        encoder, end = open_tokenizer(tokenizer), np.array([END_ID], "<u4").tobytes()

        def rows():
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encoded(texts)):
                    yield doc_id, ids + end

        path = shards.new_name(folder, "shard")
        n, ids = write_shard(path, rows(), width)
        if n:
            yield pa.RecordBatch.from_pydict(
                {"part": [TaskContext.get().partitionId()], "path": [path], "docs": [n], "ids": [ids]},
                pa.schema([("part", pa.int32()), ("path", pa.string()),
                           ("docs", pa.int64()), ("ids", pa.int64())]))

    ordered = (docs.select("doc_id", "text")
               .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
               .sortWithinPartitions("doc_id", "text"))
    manifest = stored(ordered.mapInArrow(write, SHARDS), "token-manifest")
    rows = sorted(map(tuple, manifest.collect()))  # a row a shard
    out, start, first = [], 0, 0
    for part, path, n, ids in rows:
        out.append((part, path, n, ids, start, first))
        start, first = start + ids, first + n
    return spark.createDataFrame(out, SHARDS + ", start long, first_doc long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    names = [c.split()[0] for c in ROWS.split(", ")]
    slices = manifest.select("path", "docs", "start", F.explode(F.expr(
        f"sequence(0L, docs - 1, {SLICE}L)")).alias("first"))

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with shards.reader(r["path"]) as f:
                    shard, n = Shard(f), min(SLICE, r["docs"] - r["first"])
                    bounds = shard.bounds.slice(r["first"], n + 1)
                    sums = [zlib.crc32(shard.tokens(a, b).tobytes())
                            for a, b in zip(bounds, bounds[1:])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard.doc_ids(r["first"], n), pa.int64()),
                        pa.array(bounds[:-1] + r["start"]), pa.array(np.diff(bounds)),
                        pa.array(sums, pa.int64())], names)

    spread = slices.repartition(int(
        manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "first")
    return spread.mapInArrow(read, ROWS)
