"""Approximate membership: sizing, building, saving and shipping the filter."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from readmend import config as C
from readmend.functions import kmer_codes as kc
from readmend.functions.bases import pack_kmer
from readmend.functions.membership import (
    FilterParts, ShippedFilter, ShippedKmers, ShippedWords, WordLayout, keys_of)
from readmend.functions.murmur import Keys, libc_random
from readmend.sources import files
from readmend.sources.scratch import scratch_dir, shuffles_dropped

_SPREAD = 1024
_BUCKET_BYTES = 4096
_SLAB_BITS = 1 << 20
#: k-mers whose bits are found at once.
_KMERS_AT_ONCE = 1 << 19
#: k-mers of a slab, one piece of those that are shipped; no more than 2 ** 14 slabs.
_SLAB_KMERS = 1 << 16


def filter_size(num_kmers: int, fpr: float) -> tuple[int, int]:
    """(width in bits, number of hashes).

    The width per hash count j is -j n / ln(1 - fpr^(1/j)); the smallest j
    within 20 % of the best one is taken, made even, and the width doubled and
    rounded up to whole bytes.
    """
    if num_kmers <= 0:
        raise C.InputError("there are no solid k-mers to put in a filter")

    def width(j: int) -> float:
        inner = 1.0 - fpr ** (1.0 / j)
        return math.inf if inner <= 0 else -j * num_kmers / math.log(inner)

    best = min(range(1, 1000), key=width)
    chosen = next((j for j in range(1, best) if width(j) < width(best) * C.WIDTH_SLACK), best)
    if math.isinf(width(chosen)):
        raise C.ConfigError("no filter has such a false positive rate")
    bits = 2 * int(width(chosen))
    return bits + -bits % 8, chosen + chosen % 2


@dataclass(frozen=True)
class FilterModel:
    """A built filter: its figures and where its bits lie."""

    width_bits: int
    num_hash: int
    k: int
    threshold: int
    seed: int
    num_kmers: int
    prefix: str
    parts: int = 1

    @property
    def width_bytes(self) -> int:
        return self.width_bits // 8

    @property
    def part_bits(self) -> int:
        return self.width_bits // self.parts

    @property
    def seeds(self) -> tuple[int, ...]:
        return tuple(libc_random(self.seed, self.num_hash))

    @property
    def part_seed(self) -> int:
        """Of the hash that chooses a k-mer's part: the one after the others."""
        return libc_random(self.seed, self.num_hash + 1)[-1]

    @property
    def in_parts(self) -> FilterParts:
        return FilterParts(self.prefix, self.k, self.part_bits, self.seeds, self.parts,
                           self.part_seed)

    def save_figures(self) -> None:
        figures = (self.width_bits, self.width_bytes, self.num_hash, self.k,
                   self.threshold, self.seed, self.num_kmers)
        if self.parts > 1:
            figures += (self.parts,)
        files.write_text(f"{self.prefix}.bf.size", " ".join(map(str, figures)) + "\n")

    @staticmethod
    def load(prefix: str, k: int | None = None) -> FilterModel:
        fields = files.read_text(f"{prefix}.bf.size").split()
        if len(fields) not in (7, 8):
            raise C.InputError(f"{prefix}.bf.size: seven or eight figures expected, got {len(fields)}")
        bits, size, hashes, stored_k, threshold, seed, n, *parts = map(int, fields)
        if k is not None and stored_k != k:
            raise C.ConfigError(f"the stored filter has k={stored_k}, not {k}")
        if size * 8 != bits:
            raise C.InputError(f"{prefix}.bf.size: {bits} bits are not {size} bytes")
        return FilterModel(bits, hashes, stored_k, threshold, seed, n, prefix, *parts)

    def ship(self, spark: SparkSession) -> ShippedFilter:
        """Only a filter of one part is small enough."""
        if self.parts > 1:
            raise C.ConfigError("a filter in parts is not shipped")
        data = files.read_bytes(f"{self.prefix}.bf.data")
        if len(data) != self.width_bytes:
            raise C.InputError(f"{self.prefix}.bf.data: {self.width_bytes} bytes expected")
        return ShippedFilter(_ship(spark, [data], "bits"), self.k, self.width_bits, self.seeds)


def bit_positions(kmer: Column, k: int, width_bits: int, seeds: tuple[int, ...]) -> Column:
    """array<bigint>: the bits of one canonical k-mer (packed or string)."""

    @arrow_udf("array<bigint>")
    def positions_of_kmer(col: pa.Array) -> pa.Array:
        keys = keys_of(col, k)
        bits = np.stack([keys.places(s, width_bits) for s in seeds], axis=1)
        return kc.list_array(np.full(len(col), len(seeds)), pa.array(bits.ravel()))

    return positions_of_kmer(kmer)


def part_of(kmer: Column, parts: FilterParts) -> Column:
    """The part of the filter that holds a canonical k-mer's bits."""

    @arrow_udf("int")
    def part_of_kmer(col: pa.Array) -> pa.Array:
        return pa.array(parts.part_of(keys_of(col, parts.k)))

    return part_of_kmer(kmer)


def filter_bits(solid: DataFrame, model: FilterModel) -> DataFrame:
    """(part, bucket, bits): the bit vectors in pieces of 4096 bytes.

    Positions move as offsets in slabs of the vector, a batch's equal ones once; the
    task of a slab sets its bits.
    """
    k, seeds, part_bits, target = model.k, model.seeds, model.part_bits, model.in_parts
    slabs = -(-part_bits // _SLAB_BITS)

    def offsets(keys: Keys) -> pa.RecordBatch:
        first = np.zeros(len(keys), np.int64)
        if target.parts > 1:
            first = target.part_of(keys).astype(np.int64) * slabs * _SLAB_BITS
        bits = np.sort(np.concatenate(
            [first + keys.places(s, part_bits) for s in seeds]))
        bits = bits[np.concatenate(([True], bits[1:] != bits[:-1]))]
        slab = bits // _SLAB_BITS
        edges = np.flatnonzero(np.diff(np.append(np.append(-1, slab), -1)))
        # three bytes hold a place in a slab
        places = (bits % _SLAB_BITS).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        at = slab[edges[:-1]]
        return pa.RecordBatch.from_arrays(
            [pa.array((at // slabs).astype(np.int32)), pa.array((at % slabs).astype(np.int32)),
             pa.array([places[x:y].tobytes() for x, y in zip(edges, edges[1:])], pa.binary())],
            ["part", "slab", "offsets"])

    def positions(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0))
                size += batch.num_rows
            if size >= _KMERS_AT_ONCE:
                yield offsets(keys_of(pa.concat_arrays(held), k))
                held, size = [], 0
        if held:
            yield offsets(keys_of(pa.concat_arrays(held), k))

    def pieces(here, vector):
        part, slab = here
        cut = np.packbits(vector, bitorder="little").reshape(-1, _BUCKET_BYTES)
        used = np.flatnonzero(cut.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(used), part, np.int32)),
             pa.array(slab * len(cut) + used), pa.array([cut[i].tobytes() for i in used], pa.binary())],
            ["part", "bucket", "bits"])

    def set_bits(batches):
        here, vector = None, None
        for batch in batches:
            for part, slab, places in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, slab) != here:
                    if here is not None:
                        yield pieces(here, vector)
                    here, vector = (part, slab), np.zeros(_SLAB_BITS, np.uint8)
                wide = np.zeros((len(places) // 3, 4), np.uint8)
                wide[:, :3] = np.frombuffer(places, np.uint8).reshape(-1, 3)
                vector[wide.view("<u4").ravel()] = 1
        if here is not None:
            yield pieces(here, vector)

    moved = solid.select("kmer").mapInArrow(positions, "part int, slab int, offsets binary").repartition(
        "part", "slab").sortWithinPartitions("part", "slab")
    return moved.mapInArrow(set_bits, "part int, bucket bigint, bits binary")


def build_filter(solid: DataFrame, k: int, num_kmers: int, threshold: int, prefix: str,
                 fpr: float = 0.001, seed: int = 0,
                 part_bytes: int = C.PART_BYTES) -> FilterModel:
    """Build and save the filter.

    A 32-bit hash addresses `C.PART_BYTES` at most. A larger filter has parts of
    equal width, each a file; another hash of the k-mer says in which part all
    of its bits are. Tasks write the parts, a task holds one of them at a time.
    """
    bits, hashes = filter_size(num_kmers, fpr)
    parts = -(-bits // (8 * min(part_bytes, C.PART_BYTES)))
    bits += -bits % (8 * parts)
    model = FilterModel(bits, hashes, k, threshold, seed, num_kmers, prefix, parts)
    target, size = model.in_parts, model.part_bits // 8

    def write(batches):
        here, vector = None, None
        for batch in batches:
            for part, bucket, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if part != here:
                    if here is not None:
                        yield saved(here, vector)
                    here = part
                    vector = np.zeros(-(-size // _BUCKET_BYTES) * _BUCKET_BYTES, dtype=np.uint8)
                if bucket is not None:
                    start = bucket * _BUCKET_BYTES
                    vector[start:start + _BUCKET_BYTES] = np.frombuffer(piece, np.uint8)
        if here is not None:
            yield saved(here, vector)

    def saved(part, vector):
        files.write_bytes(target.path(part), memoryview(vector[:size]))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], ["part"])

    spark = solid.sparkSession
    every = spark.range(parts).select(  # a part without a k-mer is written as well
        F.col("id").cast("int").alias("part"), F.lit(None).cast("bigint").alias("bucket"),
        F.lit(None).cast("binary").alias("bits"))
    with shuffles_dropped(spark):
        written = filter_bits(solid, model).unionByName(every).repartition("part").sortWithinPartitions(
            "part").mapInArrow(write, "part int").count()
    if written != parts:
        raise C.InputError(f"{written} of {parts} parts of the filter were written")
    model.save_figures()
    return model


def ship_kmers(solid: DataFrame, k: int, num_kmers: int,
               ship_limit: int = C.SHIP_BYTES) -> ShippedKmers | ShippedWords | None:
    """Ship the k-mers themselves; None if they are larger than `ship_limit`.

    Packed k-mers move mixed and without their first bits, the slab, a few bytes each; the task of a slab sorts
    them and leaves its piece in the shared folder. The driver puts the pieces into one file, one after the other.
    """
    spark = solid.sparkSession
    if k > C.PACKED_MAX_K:
        if num_kmers * k > ship_limit:
            return None
        column = solid.select("kmer").orderBy("kmer").toArrow().column("kmer").combine_chunks()
        return ShippedKmers(_ship(spark, ["".join(column.to_pylist()).encode()], "kmers"), k)
    layout = WordLayout.of(num_kmers, k)
    if num_kmers >= 1 << 31 or layout.size(num_kmers) > ship_limit:
        return None
    folder = f"{scratch_dir(spark)}/{uuid.uuid4().hex}.pieces"
    slab_bits = min(2 * k % 8 + 8, (num_kmers // _SLAB_KMERS).bit_length(), layout.prefix_bits)
    slab_prefixes = 1 << layout.prefix_bits - slab_bits
    rest = np.uint64(2 * k - slab_bits)
    width = -(-int(rest) // 8)

    def slabs(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64))
            size += len(held[-1])
            if size >= _KMERS_AT_ONCE:
                yield in_slabs(np.sort(layout.mixed(np.concatenate(held))))
                held, size = [], 0
        if size:
            yield in_slabs(np.sort(layout.mixed(np.concatenate(held))))

    def in_slabs(mixed):
        slab = (mixed >> rest).astype(np.int64)
        edges = np.flatnonzero(np.diff(np.append(np.append(-1, slab), -1)))
        low = mixed & ((np.uint64(1) << rest) - np.uint64(1))
        low = np.ascontiguousarray(low, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array(slab[edges[:-1]].astype(np.int32)),
             pa.array([low[width * x:width * y] for x, y in zip(edges, edges[1:])], pa.binary())],
            ["slab", "low"])

    def cut(batches):
        """Low bits of a slab's k-mers, and how many of them there are up to each of its prefixes."""
        here, held = None, []
        for batch in batches:
            for slab, low in zip(*(c.to_pylist() for c in batch.columns)):
                if held and slab != here:
                    yield saved(here, held)
                    held = []
                here = slab
                held.append(low)
        if held:
            yield saved(here, held)

    def saved(slab, held):
        wide = np.zeros((sum(map(len, held)) // width, 8), np.uint8)
        wide[:, :width] = np.frombuffer(b"".join(held), np.uint8).reshape(-1, width)
        mixed = np.sort(wide.view("<u8").ravel())
        mixed = np.append(mixed, np.full(-len(mixed) % 8, mixed[-1]))  # the last one again, to whole bytes
        prefix = (mixed >> np.uint64(layout.low_bits)).astype(np.int64)
        name = f"{folder}/{uuid.uuid4().hex}"
        files.write_bytes(f"{name}.low", layout.packed(mixed))
        files.write_bytes(f"{name}.ends", np.cumsum(
            np.bincount(prefix, minlength=slab_prefixes)).astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([slab], pa.int32()), pa.array([len(mixed)], pa.int64()), pa.array([name])],
            ["slab", "n", "name"])

    with shuffles_dropped(spark):
        pieces = solid.select("kmer").mapInArrow(slabs, "slab int, low binary").repartition(
            "slab").sortWithinPartitions("slab").mapInArrow(
            cut, "slab int, n bigint, name string").collect()
    pieces = {piece["slab"]: piece for piece in pieces}

    def data():
        yield bytes(4)
        before = 0
        for slab in range(1 << slab_bits):
            ends = np.zeros(slab_prefixes, np.uint32)
            if slab in pieces:
                path = f"{pieces[slab]['name']}.ends"
                ends = np.frombuffer(files.read_bytes(path), np.uint32)
                files.delete(path)
            yield (ends + np.uint32(before)).tobytes()
            before += pieces[slab]["n"] if slab in pieces else 0
        yield bytes(layout.table_bytes - 4 * ((1 << layout.prefix_bits) + 1))
        for slab in sorted(pieces):
            path = f"{pieces[slab]['name']}.low"
            yield files.read_bytes(path)
            files.delete(path)
        # words are read whole, and with the one after them
        yield bytes(-(before * layout.low_bits // 8) % 8 + 16)

    return ShippedWords(_ship(spark, data(), "kmers"), layout, num_kmers, k)


def _ship(spark: SparkSession, chunks: Iterable[bytes], label: str) -> str:
    """Add bytes to the session as a file of its own name; returns the name."""
    name = f"{uuid.uuid4().hex}.{label}"
    path = f"{scratch_dir(spark)}/{name}"
    files.write_chunks(path, chunks)
    spark.sparkContext.addFile(path)
    return name


def solid_membership(df: DataFrame, members, kmer: str = "kmer") -> DataFrame:
    """Adds `solid` for a column of canonical k-mer strings."""
    from readmend.functions.probes import solid_flags

    return df.withColumn("solid", solid_flags(members, F.col(kmer)) == "1")


def filter_membership(df: DataFrame, model: FilterModel, kmer: str = "kmer") -> DataFrame:
    """The same by a filter of any size."""
    if model.parts == 1:
        return solid_membership(df, model.ship(df.sparkSession), kmer)
    keyed = df.withColumn("_key", pack_kmer(F.col(kmer)) if model.k <= C.PACKED_MAX_K
                          else F.col(kmer))
    return tested_in_parts(keyed, model.in_parts, F.col(kmer)).drop("_key")


def tested_in_parts(keyed: DataFrame, parts: FilterParts, spread_by: Column) -> DataFrame:
    """Adds `solid` for canonical k-mers `_key`. Rows go where the task reads
    the part they need; `spread_by` deals the rows of a part over many tasks."""

    @arrow_udf("boolean")
    def in_filter(col: pa.Array, part: pa.Array) -> pa.Array:
        return pa.array(parts.contains(keys_of(col, parts.k), np.asarray(part)))

    moved = keyed.withColumn("_part", part_of(F.col("_key"), parts)).repartition(
        "_part", F.pmod(F.xxhash64(spread_by), F.lit(_SPREAD))).sortWithinPartitions("_part")
    return moved.withColumn("solid", in_filter(F.col("_key"), F.col("_part"))).drop("_part")


def pack_column(df: DataFrame, k: int, kmer: str = "kmer") -> DataFrame:
    """k-mer strings to the type `kmer_rows` uses for this k."""
    if k > C.PACKED_MAX_K:
        return df
    return df.withColumn(kmer, pack_kmer(F.col(kmer)))
