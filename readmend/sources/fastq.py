"""FASTQ files as a Spark data source, and corrected FASTQ out.

A file is read in byte ranges; a range owns the records that begin in it.
`read_idx` is the byte offset of a record, so it orders a file's reads. Parts
come in file order and keep it, which is why writing needs no sort.

Block gzip is cut likewise; there `read_idx` counts the block's place 65536 times.
Other gzip is read by one task a file. A reader builds the columns of its schema only:
`spark.read.format("fastq").schema("qual string")`.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from readmend.config import InputError
from readmend.sources import blocks, files
from readmend.sources.reports import fastq_record

SCHEMA = StructType([
    StructField("file_id", IntegerType()), StructField("read_idx", LongType()),
    *(StructField(c, StringType()) for c in ("name", "seq", "plus", "qual"))])
DEFAULT_RANGE = 128 * 1024 * 1024
_CHUNK = 8 * 1024 * 1024
_NEWLINE, _RETURN, _AT, _PLUS = 10, 13, ord("@"), ord("+")


@dataclass
class ByteRange(InputPartition):
    path: str
    file_id: int
    start: int
    end: int            # exclusive; -1: to the end of a compressed file
    blocks: bool = False


def _line_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every finished line."""
    newline = np.flatnonzero(buf == _NEWLINE)
    return np.concatenate(([0], newline + 1))[:-1], newline


def _first_record(buf: np.ndarray, starts: np.ndarray) -> int | None:
    """Index of the first line that heads a record: '@', and '+' two lines on.

    A quality line may begin with '@', but two lines after it are bases.
    """
    for i in range(len(starts) - 2):
        if buf[starts[i]] == _AT and buf[starts[i + 2]] == _PLUS:
            return i
    return None


def _strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    lengths = end - start
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    at = np.repeat(start - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(
        len(start), pa.py_buffer(offsets.astype(np.int32).tobytes()),
        pa.py_buffer(buf[at].tobytes()))


def _records(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray,
             file_id: int, columns: list[str]) -> pa.RecordBatch:
    """Whole records (a multiple of four lines) to rows of the columns asked for."""
    ends = ends - ((ends > starts) & (buf[ends - 1] == _RETURN))
    head, bases, plus, qual = (slice(i, None, 4) for i in range(4))
    if not (np.all(buf[starts[head]] == _AT) and np.all(buf[starts[plus]] == _PLUS)):
        raise InputError("a record does not begin with '@' or lacks its '+' line")
    if not np.array_equal(ends[bases] - starts[bases], ends[qual] - starts[qual]):
        raise InputError("a quality line is not as long as its bases")
    make = {
        "file_id": lambda: pa.array(np.full(len(places), file_id, np.int32)),
        "read_idx": lambda: pa.array(places.astype(np.int64)),
        "name": lambda: _strings(buf, starts[head] + 1, ends[head]),
        "seq": lambda: _strings(buf, starts[bases], ends[bases]),
        "plus": lambda: _strings(buf, starts[plus], ends[plus]),
        "qual": lambda: _strings(buf, starts[qual], ends[qual]),
    }
    return pa.RecordBatch.from_arrays([make[c]() for c in columns], names=columns)


def is_block_gzip(path: str) -> bool:
    system, inner = files.resolve(path)
    with system.open_input_stream(inner, compression=None) as f:
        return blocks.block_size(f.read(blocks.LARGEST)) is not None


def read_by_one_task(path: str) -> bool:
    """Gzip that cannot be cut into ranges."""
    return path.endswith(".gz") and not is_block_gzip(path)


class FastqReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType | None = None):
        known = {f.name: f.dataType for f in SCHEMA}
        self.columns = list(known) if schema is None else schema.fieldNames()
        for field in schema or ():
            if known.get(field.name) != field.dataType:
                raise InputError(f"FASTQ has no column {field.name} {field.dataType.simpleString()}")
        path = options.get("paths") or options.get("path")
        self.paths = json.loads(path) if path.startswith("[") else path.split(",")
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", DEFAULT_RANGE)))

    def partitions(self):
        parts = []
        for file_id, path in enumerate(self.paths):
            system, inner = files.resolve(path)
            info = system.get_file_info(inner)
            if info.type != fs.FileType.File:
                raise InputError(f"{path} is not a file")
            if info.size == 0:
                raise InputError(f"{path} is empty")
            if read_by_one_task(path):
                parts.append(ByteRange(path, file_id, 0, -1))
            else:
                cut = path.endswith(".gz")
                parts += [ByteRange(path, file_id, at, min(at + self.range_bytes, info.size), cut)
                          for at in range(0, info.size, self.range_bytes)]
        return parts

    def read(self, part: ByteRange):
        system, inner = files.resolve(part.path)
        if part.blocks:
            with system.open_input_file(inner) as f:
                stream = blocks.BlockStream(f, f.size(), part.start, part.end, part.path)
                before = stream.before
                yield from self._read(stream, part, -1 if before else 0, not before,
                                      lambda: stream.limit, stream.place)
            return
        if part.end < 0:
            stream = system.open_input_stream(inner, compression="gzip")
        else:
            stream = system.open_input_file(inner)
            stream.seek(max(part.start - 1, 0))
        with stream:
            yield from self._read(stream, part, max(part.start - 1, 0), part.start == 0,
                                  lambda: None if part.end < 0 else part.end, lambda at: at)

    def _read(self, stream, part: ByteRange, base: int, synced: bool, limit, place):
        """Records that begin before `limit()`, None for not known or none; `base` is the offset of
        the stream's first byte, `place` makes offsets to places in the file."""
        held, last = b"", False
        if not synced:
            # drop the rest of a line that began before the range
            piece = stream.read(_CHUNK)
            while piece and b"\n" not in piece:
                base += len(piece)
                piece = stream.read(_CHUNK)
            cut = piece.find(b"\n") + 1
            base, held = base + cut, piece[cut:]
        while not last:
            piece = stream.read(_CHUNK)
            last = not piece
            held += piece
            if last and held and not held.endswith(b"\n"):
                held += b"\n"
            buf = np.frombuffer(held, np.uint8)
            starts, ends = _line_bounds(buf)
            first = 0
            if not synced:
                first = _first_record(buf, starts)
                if first is None:
                    # up to three lines may end a record that began before
                    lines = int(np.count_nonzero(ends > starts))
                    if last and lines > 3 or lines > 16:
                        raise InputError(f"{part.path} has no record after byte {base}")
                    if last:
                        return
                    continue
                synced = True
            heads = np.append(starts[first:], len(held))
            mine = whole = (len(starts) - first) // 4 * 4
            starts, ends = starts[first:first + whole], ends[first:first + whole]
            if limit() is not None:
                mine = 4 * int(np.searchsorted(starts[::4] + base, limit()))
                last = last or mine < whole
                starts, ends = starts[:mine], ends[:mine]
            if last and mine == whole:
                tail = held[(int(ends[-1]) + 1 if ends.size else int(heads[0])):]
                if tail.strip():
                    raise InputError(f"{part.path} ends inside a record")
            if len(starts):
                yield _records(buf, starts, ends, place(starts[::4] + base), part.file_id, self.columns)
                cut = int(ends[-1]) + 1
                base, held = base + cut, held[cut:]
            elif first:
                base, held = base + int(_line_bounds(buf)[0][first]), held[_line_bounds(buf)[0][first]:]


class ChoosingReader(FastqReader):
    """Leaves out the files that a condition on file_id leaves out. Needs
    `spark.sql.python.filterPushdown.enabled`."""

    chosen: set | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file_id",):
                ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chosen = ids if self.chosen is None else self.chosen & ids
            else:
                yield f

    def partitions(self):
        parts = super().partitions()
        return parts if self.chosen is None else [p for p in parts if p.file_id in self.chosen]


class FastqSource(DataSource):
    """`spark.read.format("fastq").load(path)`; option rangeBytes. Several
    files: option paths, a JSON list. A schema names the columns to build."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        choose = self.options.get("choosefiles") == "true"
        return (ChoosingReader if choose else FastqReader)(self.options, schema)


def read_fastq(spark: SparkSession, paths: str | list[str], range_bytes: int = DEFAULT_RANGE,
               columns: list[str] | None = None) -> DataFrame:
    """Reads of the files, in their order; only `columns`, if given. Conditions on file_id
    choose files before any is read, where the session pushes filters to Python sources."""
    spark.dataSource.register(FastqSource)
    listed = [paths] if isinstance(paths, str) else list(paths)
    reader = (spark.read.format("fastq").option("paths", json.dumps(listed))
              .option("rangeBytes", str(range_bytes))
              .option("chooseFiles", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")))
    if columns is not None:
        reader = reader.schema(StructType([SCHEMA[c] for c in columns]))
    return reader.load()


def write_fastq(reads: DataFrame, path: str, gzip: bool = False, sort: bool = False) -> None:
    """A folder of FASTQ parts whose names give the order. Reads that do not
    come from `read_fastq`, or were shuffled, need `sort`, a range shuffle on
    file_id and read_idx."""
    named = reads.withColumn("name", F.concat(F.lit("@"), F.col("name")))
    if sort:
        named = named.orderBy(*[c for c in ("file_id", "read_idx") if c in named.columns])
    lines = named.select(fastq_record().alias("value"))
    writer = lines.write.mode("overwrite")
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.text(path)
