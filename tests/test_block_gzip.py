"""FASTQ in block gzip, cut at every place, and columns that are not built."""

import gzip
import random
import struct
import zlib

import pytest

from readmend import config as C
from readmend.plans.correction import correct_group
from readmend.sources import blocks
from readmend.sources.fastq import FastqReader, is_block_gzip, read_by_one_task, read_fastq


def block(text: bytes, other: bytes = b"") -> bytes:
    """A block, with another extra field before its size."""
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(text) + packed.flush()
    extra = other + b"BC\x02\x00\0\0"
    size = 12 + len(extra) + len(body) + 8
    extra = extra[:-2] + struct.pack("<H", size - 1)
    return (b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(text), len(text)))


def records(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.randrange(1, 60)
        qual = rng.choice("@+I") + "".join(rng.choice("@+IJ#") for _ in range(size - 1))
        out.append((f"r{i}", "".join(rng.choice("ACGTN") for _ in range(size)), "+", qual))
    return out


def cut_up(text: bytes, seed, largest) -> bytes:
    """Blocks of random sizes, empty ones among them, and an empty last one."""
    rng, out, at = random.Random(seed), [], 0
    while at < len(text):
        size = rng.choice((0, 1, 2, rng.randrange(1, largest)))
        out.append(block(text[at:at + size], rng.choice((b"", b"XY\x03\x00abc"))))
        at += size
    return b"".join(out) + block(b"")


def text_of(rows):
    return "".join(f"@{n}\n{s}\n{p}\n{q}\n" for n, s, p, q in rows).encode()


def read_all(path, range_bytes):
    reader = FastqReader({"path": str(path), "rangebytes": str(range_bytes)})
    return [tuple(r.values()) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]


@pytest.mark.parametrize("seed", range(3))
def test_records_do_not_depend_on_the_ranges(tmp_path, seed):
    rows = records(60, seed)
    path = tmp_path / "x.fastq.gz"
    path.write_bytes(cut_up(text_of(rows), seed, 90))
    assert gzip.decompress(path.read_bytes()) == text_of(rows)
    whole = read_all(path, 1 << 30)
    assert [r[2:] for r in whole] == rows
    places = [r[1] for r in whole]
    assert places == sorted(set(places))
    for size in (40, 333, 5000):
        assert read_all(path, size) == whole


def test_a_record_over_three_blocks_and_over_a_whole_range(tmp_path):
    rows = records(3)[:1] + [("long", "ACGT" * 40_000, "+", "IIII" * 40_000)] + records(3)[1:]
    text = text_of(rows)
    path = tmp_path / "x.fastq.gz"
    path.write_bytes(b"".join(block(text[a:a + 60_000]) for a in range(0, len(text), 60_000)))
    assert len(text) > 5 * 60_000
    for size in (50, 200, 1000, 1 << 20):
        assert [r[2:] for r in read_all(path, size)] == rows


def test_magic_bytes_inside_a_block_are_no_block(tmp_path):
    """Stored, not packed, so that a block's header lies within another's text."""
    inner = block(b"@x\nA\n+\nI\n")
    name = "n" + inner.decode("latin-1").replace("\n", "")
    raw = f"@{name}\nAC\n+\nII\n".encode("latin-1")
    fake = zlib.compressobj(0, zlib.DEFLATED, -15)
    body = fake.compress(raw) + fake.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff\x06\x00BC\x02\x00"
    one = head + struct.pack("<H", len(head) + 2 + len(body) + 7) + body + struct.pack("<II", zlib.crc32(raw), len(raw))
    assert one.find(b"\x1f\x8b\x08\x04", 1) > 0
    # more than the largest block before a range's begin, so that it must be searched for
    plain = text_of(records(1500))
    many = b"".join(block(plain[a:a + 500]) for a in range(0, len(plain), 500))
    data = many + one + many
    stream = blocks.BlockStream(_Bytes(data), len(data), len(many) + 40, len(data), "x")
    assert stream.at == len(many) + len(one)


class _Bytes:
    def __init__(self, data):
        self.data, self.at = data, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.at += n
        return self.data[self.at - n:self.at]


@pytest.mark.parametrize("size", [100, 1 << 30])
def test_damage_raises(tmp_path, size):
    rows = records(100)
    parts = [block(text_of(rows[a:a + 10])) for a in range(0, 100, 10)]
    for bad in range(1, 10):
        hurt = bytearray(parts[bad])
        hurt[len(hurt) // 2] ^= 255
        path = tmp_path / f"{bad}.fastq.gz"
        path.write_bytes(b"".join(parts[:bad]) + bytes(hurt) + b"".join(parts[bad + 1:]))
        with pytest.raises(C.InputError, match="no whole block"):
            read_all(path, size)
    path.write_bytes(b"".join(parts)[:-5])
    with pytest.raises(C.InputError, match="no whole block"):
        read_all(path, size)
    path.write_bytes(b"".join(parts) + gzip.compress(text_of(rows)))
    with pytest.raises(C.InputError, match="no whole block"):
        read_all(path, size)


def test_ordinary_gzip_is_one_range(tmp_path):
    path = tmp_path / "x.fastq.gz"
    path.write_bytes(gzip.compress(text_of(records(50))))
    assert read_by_one_task(str(path)) and not is_block_gzip(str(path))
    reader = FastqReader({"path": str(path), "rangebytes": "10"})
    assert len(reader.partitions()) == 1


def test_only_the_columns_asked_for_are_built(spark, tmp_path):
    rows = records(30)
    (tmp_path / "x.fastq").write_bytes(text_of(rows))
    df = read_fastq(spark, str(tmp_path / "x.fastq"), 100, ["qual", "file_id"])
    assert df.columns == ["qual", "file_id"]
    assert sorted(r["qual"] for r in df.collect()) == sorted(r[3] for r in rows)
    reader = FastqReader({"path": str(tmp_path / "x.fastq")}, df.select("qual").schema)
    assert [b.schema.names for b in reader.read(reader.partitions()[0])] == [["qual"]]
    with pytest.raises(Exception, match="no column"):
        spark.read.format("fastq").schema("seq int").load(str(tmp_path / "x.fastq")).collect()


def test_a_condition_on_file_id_chooses_files(spark, tmp_path):
    """The second file is damaged: it is not read where only the first is asked for."""
    rows = records(30)
    (tmp_path / "x.fastq").write_bytes(text_of(rows))
    (tmp_path / "y.fastq").write_bytes(b"no record\n" * 50)
    paths = [str(tmp_path / "x.fastq"), str(tmp_path / "y.fastq")]
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        assert read_fastq(spark, paths).where("file_id = 0").count() == len(rows)
        assert read_fastq(spark, paths).where("file_id in (0, 7)").count() == len(rows)
        with pytest.raises(Exception, match="does not begin|no record"):
            read_fastq(spark, paths).where("file_id >= 0").count()
    finally:
        spark.conf.unset(key)


def test_a_run_over_blocks_writes_what_a_plain_run_writes(spark, simulated, tmp_path):
    text = "".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q, _ in simulated).encode()
    (tmp_path / "p.fastq").write_bytes(text)
    (tmp_path / "b.fastq.gz").write_bytes(b"".join(block(text[a:a + 4000]) for a in range(0, len(text), 4000)))
    outs = []
    for name in ("p.fastq", "b.fastq.gz"):
        config = C.RunConfig(k=21, threshold=4, prefix=str(tmp_path / name[0]))
        report = correct_group(spark, [str(tmp_path / name)], config, range_bytes=20_000)
        lines = [line for part in sorted((tmp_path / f"{name[0]}.corrected.fastq").glob("part-*"))
                 for line in part.read_text().splitlines()]
        outs.append((lines, report.stats, report.n_solid))
    assert outs[0] == outs[1] and len(outs[0][0]) == 4 * len(simulated)
