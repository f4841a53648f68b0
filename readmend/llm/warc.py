"""WARC archives of pages: written as one gzip member a record, read back in byte ranges.

Writer: the first page, by page_id, of each payload becomes a `response`; the others become
`revisit` records of it, without a payload. Payloads are told apart by SHA-1; the record of
a revisit still has the length and digest of the full payload.

Reader: a file is cut into ranges without looking at it, and a task finds the records that
start in its range. It scans for the gzip magic, takes a candidate only if the member
decodes and begins with a WARC header, and goes on at the end of each record, so only the
first record of a range is searched for. The last record of a range is read past its end, and
the one that follows it, in whichever range, is decoded as well. So each record has been
decoded by a task that knew where it begins: the first of a file begins at byte 0, any other
where the one before it ends. A record that does not decode raises, wherever it lies, and so
does a file that is longer or shorter than its manifest says.

A null html is an empty payload. A null page_id is never the first of a payload unless all
are null; rows that share the least page_id of a payload are all responses. A null url
leaves the target out. An empty table writes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmend.llm import shards
from readmend.llm.common import scratch_path, stored

#: Payloads at least this long are told apart.
REVISIT_BYTES = 0
RANGE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 1 << 16
FILES = "path string, bytes long, records long"
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, "
           "record_type string, refers_to long, payload binary")
_ID = re.compile(r"<urn:page:(-?\d+|none)>")


class DamagedArchive(ValueError):
    """A record does not decode."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One gzip member; a revisit where `refers_to` is given."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:  # no line ends within a header
        lines.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response",
              f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"Content-Length: {len(block)}"]
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def write_warc(pages: DataFrame, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write the archives; gives (path, bytes, records) of each file."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    long_enough = F.octet_length("html") >= revisit_bytes
    again = rows.where(long_enough).groupBy(F.col("digest").alias("of")).agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = rows.join(again, (F.col("digest") == F.col("of")) & long_enough, "left").select(
        "page_id", "url", "html", F.when(
            ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches):
        path, n, size = shards.new_name(folder, "pages") + ".warc.gz", 0, 0
        with shards.writer(path) as f:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    page_id, url, text, refers_to = row
                    data = record(page_id, url, text.encode("utf-8", "surrogatepass"), refers_to)
                    f.write(data)
                    n, size = n + 1, size + len(data)
        if n:
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    return stored(marked.mapInArrow(write, FILES), "warc-files")


# --- reading -----------------------------------------------------------------------

def _member(f, at: int, head: bytes) -> tuple[bytes, int]:
    """The content of the gzip member at `at`, of which `head` has the first bytes, and
    where it ends. A candidate that is none raises zlib.error."""
    unpacker, out, data, end = zlib.decompressobj(31), [], head, at + len(head)
    checked = False
    while True:
        out.append(unpacker.decompress(data))
        if not checked:
            begin = b"".join(out)[:7]
            if begin != b"WARC/1."[:len(begin)]:
                raise zlib.error("not a record")
            checked = len(begin) == 7
        if unpacker.eof:
            if not checked:
                raise zlib.error("not a record")
            return b"".join(out), end - len(unpacker.unused_data)
        f.seek(end)
        data = f.read(_STEP)
        if not data:
            raise zlib.error("the file ends within a record")
        end += len(data)


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(content: bytes) -> tuple:
    """The columns of `RECORDS`."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = _headers(head)
    block = rest[:int(headers["content-length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise DamagedArchive("a record is longer or shorter than it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(_headers(http)["content-length"])
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise DamagedArchive("a payload does not match its digest")

    def page(name):
        found = _ID.fullmatch(headers.get(name, ""))
        return int(found[1]) if found and found[1] != "none" else None

    return (page("warc-record-id"), headers.get("warc-target-uri"), size, digest, kind,
            page("warc-refers-to"), payload if kind == "response" else None)


def records_in_range(f, start: int, end: int) -> Iterator[bytes]:
    """Contents of the records that start at start, ..., end - 1."""
    size, at, found = f.size(), start, start == 0
    end = min(end, size)
    base, buffer = start, b""
    while at < end:
        if at < base or at + len(MAGIC) > base + len(buffer):
            f.seek(at)
            base, buffer = at, f.read(max(end - at, 0) + _STEP)
        if found:  # records follow each other
            hit = at if buffer[at - base:at - base + 3] == MAGIC else -1
            if hit < 0:
                raise DamagedArchive(f"no record at byte {at}")
        else:
            hit = buffer.find(MAGIC, at - base)
            hit = hit + base if hit >= 0 else size
            if hit >= end:
                return
        try:
            content, after = _member(f, hit, buffer[hit - base:hit - base + _STEP])
        except zlib.error as e:
            if found:
                raise DamagedArchive(f"record at byte {hit}: {e}") from e
            at = hit + 1
            continue
        found = True
        yield content
        at = after
    if found and at < size:  # the task of its range would take a damaged record for none
        f.seek(at)
        try:
            _member(f, at, f.read(_STEP))
        except zlib.error as e:
            raise DamagedArchive(f"record at byte {at}: {e}") from e


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """`RECORDS` of the archives in (path, bytes)."""
    ranges = files.select("path", "bytes", F.explode(F.expr(
        f"sequence(0L, bytes - 1, {range_bytes}L)")).alias("start"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("payload", pa.binary())])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)],
                                          schema.names)

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                with shards.reader(r["path"]) as f:
                    if f.size() != r["bytes"]:
                        raise DamagedArchive(f"{r['path']} has {f.size()} bytes of {r['bytes']}")
                    for content in records_in_range(f, r["start"], r["start"] + range_bytes):
                        row = parse(content)
                        rows.append(row if payloads else row[:-1] + (None,))
                        held += len(content) if payloads else 0
                        if len(rows) >= 1000 or held > 1 << 24:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, "path", "start").mapInArrow(read, RECORDS)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write the pages and read them back."""
    return read_warc(write_warc(pages), payloads=False).drop("payload", "url")


def oracle(table: str = "pages") -> str:
    digits = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, {5 * g + 1}, 5))::int >> {s}) & 31) + 1, 1)"
        for g in range(8) for s in (15, 10, 5, 0))
    return f"""
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) hex from {table}),
f as (select *, min(page_id) over (partition by hex) first from p)
select page_id, strlen(h)::bigint payload_bytes, {digits} payload_digest,
       case when first is null or page_id is not distinct from first then 'response' else 'revisit' end record_type,
       case when first is not null and page_id is distinct from first then first end refers_to
from f"""
