"""Documents that hold passages of a benchmark, by Wu-Manber multi-pattern search.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Texts become
` word word word `, one space around each word, so a run of words is found exactly where its
bytes are found. Patterns are the runs of `WINDOW` words of each item, or the whole item
where it has fewer.

Patterns are sorted into classes by length, a search for each. A search looks at the block
of bytes that ends at its position. The shift table has, for each block within the first m
bytes of a pattern (m is the least length in the class), how far it is from the end of those
m bytes, at least; a block that is not in it allows the largest step. At a shift of zero the
block selects a bucket of patterns whose m bytes end with it, their first bytes select
within it, and those left are compared directly.

Items are cut into pieces of at most `PIECE_WORDS` words that overlap by a window, and dealt
by a hash into files of about `PART_BYTES` in the shared folder. A task compiles one part at a
time and searches the texts it holds for it, about `HELD_BYTES`, before it takes the next:
memory is bounded however many items there are. No document is shuffled.

A null text has no words, and neither has an item with a null text. Rows that repeat, in
either table, change nothing. An item without an id marks words and is not counted. Columns
besides the ids and texts are not read. An empty benchmark hits nothing; empty documents
give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmend.llm import shards
from readmend.llm.common import scratch_path, stored

WINDOW = 10
PIECE_WORDS = 2000
PART_BYTES = 1 << 20
HELD_BYTES = 16 << 20
#: Least pattern lengths of the classes, in bytes, and the length of a class's blocks.
CLASSES = ((0, 2), (8, 4), (16, 8), (32, 12))
HITS = "doc_id long, n_words long, n_hit long, items array<string>"

_CANONICAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_CANONICAL).split()


def joined(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" " if words else b""


def windows(words: list[bytes], size: int = WINDOW) -> Iterator[bytes]:
    for i in range(max(len(words) - size + 1, min(len(words), 1))):
        yield joined(words[i:i + size])


class Search:
    """Wu-Manber tables of the patterns of one class: {pattern: number}."""

    def __init__(self, patterns: dict[bytes, int], block: int):
        self.m = m = min(map(len, patterns))
        self.block = block = min(block, m)
        self.most = m - block + 1
        self.shifts: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list]] = {}
        shifts = self.shifts
        for p, number in patterns.items():
            for end in range(block, m + 1):
                b = p[end - block:end]
                if shifts.get(b, self.most) > m - end:
                    shifts[b] = m - end
            self.buckets.setdefault(p[m - block:m], {}).setdefault(p[:block], []).append((p, number))

    def occurrences(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(first byte, byte after the last one, pattern's number)"""
        shift, block, most, m = self.shifts.get, self.block, self.most, self.m
        end, n = m, len(text)
        while end <= n:
            step = shift(text[end - block:end], most)
            if step:
                end += step
                continue
            start = end - m
            for p, number in self.buckets[text[end - block:end]].get(text[start:start + block], ()):
                if text.startswith(p, start):
                    yield start, start + len(p), number
            end += 1


class Patterns:
    """All windows of some items, compiled."""

    def __init__(self, items, size: int = WINDOW):
        """`items`: (item_id, words)."""
        numbers: dict[bytes, int] = {}
        owners: list[set] = []
        for item_id, words in items:
            for p in windows(words, size):
                i = numbers.setdefault(p, len(owners))
                if i == len(owners):
                    owners.append(set())
                if item_id is not None:
                    owners[i].add(item_id)
        self.owners = owners
        limits = [least for least, _ in CLASSES[1:]] + [None]
        self.searches = []
        for (least, block), below in zip(CLASSES, limits):
            own = {p: i for p, i in numbers.items() if len(p) >= least and (below is None or len(p) < below)}
            if own:
                self.searches.append(Search(own, block))

    def find(self, text: bytes) -> tuple[list[tuple[int, int]], set]:
        """Spans of bytes, and the items they are from."""
        spans, items = [], set()
        for search in self.searches:
            for start, end, number in search.occurrences(text):
                spans.append((start, end))
                items |= self.owners[number]
        return spans, items


def words_in(text: bytes, spans: list[tuple[int, int]]) -> int:
    """How many words of the text lie in one of the spans, which begin and end with the
    spaces around words."""
    if not spans:
        return 0
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    edges = np.searchsorted(spaces, np.array(spans) - np.array([0, 1]))
    inside = np.zeros(len(spaces) + 1, np.int64)
    np.add.at(inside, edges[:, 0], 1)
    np.add.at(inside, edges[:, 1], -1)
    return int((np.cumsum(inside) > 0).sum())


def _item_pieces(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, words, bytes): runs of words that hold each window of an item once."""
    def cut(batches):
        for batch in batches:
            ids, pieces = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                for at in range(0, max(len(words) - size + 1, min(len(words), 1)), PIECE_WORDS):
                    ids.append(item)
                    pieces.append(b" ".join(words[at:at + PIECE_WORDS + size - 1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(pieces, pa.binary()),
                 pa.array([len(p) for p in pieces], pa.int64())], ["item_id", "words", "bytes"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(
        cut, "item_id string, words binary, bytes long")


def write_parts(benchmark: DataFrame, size: int = WINDOW, part_bytes: int = PART_BYTES) -> list[str]:
    """Write the items' pieces into files of about `part_bytes`; their paths, one a part."""
    spark = benchmark.sparkSession
    pieces = stored(_item_pieces(benchmark, size).distinct(), "items")
    total = pieces.agg(F.sum("bytes")).first()[0]
    if not total:
        return []
    folder = scratch_path(spark, "patterns")

    def write(batches):
        path, n = shards.new_name(folder, "items"), 0
        with shards.writer(path) as f:
            for batch in batches:
                for item, words in zip(batch.column("item_id").to_pylist(), batch.column("words").to_pylist()):
                    name = b"" if item is None else b"=" + item.encode()
                    f.write(b"%d %d\n" % (len(name), len(words)) + name + words + b"\n")
                    n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"path": [path]})

    dealt = pieces.select("item_id", "words").repartition(-(-total // part_bytes), "item_id", "words")
    return sorted(r["path"] for r in stored(dealt.mapInArrow(write, "path string"), "parts").collect())


def read_part(path: str) -> Iterator[tuple[str | None, list[bytes]]]:
    with shards.reader(path) as f:
        data = f.read()
    at = 0
    while at < len(data):
        line = data.index(b"\n", at)
        name, words = map(int, data[at:line].split())
        at = line + 1 + name + words + 1
        item = data[line + 1:line + 1 + name]
        yield item[1:].decode() if name else None, data[at - 1 - words:at - 1].split()


#: The one part that a worker has compiled last.
_COMPILED: dict[tuple[str, int], Patterns] = {}


def _compiled(path: str, size: int) -> Patterns:
    if (path, size) not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[path, size] = Patterns(read_part(path), size)
    return _COMPILED[path, size]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, part_bytes: int = PART_BYTES,
                  held_bytes: int = HELD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every row; `items` are the sorted ids of the items
    that have a window in the text."""
    paths = write_parts(benchmark, size, part_bytes)

    def search(batches):
        held, held_size = [], 0

        def found():
            spans, items = [[] for _ in held], [set() for _ in held]
            for path in paths:
                patterns = _compiled(path, size)
                for i, (_, _, text) in enumerate(held):
                    own, names = patterns.find(text)
                    spans[i] += own
                    items[i] |= names
            return pa.RecordBatch.from_arrays([
                pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()),
                pa.array([words_in(h[2], s) for h, s in zip(held, spans)], pa.int64()),
                pa.array([sorted(names) for names in items], pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "items"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = words_of(text.as_py())
                held.append((doc_id, len(words), joined(words)))
                held_size += len(held[-1][2]) + 200
                if held_size > held_bytes:
                    yield found()
                    held, held_size = [], 0
        if held:
            yield found()

    return docs.select("doc_id", "text").mapInArrow(search, HITS)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window; rows that share a doc_id go together."""
    hit = contamination(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias("hit")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("hit")), "left_anti")


def item_ids_sha256(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def oracle(docs: str = "documents", benchmark: str = "benchmark") -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with d as (select row_number() over () r, doc_id, coalesce(regexp_extract_all({low}, '{word}'), []) w from {docs}),
b as (select item_id, regexp_extract_all({low}, '{word}') w from {benchmark}),
p as (select distinct item_id, least(len(w), {WINDOW}) k,
             array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') run
      from (select *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, least(len(w), 1)) + 1)) i from b)),
g as (select r, k, i, array_to_string(w[i:i + k - 1], ' ') run
      from (select r, w, k, unnest(range(1, len(w) - k + 2)) i
            from d, (select distinct k from p) where len(w) >= k)),
h as (select r, i, p.k, item_id from g join p on g.k = p.k and g.run = p.run),
n as (select r, count(distinct word) n_hit from (select r, unnest(range(i, i + k)) word from h) group by r),
s as (select r, count(*) n_items, string_agg(name, ',' order by name) names
      from (select distinct r, item_id::varchar name from h where item_id is not null) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n using (r) left join s using (r)"""
