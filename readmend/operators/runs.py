"""Counting k-mers by runs that share a minimizer.

Neighbouring k-mers of a read mostly have the same minimizer, the M-mer of least hash in
them, taken on the strand where it is smaller. A run of them moves as its bases, 2 bits each,
to the task of the minimizer's bucket, and not as one row a k-mer. Equal k-mers have equal
minimizers, so a bucket counts its k-mers by itself, by sorting. A k-mer is a row of words of
up to 31 bases, so k has no limit.

A bucket that fills far more than its share of a batch of reads, and some of the whole batch whatever the number of
tasks (an adapter, poly-A, a frequent minimizer), is dealt: its k-mers of that batch are counted at once and go to all tasks by a hash
of the k-mer, and a mark tells the bucket's own task that its counts are not all. Each batch
decides for itself, and every other batch has at most `_HOT_TIMES` the mean, or `_HOT_SHARE`, in one bucket: with many
tasks the mean is small, and dealt k-mers take many times the bytes of runs.

There are `_LEAST_BUCKETS` buckets at least, so that a bucket holds few words whatever the number of
tasks. One without a mark and with at most `_MOST_PASSES` * `_MOST_WORDS` words is whole: one task counts it
and gives final counts. Beyond `_MOST_WORDS` words it keeps the runs packed, a little more than a byte a window, and counts in
passes, each with the k-mers of one remainder of a hash. The others and what was dealt are counted so many words at
a time; Spark's aggregate by k-mer, which spills by itself, adds these parts up. Both ways read the same exchange, one
after the other.

The same exchange serves what needs more than counts: `windows_by_runs` counts k-mers as read with their
places, `joined_by_runs` joins the windows of reads to a table of k-mers. Their runs carry a
tag of the read and where in it they begin.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmend.config import PACKED_MAX_K
from readmend.functions import kmer_codes as kc
from readmend.functions.bases import unpack_kmer

M = 9
BUCKETS_A_PARTITION = 32
_LEAST_BUCKETS = 8192
#: Windows of one run, so that a byte holds the number.
_LONGEST = 200
_BATCH_BASES = 4 << 20
#: A bucket of so many times the mean windows of a batch (over `BUCKETS_A_PARTITION` buckets a task), and
#: of at least so many, and of more than such a share of them, is dealt.
_HOT_TIMES, _HOT_WINDOWS, _HOT_SHARE = 8, 4096, 1 / 256
#: Words of k-mers that are counted together.
_MOST_WORDS = 4 << 20
#: Times a bucket is read over at most, so many words being counted each time.
_MOST_PASSES = 16
#: Small buckets are counted together up to so many.
_WORDS_AT_ONCE = 1 << 20
_MOVED = "bucket int, lengths binary, bases binary, kmers binary, counts binary"
_NAMES = [c.split()[0] for c in _MOVED.split(", ")]


def _order(values: np.ndarray) -> np.ndarray:
    """A hash that orders minimizers."""
    h = (values + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


@cache
def _ordered() -> np.ndarray:
    """What orders each M-mer: the place of its canonical form's hash among all of them, so that 4 bytes do."""
    letters = (np.arange(4 ** M)[:, None] >> 2 * np.arange(M - 1, -1, -1) & 3).astype(np.uint8)
    small = np.minimum(kc.rolling(letters.ravel(), M)[::M], kc.rolling(3 - letters[:, ::-1].ravel(), M)[::M])
    hashes = _order(small)
    return np.searchsorted(np.unique(hashes), hashes).astype(np.uint32)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values; of fewer at the end."""
    def with_later(x, by):
        out = x.copy()
        np.minimum(x[:-by], x[by:], out=out[:-by])
        return out

    span = 1
    while 2 * span <= width:
        x = with_later(x, span)
        span *= 2
    return x if span == width else with_later(x, width - span)


def find_runs(codes: np.ndarray, offsets: np.ndarray, k: int, start: np.ndarray | None = None):
    """(minimizer hash, first base, windows) of every run, of the clean windows that begin at `start` or of all."""
    if start is None:
        start = kc.clean_starts(codes, offsets, k)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    # M-mers with odd characters or over the end of a string are in no clean window
    least = _sliding_min(_ordered()[kc.rolling(codes & 3, M)], k - M + 1)[start]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(start)))
    if windows.max() > _LONGEST:
        pieces = -(-windows // _LONGEST)
        before = _spans(np.zeros(len(first), np.int64), pieces) * _LONGEST
        first, windows = np.repeat(first, pieces) + before, np.repeat(windows, pieces) - before
        windows = np.minimum(windows, _LONGEST)
    return _order(least[first].astype(np.uint64)), start[first], windows


def _spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for each i, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def pack_runs(codes: np.ndarray, first: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """Bases of the runs, each filled up to whole bytes."""
    c = np.append(codes & 3, np.zeros(3, np.uint8))
    four = (c[:-3] << 6) | (c[1:-2] << 4) | (c[2:-1] << 2) | c[3:]
    size = -(-bases // 4)
    ends = np.cumsum(size)
    out = four[4 * _spans(np.zeros(len(size), np.int64), size) + np.repeat(first, size)]
    out[ends - 1] &= (0xFF << 2 * (4 * size - bases) & 0xFF).astype(np.uint8)
    return out


def unpack_runs(data: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes end to end, offsets)."""
    whole = -(-bases // 4) * 4
    four = np.stack([data >> 6, (data >> 4) & 3, (data >> 2) & 3, data & 3], 1).ravel()
    return (four[_spans(np.cumsum(whole) - whole, bases)],
            np.concatenate(([0], np.cumsum(bases))))


def _edges(sorted_ids: np.ndarray) -> np.ndarray:
    """Where each id begins, and the end."""
    return np.flatnonzero(np.diff(np.append(np.append(-1, sorted_ids), -1)))


def _part_of(kmers: np.ndarray, parts: int) -> np.ndarray:
    mixed = np.zeros(len(kmers), np.uint64)
    for word in kmers.T:
        mixed = _order(mixed ^ word)
    return (mixed % np.uint64(parts)).astype(np.int64)


def _rows_of(codes, offsets, k, buckets, parts):
    """Rows of `_MOVED`. Dealt k-mers go to the buckets from `buckets` on, of which there are `parts`."""
    hashes, first, windows = find_runs(codes, offsets, k)
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    cols: list[list] = [[] for _ in _NAMES]

    def add(*row):
        for c, v in zip(cols, row):
            c.append(v)

    mean = windows.sum() / min(buckets, BUCKETS_A_PARTITION * parts)
    hot = np.bincount(bucket, windows, buckets) > max(
        _HOT_TIMES * mean, _HOT_WINDOWS, _HOT_SHARE * windows.sum())
    if hot.any():
        for b in np.flatnonzero(hot):
            add(int(b), None, None, None, None)
        dealt = hot[bucket]
        kmers, n = kc.counted(kc.canonical_words(codes, _spans(first[dealt], windows[dealt]), k))
        part = _part_of(kmers, parts)
        by_part = np.argsort(part, kind="stable")
        kmers, n, part = kmers[by_part], n[by_part], part[by_part]
        edges = _edges(part)
        for a, b in zip(edges, edges[1:]):
            add(buckets + int(part[a]), None, None, kmers[a:b].tobytes(), n[a:b].tobytes())
    light = np.flatnonzero(~hot[bucket])
    light = light[np.argsort(bucket[light].astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")]
    bases = windows[light] + k - 1
    packed = pack_runs(codes, first[light], bases)
    ends = np.concatenate(([0], np.cumsum(-(-bases // 4))))
    edges = _edges(bucket[light])
    for a, b in zip(edges, edges[1:]):
        add(int(bucket[light[a]]), windows[light[a:b]].astype(np.uint8).tobytes(),
            packed[ends[a]:ends[b]].tobytes(), None, None)
    types = [pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], _NAMES)


def counter(k: int, buckets: int, whole: bool):
    """Counts rows of `_MOVED` that come one bucket after the other, in batches of the k-mer's words
    and `n`: final counts of the whole buckets only, or else the parts of all others."""
    width = len(kc.word_bases(k))
    most, together = _MOST_WORDS // width, _WORDS_AT_ONCE // width
    held_most = most * _MOST_PASSES
    names = [*(f"w{i}" for i in range(width)), "n"]

    def words_of(rows):
        windows = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).astype(np.int64)
        size = -(-(windows + k - 1) // 4)
        data = np.frombuffer(b"".join(r[1] for r in rows), np.uint8)
        return kc.packed_words(data, _spans(4 * (np.cumsum(size) - size), windows), k)

    def of_runs(rows):
        return kc.counted(words_of(rows))

    def of_dealt(rows):
        kmers = np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(-1, width)
        return kc.counted(kmers, np.frombuffer(b"".join(r[3] for r in rows), np.int64))

    def batch(kmers, n):
        return pa.RecordBatch.from_arrays(
            [*(pa.array(np.ascontiguousarray(w).view(np.int64)) for w in kmers.T), pa.array(n)], names)

    def batch_of(rows):
        return batch(*(of_runs(rows) if rows[0][0] is not None else of_dealt(rows)))

    def in_chunks(rows):
        """The rows, of at most `most` words together or single ones."""
        chunk, size = [], 0
        for row in rows:
            more = words_in(row)
            if chunk and size + more > most:
                yield chunk
                chunk, size = [], 0
            chunk.append(row)
            size += more
        yield chunk

    def in_passes(rows, size):
        """Final counts of a bucket of more than `most` words."""
        passes, chunks = -(-size // most), list(in_chunks(rows))
        for turn in range(passes):
            found = []
            for chunk in chunks:
                kmers = words_of(chunk)
                found.append(kc.counted(kmers[_part_of(kmers, passes) == turn]))
            yield batch(*kc.counted(*(np.concatenate(c) for c in zip(*found))))

    def words_in(row):
        return sum(row[0]) if row[0] is not None else len(row[3]) // 8

    def count(batches):
        rows, size, bucket, parted = [], 0, None, False
        done, held = [], 0  # whole buckets that are counted at once: no two share a k-mer
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != bucket:
                    if rows and not whole and parted:
                        yield batch_of(rows)
                    if rows and whole and not parted:
                        if size > most:
                            yield from in_passes(rows, size)
                        else:
                            if done and held + size > together:
                                yield batch_of(done)
                                done, held = [], 0
                            done, held = done + rows, held + size
                    rows, size, bucket, parted = [], 0, row[0], row[0] >= buckets
                if row[1] is None and row[3] is None:
                    parted = True  # some of the bucket was dealt
                else:
                    rows.append(row[1:])
                    size += words_in(rows[-1])
                    parted = parted or size > held_most
                if parted and (whole or size > most):
                    *full, rows = [[]] if whole else in_chunks(rows)
                    for chunk in full:
                        yield batch_of(chunk)
                    size = sum(map(words_in, rows))
        if rows and whole and size > most:
            yield from in_passes(rows, size)
            rows = []
        last = rows if parted != whole else []
        if done or last:
            yield batch_of(done + last)

    return count


def count_by_runs(reads: DataFrame, k: int, min_count: int, seq: str = "seq") -> DataFrame:
    """(kmer, n bigint) of canonical k-mers seen at least `min_count` times; packed bigints up to
    31 bases, strings beyond. What a batch deals depends on its reads, so that a task that is run
    again must get its reads in the same order: reads that were shuffled are sorted first."""
    partitions = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS_A_PARTITION * partitions, _LEAST_BUCKETS)

    def cut(batches):
        held, size = [], 0
        for batch in batches:
            codes, offsets = kc.string_codes(batch.column(0))
            held.append((codes, offsets))
            size += len(codes)
            if size >= _BATCH_BASES:
                yield _rows_of(*_joined(held), k, buckets, partitions)
                held, size = [], 0
        if held:
            yield _rows_of(*_joined(held), k, buckets, partitions)

    widths = kc.word_bases(k)
    words = [f"w{i}" for i in range(len(widths))]
    moved = (reads.select(F.col(seq)).mapInArrow(cut, _MOVED)
             .repartition(partitions, "bucket").sortWithinPartitions("bucket"))
    schema = ", ".join(f"{w} bigint" for w in words) + ", n bigint"
    parts = moved.mapInArrow(counter(k, buckets, False), schema).groupBy(*words).agg(F.sum("n").alias("n"))
    counts = moved.mapInArrow(counter(k, buckets, True), schema).unionAll(parts).where(F.col("n") >= min_count)
    if k <= PACKED_MAX_K:
        return counts.select(F.col(words[0]).alias("kmer"), "n")
    return counts.select(
        F.concat(*(unpack_kmer(F.col(w), size) for w, size in zip(words, widths))).alias("kmer"), "n")


def _joined(held):
    codes = np.concatenate([c for c, _ in held])
    at, offsets = 0, [np.zeros(1, np.int64)]
    for c, o in held:
        offsets.append(o[1:] + at)
        at += len(c)
    return codes, np.concatenate(offsets)


_TAGGED = "bucket int, lengths binary, bases binary, tags binary, starts binary, kmers binary"
_TAGGED_NAMES = [c.split()[0] for c in _TAGGED.split(", ")]


def _tagged(cols) -> pa.RecordBatch:
    types = [pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], _TAGGED_NAMES)


def _narrow(values: np.ndarray) -> np.ndarray:
    """In the narrowest type that holds all of them."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64)
                              if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _wide(pieces: list[bytes], counts: list[int]) -> np.ndarray:
    """Pieces of so many `_narrow` values each, end to end."""
    return np.concatenate([np.frombuffer(p, f"<i{len(p) // n}").astype(np.int64) for p, n in zip(pieces, counts)])


def _tagged_rows(codes, offsets, tags: pa.Array, k: int, buckets: int, odd: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of `_TAGGED` for strings with a bigint tag each. A start below 0 is -1 less it, of no tag. With `odd`, which
    marks characters that are coded as some base, only windows that hold such a one; `kmers` then has these marks, packed as
    the bases are."""
    start = None
    if odd is not None:
        start = kc.clean_starts(codes, offsets, k)
        before = np.concatenate(([0], np.cumsum(odd)))
        start = start[before[start + k] > before[start]]
    hashes, first, windows = find_runs(codes, offsets, k, start)
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, first, windows = bucket[order], first[order], windows[order]
    string = np.searchsorted(offsets, first, "right") - 1
    start = first - offsets[string]
    none = tags.is_null().to_numpy(zero_copy_only=False)[string]
    start[none] = -1 - start[none]
    start = _narrow(start)
    tag = _narrow(tags.fill_null(0).to_numpy(zero_copy_only=False))[string]
    bases = windows + k - 1
    packed = pack_runs(codes, first, bases)
    marks = packed if odd is None else pack_runs(odd.astype(np.uint8), first, bases)
    ends = np.concatenate(([0], np.cumsum(-(-bases // 4))))
    cols: list[list] = [[] for _ in _TAGGED_NAMES]
    edges = _edges(bucket)
    for a, b in zip(edges, edges[1:]):
        for c, v in zip(cols, (int(bucket[a]), windows[a:b].astype(np.uint8).tobytes(),
                               packed[ends[a]:ends[b]].tobytes(), tag[a:b].tobytes(), start[a:b].tobytes(),
                               None if odd is None else marks[ends[a]:ends[b]].tobytes())):
            c.append(v)
    return _tagged(cols)


def _tagged_runs(reads: DataFrame, k: int, buckets: int, tag: str, seq: str, with_n: bool = False) -> DataFrame:
    def rows_of(columns, tags):
        strings = pa.concat_arrays(columns)
        codes, offsets = kc.string_codes(strings)
        odd = None
        if with_n:
            odd = kc.string_bytes(strings)[0] == ord("N")
            codes = np.where(odd, 0, codes).astype(np.uint8)
        return _tagged_rows(codes, offsets, pa.concat_arrays(tags), k, buckets, odd)

    def cut(batches):
        held, tags, size = [], [], 0
        for batch in batches:
            held.append(batch.column(0))
            tags.append(batch.column(1))
            size += len(kc.string_bytes(held[-1])[0])
            if size >= _BATCH_BASES:
                yield rows_of(held, tags)
                held, tags, size = [], [], 0
        if held:
            yield rows_of(held, tags)

    return reads.select(F.col(seq), F.col(tag).cast("bigint")).mapInArrow(cut, _TAGGED)


def _bucket_chunks(batches, most: int):
    """(bucket, rows, is the bucket's last) of rows that come one bucket after the other, with at most
    `most` windows at a time."""
    rows, size, bucket = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            more = 0 if row[1] is None else sum(row[1])
            if rows and (row[0] != bucket or size + more > most):
                yield bucket, rows, row[0] != bucket
                rows, size = [], 0
            bucket = row[0]
            rows.append(row[1:])
            size += more
    if rows:
        yield bucket, rows, True


def _unpacked(rows, k: int):
    """(codes, start of every window in them, its run, windows of each run, tag or null, start) of rows of `_TAGGED`."""
    counts = [len(r[0]) for r in rows]
    windows = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).astype(np.int64)
    codes, offsets = unpack_runs(np.frombuffer(b"".join(r[1] for r in rows), np.uint8), windows + k - 1)
    begin = _wide([r[3] for r in rows], counts)
    none = begin < 0
    tag = pa.array(_wide([r[2] for r in rows], counts), mask=none)
    run = np.repeat(np.arange(len(windows)), windows)
    return (codes, _spans(offsets[:-1], windows), run, windows, tag, np.where(none, -1 - begin, begin))


def _with_marks(rows, kmer: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """k-mers of up to 21 bases, each followed by a bit a base that says whether it is an N."""
    windows = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).astype(np.int64)
    marks, _ = unpack_runs(np.frombuffer(b"".join(r[4] for r in rows), np.uint8), windows + k - 1)
    for j in range(k):
        kmer = (kmer << np.uint64(1)) | marks[place + j].astype(np.uint64)
    return kmer


def _spelled(kmer: np.ndarray, k: int) -> pa.Array:
    """`_with_marks` as text."""
    codes = np.empty((len(kmer), k), np.uint8)
    for j in range(k):
        codes[:, j] = (kmer >> np.uint64(k + 2 * (k - 1 - j))) & np.uint64(3)
        codes[(kmer >> np.uint64(k - 1 - j)) & np.uint64(1) == 1, j] = 4
    return kc.strings_from_codes(codes.ravel(), np.full(len(kmer), k), np.frombuffer(b"ACGTN", np.uint8))


def windows_counter(k: int, whole: bool, with_n: bool = False):
    """Counts windows as read by tag: (tag, kmer, n, min_pos, max_pos), final ones of the buckets that their task
    counts, in passes where they are large, or else the parts of all others. `with_n`: text k-mers of windows that hold N."""
    names = ["tag", "kmer", "n", "min_pos", "max_pos"]

    def summed(label, kmer, n, low, high):
        """Figures of each label (an index, or -1) and k-mer."""
        order = np.lexsort((kmer, label)) if len(label) and label.min() < label.max() else np.argsort(kmer)
        kmer, label = kmer[order], label[order]
        new = np.flatnonzero(np.concatenate(([True], (kmer[1:] != kmer[:-1]) | (label[1:] != label[:-1]))))
        n = np.diff(np.append(new, len(kmer))) if n is None else np.add.reduceat(n[order], new)
        return (label[new], kmer[new], n, np.minimum.reduceat(low[order], new), np.maximum.reduceat(high[order], new))

    def figures(rows, known, turn=0, passes=1):
        """Of a chunk's k-mers that have their turn; a label is a place among the `known` tags."""
        codes, place, run, _, tag, begin = _unpacked(rows, k)
        first = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1))
        kmer = kc.rolling(codes, k)[place]
        if with_n:
            kmer = _with_marks(rows, kmer, place, k)
        pos = begin[run] + place - np.repeat(place[first], np.diff(np.append(first, len(place))))
        label = tag.dictionary_encode()
        labels = np.array([known.setdefault(t, len(known)) for t in label.dictionary.to_pylist()] + [-1], np.int64)
        label = labels[label.indices.fill_null(-1).to_numpy(zero_copy_only=False)][run]
        if passes > 1:
            mine = _part_of(kmer[:, None], passes) == turn
            label, kmer, pos = label[mine], kmer[mine], pos[mine]
            if not len(kmer):
                return label, kmer, pos, pos, pos
        return summed(label, kmer, None, pos, pos)

    def batch_of(found, known):
        label, kmer, n, low, high = found
        tags = pa.array([*known, None], pa.int64())
        return pa.RecordBatch.from_arrays(
            [tags.take(pa.array(np.where(label < 0, len(known), label))),
             _spelled(kmer, k) if with_n else pa.array(kmer.astype(np.int64)), pa.array(n),
             pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names)

    def in_passes(chunks):
        for turn in range(len(chunks)):
            known: dict = {}
            found = [figures(chunk, known, turn, len(chunks)) for chunk in chunks]
            if len(found) > 1:
                found = [np.concatenate(c) for c in zip(*found)]
                if len(found[0]):
                    yield batch_of(summed(*found), known)
            else:
                yield batch_of(found[0], known)

    def count(batches):
        chunks, parted = [], False
        for _, rows, last in _bucket_chunks(batches, _MOST_WORDS):
            chunks.append(rows)
            parted = parted or len(chunks) > _MOST_PASSES
            if parted:
                for chunk in [] if whole else chunks:
                    known: dict = {}
                    yield batch_of(figures(chunk, known), known)
                chunks = []
            if last:
                if whole and chunks:
                    yield from in_passes(chunks)
                chunks, parted = [], False

    return count


def windows_by_runs(reads: DataFrame, k: int, tag: str, seq: str = "seq", with_n: bool = False) -> DataFrame:
    """(tag, kmer packed, n, min_pos, max_pos) of the windows as read that have no odd characters, k up to 31; `with_n`: of
    those of A, C, G, T and N that hold an N, k up to 21, as text."""
    partitions = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS_A_PARTITION * partitions, _LEAST_BUCKETS)
    moved = _tagged_runs(reads, k, buckets, tag, seq, with_n)
    moved = (moved if with_n else moved.drop("kmers")).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    schema = f"tag bigint, kmer {'string' if with_n else 'bigint'}, n bigint, min_pos int, max_pos int"
    parts = moved.mapInArrow(windows_counter(k, False, with_n), schema).groupBy("tag", "kmer").agg(
        F.sum("n").alias("n"), F.min("min_pos").alias("min_pos"), F.max("max_pos").alias("max_pos"))
    return moved.mapInArrow(windows_counter(k, True, with_n), schema).unionAll(parts).withColumnRenamed("tag", tag)


#: Windows that are joined at once.
_JOINED_WINDOWS = 1 << 20


def windows_joiner(k: int):
    """Rows of `_TAGGED`, in each bucket the k-mers first: (tag, n_solid, n_weak, first_weak) of every run."""
    names = ["tag", "n_solid", "n_weak", "first_weak"]

    def join(batches):
        held, known, before = [], None, None
        for bucket, rows, _ in _bucket_chunks(batches, _JOINED_WINDOWS):
            if bucket != before:
                held, known, before = [], None, bucket
            held += [r[4] for r in rows if r[4] is not None]
            rows = [r for r in rows if r[4] is None]
            if not rows:
                continue
            if known is None:
                known = np.sort(np.frombuffer(b"".join(held), np.int64))
            codes, place, run, windows, tag, begin = _unpacked(rows, k)
            kmer = kc.canonical_words(codes, place, k)[:, 0].astype(np.int64)
            solid = np.zeros(len(kmer), bool)
            if len(known):
                solid = known[np.minimum(np.searchsorted(known, kmer), len(known) - 1)] == kmer
            first = np.cumsum(windows) - windows
            n_solid = np.add.reduceat(solid.astype(np.int64), first)
            inside = np.arange(len(kmer)) - first[run]
            weak = np.minimum.reduceat(np.where(solid, 256, inside), first)
            yield pa.RecordBatch.from_arrays(
                [tag, pa.array(n_solid), pa.array(windows - n_solid),
                 pa.array((begin + weak).astype(np.int32), mask=weak == 256)], names)

    return join


def joined_by_runs(reads: DataFrame, kmers: DataFrame, k: int, tag: str, seq: str = "seq") -> DataFrame:
    """Joins the windows of reads to the packed canonical `kmers`, runs of windows at a time: (tag, n_solid, n_weak,
    first_weak: the place of the first window that has no match), some rows a read."""
    partitions = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_A_PARTITION * partitions
    digits = 2 * np.arange(k - 1, -1, -1)

    def placed(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            size += len(held[-1])
            if size * k >= _BATCH_BASES:
                yield in_buckets(np.concatenate(held))
                held, size = [], 0
        if size:
            yield in_buckets(np.concatenate(held))

    def in_buckets(values):
        codes = ((values[:, None] >> digits) & 3).astype(np.uint8).ravel()
        hashes, _, _ = find_runs(codes, np.arange(len(values) + 1) * k, k)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, values = bucket[order], values[order]
        edges = _edges(bucket)
        none = [None] * (len(edges) - 1)
        return _tagged([bucket[edges[:-1]].tolist(), none, none, none, none,
                        [values[a:b].tobytes() for a, b in zip(edges, edges[1:])]])

    both = _tagged_runs(reads, k, buckets, tag, seq).unionAll(kmers.select("kmer").mapInArrow(placed, _TAGGED))
    moved = both.repartition(partitions, "bucket").sortWithinPartitions("bucket", F.col("kmers").isNull())
    return moved.mapInArrow(windows_joiner(k), "tag bigint, n_solid bigint, n_weak bigint, first_weak int"
                            ).withColumnRenamed("tag", tag)
