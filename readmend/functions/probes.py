"""Arrow column functions that test strings and walks against shipped k-mers.

Four primitives carry the whole repair: flags of a string's k-mers, the changed
forms of a k-mer that are solid, the walks that keep every k-mer solid, and
whether any walk exists at all.

They are declared nondeterministic although they are not: the optimizer then
computes each once and leaves it where it is. Otherwise it copies a test into
every expression above that reads it, doubling the plan at each step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from readmend import config as C
from readmend.functions import kmer_codes as kc

_DIGITS = np.frombuffer(b"01", dtype=np.uint8)
#: Walks expanded at once; more are parked and resumed, so memory stays bounded.
_BLOCK = 40000


def _lengths(col: pa.Array) -> np.ndarray:
    return col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _flag_strings(members, strings: pa.Array) -> pa.Array:
    codes, offsets = kc.string_codes(strings)
    values, _, counts, clean = kc.canonical_windows(codes, offsets, members.k)
    solid = members.contains(values) & clean
    return kc.strings_from_codes(solid.astype(np.uint8), counts, _DIGITS)


def solid_flags(members, seq: Column) -> Column:
    """'1'/'0' for every k-mer of a string, left to right; '' for null."""

    @arrow_udf("string")
    def flags_of_kmers(col: pa.Array) -> pa.Array:
        return _flag_strings(members, col)

    return flags_of_kmers.asNondeterministic()(seq)


def solid_flags_each(members, strings: Column) -> Column:
    """`solid_flags` of every element of an array<string>."""

    @arrow_udf("array<string>")
    def flags_of_each(col: pa.Array) -> pa.Array:
        return kc.list_array(_lengths(col), _flag_strings(members, col.flatten()))

    return flags_of_each.asNondeterministic()(strings)


def _matrix(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Strings end to end to one row each, padded with 0 to `width`."""
    out = np.zeros((len(offsets) - 1, width), dtype=np.uint8)
    out[np.arange(width) < np.diff(offsets)[:, None]] = data
    return out


def _walk(members, context, own, lengths, forced, cap):
    """Expand every walk step by step over many tasks at once.

    At each step a walk keeps the read's own base if that k-mer is solid;
    otherwise, and always where forced, it branches to the other solid bases.
    Tasks with more than `cap` finished walks are given up. Returns (task,
    walk) of the finished ones in depth-first order, and the given-up tasks.
    """
    k, n = members.k, len(lengths)
    word = kc.word_type(k)
    one = (lambda v: np.uint64(v)) if word is np.uint64 else int
    forward = np.zeros(n, dtype=word)
    reverse = np.zeros(n, dtype=word)
    for j in range(k - 1):
        base = context[:, j].astype(word)
        forward = (forward << one(2)) | base
        reverse = reverse | ((one(3) - base) << one(2 * j))
    keep_bits = one((1 << (2 * (k - 1))) - 1)

    def grown(f, r, base):
        base = base.astype(word)
        return (f << one(2)) | base, r | ((one(3) - base) << one(2 * (k - 1)))

    def solid(f, r, base):
        return members.contains(np.minimum(*grown(f, r, base)))

    finished_count = np.zeros(n, dtype=np.int64)
    given_up = np.zeros(n, dtype=bool)
    done_task, done_walk = [], []
    parked = [(0, np.arange(n), forward, reverse, np.zeros(own.shape, dtype=np.uint8))]
    while parked:
        step, task, f, r, walk = parked.pop()
        live = ~given_up[task]
        ending = live & (lengths[task] == step)
        if ending.any():
            done_task.append(task[ending])
            done_walk.append(walk[ending])
            finished_count += np.bincount(task[ending], minlength=n)
            given_up |= finished_count > cap
            live &= ~ending & ~given_up[task]
        if not live.all():
            task, f, r, walk = task[live], f[live], r[live], walk[live]
        if not len(task):
            continue
        mine = own[task, step]
        row = np.arange(len(task))
        branch = np.zeros((len(task), 4), dtype=bool)
        branch[row, mine] = solid(f, r, mine)
        open_rows = np.flatnonzero(forced[task, step] | ~branch[row, mine])
        for turn in (1, 2, 3):
            other = (mine[open_rows] + turn) & 3
            branch[open_rows, other] = solid(f[open_rows], r[open_rows], other)
        parent, base = np.nonzero(branch)
        f, r = grown(f[parent], r[parent], base)
        walk, task = walk[parent], task[parent]
        walk[:, step] = base
        for at in reversed(range(0, len(task), _BLOCK)):
            cut = slice(at, at + _BLOCK)
            parked.append((step + 1, task[cut], f[cut] & keep_bits, r[cut] >> one(2), walk[cut]))
    if not done_task:
        return np.zeros(0, np.int64), np.zeros((0, own.shape[1]), np.uint8), given_up
    task, walk = np.concatenate(done_task), np.concatenate(done_walk)
    order = np.argsort(task, kind="stable")
    return task[order], walk[order], given_up


def solid_walks(members, tasks: Column) -> Column:
    """array<struct<ctx,own,forced>> to array<array<string>>: the walks of each
    task, null where there are more than the cap."""

    @arrow_udf("array<array<string>>")
    def walks_of_tasks(col: pa.Array) -> pa.Array:
        flat = col.flatten()
        if len(flat) == 0:
            return kc.list_array(_lengths(col), pa.array([], pa.list_(pa.string())))
        codes, offsets = kc.string_codes(flat.field("own"))
        lengths = np.diff(offsets)
        own = _matrix(codes, offsets, int(lengths.max()))
        forced = _matrix(*kc.string_bytes(flat.field("forced")), own.shape[1]) == ord("1")
        context = _matrix(*kc.string_codes(flat.field("ctx")), members.k - 1)
        task, walk, given_up = _walk(members, context, own, lengths, forced, C.MAX_PATHS)
        kept = ~given_up[task]
        task, walk = task[kept], walk[kept]
        inside = np.arange(walk.shape[1]) < lengths[task][:, None]
        strings = kc.strings_from_codes(walk[inside], lengths[task])
        counts = np.bincount(task, minlength=len(flat))
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        per_task = pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32(), mask=np.concatenate((given_up, [False]))), strings)
        return kc.list_array(_lengths(col), per_task)

    return walks_of_tasks.asNondeterministic()(tasks)


def any_walk(members, tasks: Column) -> Column:
    """array<struct<ctx,steps>> to array<boolean>: can `steps` solid k-mers
    follow the context, whatever their bases?"""

    @arrow_udf("array<boolean>")
    def walk_exists(col: pa.Array) -> pa.Array:
        flat = col.flatten()
        if len(flat) == 0:
            return kc.list_array(_lengths(col), pa.array([], pa.bool_()))
        lengths = flat.field("steps").to_numpy(zero_copy_only=False).astype(np.int64)
        context = _matrix(*kc.string_codes(flat.field("ctx")), members.k - 1)
        shape = (len(flat), int(lengths.max()))
        _, _, found = _walk(members, context, np.zeros(shape, np.uint8), lengths,
                            np.ones(shape, dtype=bool), 0)
        return kc.list_array(_lengths(col), pa.array(found))

    return walk_exists.asNondeterministic()(tasks)


#: k-mers whose changed forms are tested at once.
_SLICE = 2000


def _changed_forms(members, kmers, spots, spot_counts):
    """Solid forms of each k-mer (a code matrix): (row, group, form) in order."""
    k, n = members.k, len(kmers)
    word = kc.word_type(k)
    one = (lambda v: np.uint64(v)) if word is np.uint64 else int
    forward, reverse = np.zeros(n, dtype=word), np.zeros(n, dtype=word)
    for j in range(k):
        base = kmers[:, j].astype(word)
        forward = (forward << one(2)) | base
        reverse = reverse | ((one(3) - base) << one(2 * j))
    letters = np.arange(4).astype(word)

    def varied(f, r, at):
        """Every form with each of the four bases at `at` (one place a row)."""
        high = ((k - 1 - at) * 2).astype(word)[:, None]
        low = (at * 2).astype(word)[:, None]
        f = (f & ~(one(3) << high))[:, :, None] | (letters << high)[:, None, :]
        r = (r & ~(one(3) << low))[:, :, None] | ((one(3) - letters) << low)[:, None, :]
        return f.reshape(len(at), -1), r.reshape(len(at), -1)

    rows, groups, forms = [], [], []

    def keep(of, group, f, r, wanted=None):
        wanted = np.ones(f.shape, dtype=bool) if wanted is None else wanted
        hit = np.zeros(f.shape, dtype=bool)
        hit[wanted] = members.contains(np.minimum(f, r)[wanted])
        row, col = np.nonzero(hit)
        rows.append(of[row])
        groups.append(np.full(len(row), group))
        forms.append(f[row, col])

    for size in np.unique(spot_counts):
        of = np.flatnonzero(spot_counts == size)
        f, r = forward[of, None], reverse[of, None]
        for j in range(size):
            f, r = varied(f, r, spots[of, j])
        keep(of, 0, f, r)
    everyone = np.arange(n)
    single = [varied(forward[:, None], reverse[:, None], np.full(n, at)) for at in range(k)]
    keep(everyone, 1, np.concatenate([f for f, _ in single], axis=1),
         np.concatenate([r for _, r in single], axis=1),
         (np.arange(4) != kmers[:, :, None]).reshape(n, -1))
    keep(everyone, 2, forward[:, None], reverse[:, None])
    row, group, form = (np.concatenate(x) for x in (rows, groups, forms))
    order = np.argsort(row, kind="stable")
    return row[order], group[order], form[order]


def solid_changes(members, kmers: Column) -> Column:
    """struct<kmer,spots> to array<struct<group,kmer>>: its solid forms. Group 0
    varies the bases at the spots, first spot slowest; 1 changes one base; 2 is
    the k-mer itself. A form reached in two ways appears twice. Null is empty."""

    @arrow_udf("array<struct<group:int,kmer:string>>")
    def changes_of_kmers(col: pa.Array) -> pa.Array:
        given = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
        some = col.take(pa.array(given))
        codes, _ = kc.string_codes(some.field("kmer"))
        codes = codes.reshape(len(given), members.k)
        spot_counts = _lengths(some.field("spots"))
        flat = some.field("spots").flatten().to_numpy(zero_copy_only=False)
        spots = np.zeros((len(given), int(spot_counts.max(initial=0))), dtype=np.int64)
        spots[np.arange(spots.shape[1]) < spot_counts[:, None]] = flat
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64),
                  np.zeros(0, kc.word_type(members.k)))]
        for at in range(0, len(given), _SLICE):
            cut = slice(at, at + _SLICE)
            row, group, form = _changed_forms(
                members, codes[cut], spots[cut], spot_counts[cut])
            parts.append((row + at, group, form))
        row, group, form = (np.concatenate(x) for x in zip(*parts))
        text = kc.to_bytes(form, members.k)
        strings = pa.StringArray.from_buffers(
            len(form), pa.py_buffer((np.arange(len(form) + 1) * members.k).astype(np.int32).tobytes()),
            pa.py_buffer(text.tobytes()))
        counts = np.bincount(given[row], minlength=len(col))
        return kc.list_array(counts, pa.StructArray.from_arrays(
            [pa.array(group.astype(np.int32)), strings], ["group", "kmer"]))

    return changes_of_kmers.asNondeterministic()(kmers)
