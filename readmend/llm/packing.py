"""Best-fit packing of token pieces by linear grouping.

Lengths are at most the capacity of a sequence, so the whole packing problem is a
histogram of at most `capacity` rows, however many documents there are. It is solved on
the driver; the documents are only ranked within their length and looked up.

1. Large lengths, sorted, are cut into groups of equal cardinality; each is rounded up to
   the largest length of its group.
2. The few sizes left are packed by a configuration linear program (column generation,
   knapsack pricing). Whole parts of its solution are kept; the rest of the demand, a few
   sequences, is packed largest first.
3. Actual lengths take the places of the rounded ones.
4. Small lengths, largest first, go where the gap is tightest; new sequences come last.

A null text is an empty one: its document has just the end id. Repeated rows are packed as
often as they occur. Equal lengths are interchangeable: ties are ranked by doc_id, piece
and checksum. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readmend.llm.common import stored
from readmend.llm.tokens import END_ID, open_tokenizer

CAPACITY = 1024
#: Lengths above this share of the capacity are large; the better plan of these is taken.
LARGE_SHARES = (0.3, 0.45)
GROUPS = 96
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document with an end id; only longer ones are cut, and then
    the first piece is the one that may be shorter."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def cut(batches):
        encoder, end = open_tokenizer(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            cols = [[] for _ in names]
            ids_of = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(ids_of, encoder.encoded(batch.column("text").to_pylist())):
                ids += end
                n, at = len(ids) // 4, 0
                size = n if n <= capacity else n % capacity or capacity
                piece = 0
                while at < n:
                    part = ids[4 * at:4 * (at + size)]
                    for c, v in zip(cols, (doc_id, piece, at, size, zlib.crc32(part))):
                        c.append(v)
                    at, size, piece = at + size, capacity, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


# --- the plan ---------------------------------------------------------------------

def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) runs of groups of equal cardinality, largest lengths first."""
    total = sum(counts.values())
    share = max(1, math.ceil(total / groups))
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append([])
                room = share
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def best_configuration(value: np.ndarray, sizes: np.ndarray, capacity: int):
    """The multiset of sizes of most value that fits."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= w)
        got = best[w - sizes[fits]] + value[fits]
        k = int(got.argmax())
        if got[k] > best[w - 1]:
            best[w], last[w] = got[k], fits[k]
        else:
            best[w] = best[w - 1]
    config, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            config[last[w]] += 1
            w -= int(sizes[last[w]])
    return best[capacity], config


def configurations(sizes: list[int], demand: list[int], capacity: int,
                   rounds: int = 3000) -> list[tuple[float, np.ndarray]]:
    """The configuration linear program: (how often, sizes) of least total."""
    size, need = np.array(sizes), np.array(demand, float)
    k = len(sizes)
    columns = np.diag((capacity // size).astype(float))
    cost, inverse = np.ones(k), np.diag(1 / np.diag(columns))
    amount = inverse @ need
    for _ in range(rounds):
        dual = cost @ inverse
        if dual.min() < -1e-9:  # a surplus is worth having
            entering, price = np.zeros(k), 0.0
            entering[dual.argmin()] = -1
        else:
            worth, entering = best_configuration(dual, size, capacity)
            price = 1.0
            if worth <= 1 + 1e-7:
                break
        step = inverse @ entering
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        leaving = int(ratio.argmin())
        if not np.isfinite(ratio[leaving]):
            break
        pivot = inverse[leaving] / step[leaving]
        inverse -= np.outer(step, pivot)
        inverse[leaving] = pivot
        columns[:, leaving], cost[leaving] = entering, price
        amount = np.maximum(inverse @ need, 0)
    return [(a, columns[:, j].astype(int)) for j, a in enumerate(amount)
            if cost[j] and a > 1e-9]


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS,
                 large_shares: tuple[float, ...] = LARGE_SHARES) -> list[tuple[int, list[int]]]:
    """(how many sequences, lengths in them) for a histogram of lengths."""
    plans = [_plan(counts, capacity, groups, s) for s in large_shares]
    return min(plans, key=lambda plan: sum(times for times, _ in plan))


def _plan(counts, capacity, groups, large_share):
    counts = {length: n for length, n in counts.items() if n}
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("lengths must be in 1..capacity")
    done = [(counts.pop(capacity), [capacity])] if capacity in counts else []
    large = {x: n for x, n in counts.items() if x > large_share * capacity}
    grouped = linear_groups(large, groups)
    sizes, members = [], []
    for group in grouped:  # groups that round to one size are one
        if sizes and group[0][0] == sizes[-1]:
            members[-1] = members[-1] + group
        else:
            sizes.append(group[0][0])
            members.append(list(group))
    left = [sum(n for _, n in m) for m in members]
    rounded: list[tuple[int, list[int]]] = []
    if sizes:
        for amount, config in sorted(configurations(sizes, left, capacity), key=lambda c: -c[0]):
            slots = [k for k in range(len(sizes)) for _ in range(config[k])]
            times = int(min([amount + 1e-6, *(left[k] // config[k] for k in set(slots))]))
            if times:
                rounded.append((times, slots))
                for k in slots:
                    left[k] -= times
    bins: dict[int, list] = defaultdict(list)  # gap -> [times, lengths]
    for times, slots in rounded:
        for part in _substituted(times, slots, members):
            bins[capacity - sum(part[1])].append(part)
    rest = sorted([x for m in members for x in m if x[1]]
                  + [(x, n) for x, n in counts.items() if x not in large], reverse=True)
    for length, n in rest:
        _best_fit(bins, length, n, capacity)
    return done + [(t, lengths) for parts in bins.values() for t, lengths in parts]


def _substituted(times: int, slots: list[int], members) -> list[list]:
    """Runs of equal sequences, each rounded size replaced by lengths of its group."""
    out = []
    while times:
        now = times
        for k in set(slots):
            # all slots of a group draw from its first run
            now = min(now, max(members[k][0][1] // slots.count(k), 1))
        lengths = []
        for k in slots:
            need = now
            length, n = members[k][0]
            if n < need:  # the run ends within one sequence
                need = now = 1
            lengths.append(length)
            members[k][0] = (length, n - need)
            if members[k][0][1] == 0:
                members[k].pop(0)
        out.append([now, lengths])
        times -= now
    return out


def _best_fit(bins, length: int, n: int, capacity: int) -> None:
    while n:
        gap = min((g for g, parts in bins.items() if g >= length and parts), default=None)
        if gap is None:
            each = capacity // length
            if n >= each:
                bins[capacity - each * length].append([n // each, [length] * each])
                n %= each
            if n:
                bins[capacity - n * length].append([1, [length] * n])
            return
        times, lengths = bins[gap].pop()
        each = gap // length
        full = min(times, n // each)
        if full:
            bins[gap - each * length].append([full, lengths + [length] * each])
            n -= full * each
        if n and full < times:
            bins[gap - n * length].append([1, lengths + [length] * n])
            n, full = 0, full + 1
        if full < times:
            bins[gap].append([times - full, lengths])


# --- placement ----------------------------------------------------------------------

def places(plan: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset): pieces of one
    length, by rank, lie in consecutive sequences at one offset."""
    used, out, sequence = defaultdict(int), [], 0
    for times, lengths in plan:
        offset = 0
        for length in lengths:
            r = used[length]
            out.append((length, r, r + times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return out


def ranked_in_length(pieces: DataFrame, total: int) -> DataFrame:
    """`rank` of every piece among those of its length. Ranks are counted in slices of
    about the root of all rows, so that no length has to meet in one task."""
    slices = max(1, math.isqrt(total))
    cut = pieces.withColumn("slice", F.pmod(
        F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)))
    counts = cut.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.select("length", "slice",
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    return (cut.withColumn("inside", F.row_number().over(inside) - 1)
            .join(starts, ["length", "slice"])
            .withColumn("rank", F.col("before") + F.col("inside")))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with `sequence_id` and `offset`. `pieces` is read three times, so it
    should be a stored table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    placed = spark.createDataFrame(
        places(plan_packing(counts, capacity)) or [(0, 0, 0, 0, 0)],
        "length long, first long, after long, sequence long, offset long")
    # bounded: runs of the plan, a few for each of at most `capacity` lengths
    found = ranked_in_length(pieces, sum(counts.values())).join(
        F.broadcast(placed.withColumnRenamed("length", "of")),
        F.expr("length = of and rank >= first and rank < after"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32",
                        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"),
                        "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(stored(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)
