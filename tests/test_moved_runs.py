"""What counting and window counts move, and that large buckets are counted by their task."""

import random

import pyarrow as pa
import pytest
from conftest import complement
from pyspark.sql import functions as F

from readmend.functions import kmer_codes as kc
from readmend.operators import runs, spectrum


def reads_with_n(n=300, seed=3):
    rng = random.Random(seed)
    genome = "".join(rng.choices("ACGT", k=3000))
    out = []
    for i in range(n):
        at = rng.randrange(2900)
        s = list(genome[at:at + rng.randrange(10, 100)])
        for _ in range(rng.randrange(4)):
            s[rng.randrange(len(s))] = rng.choice("NNnNacgR" if i % 20 == 0 else "N")
        out.append("".join(s))
    return out + ["N" * 60, "N" * 21, "ACGTN" * 9, None, ""]


@pytest.mark.parametrize("k", [13, 21, 22])
@pytest.mark.parametrize("most", [40, 1 << 22])
def test_windows_with_n_are_counted_as_read(spark, monkeypatch, k, most):
    monkeypatch.setattr(runs, "_MOST_WORDS", most)
    monkeypatch.setattr(runs, "_MOST_PASSES", 5)
    monkeypatch.setattr(runs, "_BATCH_BASES", 4000)
    rows = [(None if i % 9 == 0 else 700 * (i % 2) + 1, s) for i, s in enumerate(reads_with_n())]
    want = {}
    for mate, s in rows:
        s = (s or "").upper()
        for i in range(len(s) - k + 1):
            n, low, high = want.get((mate, s[i:i + k]), (0, i, i))
            want[mate, s[i:i + k]] = (n + 1, min(low, i), max(high, i))
    df = spark.createDataFrame(rows, "mate int, seq string").repartition(2)
    got = spectrum.window_counts(df, k, "mate").collect()
    assert len(got) == len(want) and {(r[0], r[1]): tuple(r[2:]) for r in got} == want


def test_windows_with_n_move_as_runs():
    """Not as 21 characters a window."""
    strings = pa.array([s for s in reads_with_n() if s and set(s) <= set("ACGTN")] * 5)
    data, offsets = kc.string_bytes(strings)
    odd = data == ord("N")
    codes, _ = kc.string_codes(strings)
    codes[odd] = 0
    rows = runs._tagged_rows(codes, offsets, pa.array([1] * len(strings)), 21, 64, odd)
    windows = sum(sum(v) for v in rows.column("lengths").to_pylist())
    assert windows == sum("N" in s[i:i + 21] for s in strings.to_pylist() for i in range(len(s) - 20)) > 10_000
    assert sum(len(v) for c in rows.columns[1:] for v in c.to_pylist()) < 4 * windows


def test_tags_and_starts_take_few_bytes():
    codes, offsets = kc.string_codes(pa.array(["ACGTTGCAGGCTAACCGTTACGGATCCATTGCA"] * 50))
    rows = runs._tagged_rows(codes, offsets, pa.array([2] * 50), 21, 64)
    n = sum(len(v) for v in rows.column("lengths").to_pylist())
    assert sum(len(v) for c in ("tags", "starts") for v in rows.column(c).to_pylist()) == 2 * n
    far = runs._narrow(runs.np.array([-5, 40_000, 7]))
    assert far.dtype == runs.np.int32 and runs._wide([far.tobytes(), b"\x03"], [3, 1]).tolist() == [-5, 40_000, 7, 3]


def test_windows_of_a_large_bucket_are_not_left_to_the_aggregate(monkeypatch):
    monkeypatch.setattr(runs, "_MOST_WORDS", 100)
    rng = random.Random(1)
    reads = ["".join(rng.choices("ACGT", k=100)) for _ in range(12)]
    rows = pa.Table.from_batches([runs._tagged_rows(*kc.string_codes(pa.array(reads[i:i + 1])), pa.array([i % 2]), 21, 1)
                                  for i in range(12)]).drop_columns("kmers").to_batches()
    assert sum(b.num_rows for b in runs.windows_counter(21, False)(rows)) == 0
    found = [r for b in runs.windows_counter(21, True)(rows) for r in b.to_pylist()]
    assert len({(r["tag"], r["kmer"]) for r in found}) == len(found) and sum(r["n"] for r in found) == 12 * 80


@pytest.mark.parametrize("k", [21, 33])
def test_many_tasks_deal_no_more(monkeypatch, k):
    """With many tasks the mean of a bucket is small; a usual minimizer is dealt no more often for that."""
    monkeypatch.setattr(runs, "_HOT_WINDOWS", 10)
    rng = random.Random(k)
    reads = ["".join(rng.choices("ACGT", k=100)) for _ in range(3000)]
    codes, offsets = kc.string_codes(pa.array(reads))
    rows = runs._rows_of(codes, offsets, k, 19200, 600)
    assert rows.column("lengths").null_count == 0
    hot = kc.string_codes(pa.array(reads + ["A" * 100] * 40))
    assert runs._rows_of(*hot, k, 19200, 600).column("lengths").null_count > 0


def test_counts_with_many_tasks(spark):
    rng = random.Random(8)
    reads = ["".join(rng.choices("ACGT", k=80)) for _ in range(200)] * 2 + ["A" * 90] * 200
    want = {}
    for s in reads:
        for i in range(len(s) - 20):
            w = min(s[i:i + 21], complement(s[i:i + 21]))
            want[w] = want.get(w, 0) + 1
    df = spark.createDataFrame([(s,) for s in reads], "seq string").repartition(3)
    got = runs.count_by_runs(df, 21, 2).agg(F.count("*"), F.sum("n"), F.max("n")).first()
    assert tuple(got) == (len(want), sum(want.values()), max(want.values()))
