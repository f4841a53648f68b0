import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import complement, simulate
from pyspark.sql import functions as F

from readmend.config import InputError
from readmend.functions import kmer_codes as kc
from readmend.functions.kmers import kmer_text
from readmend.operators import runs, spectrum


def reads_of(n=400, seed=3):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(2500))
    out = [None, "", "ACGT", "N" * 80, "A" * 3000, "AC" * 400]
    for _ in range(n):
        at = rng.randrange(len(genome) - 120)
        s = list(genome[at:at + rng.randrange(5, 120)])
        if rng.random() < 0.3:
            s[rng.randrange(len(s))] = rng.choice("NacgtR")
        s = "".join(s)
        out.append(complement(s.upper()) if rng.random() < 0.5 and set(s) <= set("ACGT") else s)
    return out + ["GATTACAGATTACAGATTACAGATTACA"] * 300 + ["A" * 60] * 900


def plain(reads, k):
    counts = Counter()
    for s in reads:
        s = (s or "").upper()
        for i in range(len(s) - k + 1):
            w = s[i:i + k]
            if set(w) <= set("ACGT"):
                counts[min(w, complement(w))] += 1
    return counts


@pytest.mark.parametrize("k, at_least, small", [
    (10, 1, False), (21, 2, True), (31, 1, True), (31, 2, False), (32, 1, True), (33, 2, False), (63, 1, True),
    (93, 2, True), (127, 1, False), (255, 2, True)])
def test_counts_equal_a_plain_count(spark, monkeypatch, k, at_least, small):
    if small:  # many batches, chunks, parts and hot buckets
        monkeypatch.setattr(runs, "_BATCH_BASES", 500)
        monkeypatch.setattr(runs, "_MOST_WORDS", 300)
        monkeypatch.setattr(runs, "_HOT_WINDOWS", 100)
        monkeypatch.setattr(runs, "_LONGEST", 5)
    reads = reads_of()
    if k > 60:
        reads += long_reads()
    df = spark.createDataFrame([(s,) for s in reads], "seq string").repartition(3)
    got = runs.count_by_runs(df, k, at_least).select(kmer_text(F.col("kmer"), k), "n").collect()
    expected = {w: n for w, n in plain(reads, k).items() if n >= at_least}
    assert expected and len(got) == len(expected) and dict(map(tuple, got)) == expected


def long_reads(seed=11):
    """Reads of 400 bases over each other, on both strands; some k-mers share their first words only."""
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(900))
    out = []
    for _ in range(60):
        at = rng.randrange(500)
        s = genome[at:at + 400]
        if rng.random() < 0.4:
            p = rng.randrange(400)
            s = s[:p] + rng.choice("ACGTN") + s[p + 1:]
        out.append(s if rng.random() < 0.5 else s[::-1].translate(str.maketrans("ACGTN", "TGCAN")))
    return out


@pytest.mark.parametrize("k", [21, 45])
def test_empty_table(spark, k):
    none = spark.createDataFrame([], "seq string")
    assert spectrum.kmer_counts(none, k).count() == 0


@pytest.mark.parametrize("k", [5, 31, 32, 62, 63, 255])
def test_words_order_as_bases_do(monkeypatch, k):
    rng = random.Random(k)
    texts = ["".join(rng.choices("ACGT", k=k)) for _ in range(40)]
    texts += [t[:-1] + c for t in texts[:9] for c in "ACGT"]
    words = kc.canonical_words(*kc.string_codes(pa.array(texts))[:1], np.arange(len(texts)) * k, k)
    least = [min(t, complement(t)) for t in texts]
    order = np.lexsort(words.T[::-1])
    assert [least[i] for i in order] == sorted(least)
    text_of = {tuple(w): t for w, t in zip(words.tolist(), least)}
    sums = Counter()
    for i, t in enumerate(least):
        sums[t] += i
    for one_hash in (False, True):
        if one_hash:  # different k-mers with equal hashes
            monkeypatch.setattr(kc, "_mixed", lambda w: np.zeros(len(w), np.uint64))
        for given, expected in ((None, Counter(least)), (np.arange(len(words)), sums)):
            values, n = kc.counted(words, given)
            assert {text_of[tuple(w)]: c for w, c in zip(values.tolist(), n.tolist())} == dict(expected)
            assert len(values) == len(expected)


def test_a_hot_bucket_is_counted_before_the_shuffle():
    rows = runs._rows_of(*kc.string_codes(pa.array(["A" * 60] * 2000)), 21, 64, 8).to_pylist()
    assert len(rows) == 2 and rows[0]["lengths"] is rows[0]["kmers"] is None
    assert rows[1]["bucket"] >= 64 and len(rows[1]["kmers"]) == 8


@pytest.mark.parametrize("width", [1, 2, 3, 8, 13, 23])
def test_sliding_minimum(width):
    x = np.random.default_rng(1).integers(0, 1000, 200).astype(np.uint64)
    got = runs._sliding_min(x, width)
    assert got.tolist() == [x[i:i + width].min() for i in range(len(x))]


def test_runs_pack_and_unpack():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 4, 500).astype(np.uint8)
    first, bases = np.array([0, 7, 100, 311]), np.array([21, 22, 23, 24])
    back, offsets = runs.unpack_runs(runs.pack_runs(codes, first, bases), bases)
    for i, (a, n) in enumerate(zip(first, bases)):
        assert back[offsets[i]:offsets[i + 1]].tolist() == codes[a:a + n].tolist()


def reads_with_a_hot_minimizer(n, k=21, seed=5):
    """Every window holds the M-mer of least hash between flanks that differ."""
    values = np.arange(4 ** runs.M, dtype=np.uint64)
    canonical = kc.canonical_windows(
        ((values[:, None] >> np.uint64(2) * np.arange(runs.M - 1, -1, -1, dtype=np.uint64)) & np.uint64(3)).astype(np.uint8).ravel(),
        np.arange(len(values) + 1) * runs.M, runs.M)[0]
    least = int(canonical[runs._order(canonical).argmin()])
    core = "".join("ACGT"[least >> 2 * i & 3] for i in reversed(range(runs.M)))
    rng = random.Random(seed)
    flank = k - runs.M
    return ["".join(rng.choices("ACGT", k=flank)) + core + "".join(rng.choices("ACGT", k=flank)) for _ in range(n)]


def test_a_bucket_of_many_kmers_is_not_held_whole(spark, monkeypatch):
    monkeypatch.setattr(runs, "_MOST_WORDS", 500)
    reads = reads_with_a_hot_minimizer(600)
    reads += reads[:200]
    rows = pa.Table.from_batches(
        [runs._rows_of(*kc.string_codes(pa.array(reads[i:i + 20])), 21, 64, 8) for i in range(0, len(reads), 20)])
    rows = rows.sort_by("bucket").to_batches(max_chunksize=4)
    found, sizes = Counter(), []
    for whole in (False, True):
        for batch in runs.counter(21, 64, whole)(rows):
            sizes.append(batch.num_rows)
            for kmer, n in zip(*(c.to_pylist() for c in batch.columns)):
                assert not (whole and kmer in found)
                found[kmer] += n
    assert max(sizes) < 2000 < len(found) and sorted(found.values()) == sorted(plain(reads, 21).values())
    df = spark.createDataFrame([(s,) for s in reads], "seq string").repartition(3)
    same_counts(df, reads, 21, 2)


@pytest.mark.parametrize("k, most", [(21, 500), (33, 50)])
def test_a_large_bucket_is_counted_by_its_task(monkeypatch, k, most):
    """A bucket of several times `_MOST_WORDS` is counted in passes, and none of it is left to the aggregate."""
    monkeypatch.setattr(runs, "_MOST_WORDS", most * len(kc.word_bases(k)))
    reads = reads_with_a_hot_minimizer(200)
    reads += reads[:60]
    rows = pa.Table.from_batches(
        [runs._rows_of(*kc.string_codes(pa.array(reads[i:i + 2])), k, 64, 8) for i in range(0, len(reads), 2)])
    windows = Counter()
    for bucket, lengths in zip(*(rows.column(c).to_pylist() for c in (0, 1))):
        windows[bucket] += sum(lengths)
    assert 4 * most < max(windows.values()) < 16 * most
    rows = rows.sort_by("bucket").to_batches(max_chunksize=4)
    assert sum(b.num_rows for b in runs.counter(k, 64, False)(rows)) == 0
    batches = list(runs.counter(k, 64, True)(rows))
    found = [tuple(row) for b in batches for row in zip(*(c.to_pylist() for c in b.columns))]
    assert max(b.num_rows for b in batches) < 2 * most
    assert len({row[:-1] for row in found}) == len(found)
    assert sorted(row[-1] for row in found) == sorted(plain(reads, k).values())


def same_counts(df, reads, k, at_least):
    got = runs.count_by_runs(df, k, at_least).select(kmer_text(F.col("kmer"), k), "n").collect()
    expected = {w: n for w, n in plain(reads, k).items() if n >= at_least}
    assert len(got) == len(expected) and dict(map(tuple, got)) == expected


@pytest.mark.parametrize("k", [21, 40])
def test_a_hot_bucket_of_different_kmers_is_dealt_over_tasks(spark, monkeypatch, k):
    monkeypatch.setattr(runs, "_HOT_WINDOWS", 1000)
    cold, hot = reads_of(), reads_with_a_hot_minimizer(3000, k)
    reads = cold + hot + hot[:500]
    width = len(kc.word_bases(k))
    rows = runs._rows_of(*kc.string_codes(pa.array(reads)), k, 64, 8)
    sizes, marked = Counter(), set()
    for row in rows.to_pylist():
        sizes[row["bucket"]] += len(row["kmers"] or b"") // (8 * width)
        if row["lengths"] is None and row["kmers"] is None:
            marked.add(row["bucket"])
    dealt = [sizes[b] for b in range(64, 72)]
    assert marked and min(dealt) > 0 and max(dealt) < 1.2 * min(dealt)
    # the hot minimizer comes late: batches before it leave its bucket to one task, a mark tells of the rest
    monkeypatch.setattr(runs, "_BATCH_BASES", 20_000)
    df = spark.createDataFrame([(s,) for s in reads], "seq string").coalesce(2)
    for at_least in (1, 2):
        same_counts(df, reads, k, at_least)


def test_buckets_stay_small_with_few_tasks(spark, monkeypatch):
    """More words than one count holds, in few partitions: no count is shuffled again."""
    monkeypatch.setattr(runs, "_MOST_WORDS", 4000)
    rng = random.Random(9)
    reads = ["".join(rng.choices("ACGT", k=100)) for _ in range(4000)]
    seen = []
    counter = runs.counter

    def watched(k, buckets, whole):
        seen.append(buckets)
        return counter(k, buckets, whole)

    monkeypatch.setattr(runs, "counter", watched)
    df = spark.createDataFrame([(s,) for s in reads], "seq string").repartition(2)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        same_counts(df, reads, 21, 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    rows = pa.Table.from_batches([runs._rows_of(*kc.string_codes(pa.array(reads)), 21, seen[0], 1)])
    assert sum(b.num_rows for b in counter(21, seen[0], False)(rows.to_batches())) == 0


@pytest.mark.parametrize("k", [21, 33])
@pytest.mark.parametrize("most", [150, 1 << 22])
def test_windows_as_read_and_their_places(spark, monkeypatch, k, most):
    monkeypatch.setattr(runs, "_MOST_WORDS", most)
    monkeypatch.setattr(runs, "_BATCH_BASES", 5000)
    texts = reads_of(120) + ["\u00df" + "ACGTTGCA" * 8, "\U0001f600" + "ACGTTGCAN" * 9, "x" * 50]
    rows = [(i % 3 if i % 7 else None, s) for i, s in enumerate(texts)]
    df = spark.createDataFrame(rows, "mate int, seq string").repartition(2)
    want = {}
    for mate, s in rows:
        s = (s or "").upper()
        for i in range(len(s) - k + 1):
            n, low, high = want.get((mate, s[i:i + k]), (0, i, i))
            want[mate, s[i:i + k]] = (n + 1, min(low, i), max(high, i))
    done = spectrum.window_counts(df, k, "mate")
    assert [f.dataType.simpleString() for f in done.schema] == ["int", "string", "bigint", "int", "int"]
    got = done.collect()
    assert len(got) == len(want) and {(r[0], r[1]): tuple(r[2:]) for r in got} == want
    if k == 21:  # runs are shuffled, not windows
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "bases" in plan and "MapInArrow" in plan


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_windows_joined_by_runs(spark, monkeypatch, chunk):
    monkeypatch.setattr(runs, "_JOINED_WINDOWS", chunk)
    monkeypatch.setattr(runs, "_BATCH_BASES", 5000)
    texts = [s for s in reads_of(150) if s and set(s) <= set("ACGT")] + ["", None]
    rows = [(None if i % 50 == 3 else i // 2, s) for i, s in enumerate(texts)]
    reads = spark.createDataFrame(rows, "read_id bigint, seq string").repartition(3)
    known = {w for i, w in enumerate(sorted(plain([s for s in texts[:90] if s], 21))) if i % 3}
    from readmend.functions.bases import pack_kmer
    kmers = spark.createDataFrame([(w,) for w in known], "kmer string").select(pack_kmer(F.col("kmer")).alias("kmer"))
    want = {}
    for rid, s in rows:
        for i in range(len(s or "") - 20):
            w = s[i:i + 21]
            old = want.get(rid, (0, 0, None))
            hit = min(w, complement(w)) in known
            want[rid] = (old[0] + hit, old[1] + (not hit),
                         old[2] if hit else min(i, old[2] if old[2] is not None else i))
    got = runs.joined_by_runs(reads, kmers, 21, "read_id").groupBy("read_id").agg(
        F.sum("n_solid"), F.sum("n_weak"), F.min("first_weak")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want
    none = runs.joined_by_runs(reads, kmers.limit(0), 21, "read_id").agg(F.sum("n_solid"), F.count("first_weak")).first()
    assert none[0] == 0 and none[1] > 0


@pytest.mark.parametrize("k", [5, 21, 29, 30, 31, 33, 62, 94])
def test_words_of_packed_runs(k):
    """Windows are cut from the packed bytes: no array of all bases is rolled."""
    rng = np.random.default_rng(k)
    codes = rng.integers(0, 4, 9000).astype(np.uint8)
    first = np.array([0, 300, 301, 8000])
    windows = np.array([1, 7, 200, 3])
    bases = windows + k - 1
    packed = runs.pack_runs(codes, first, bases)
    size = -(-bases // 4)
    got = kc.packed_words(packed, runs._spans(4 * (np.cumsum(size) - size), windows), k)
    assert got.tolist() == kc.canonical_words(codes, runs._spans(first, windows), k).tolist()


def test_small_buckets_are_counted_together():
    rng = random.Random(5)
    reads = ["".join(rng.choices("ACGT", k=100)) for _ in range(300)]
    rows = pa.Table.from_batches(
        [runs._rows_of(*kc.string_codes(pa.array(reads)), 21, 8192, 8)]).sort_by("bucket")
    assert rows.num_rows > 1000
    batches = list(runs.counter(21, 8192, True)(rows.to_batches(max_chunksize=50)))
    assert len(batches) == 1 and sum(batches[0].column(1).to_pylist()) == 300 * 80


def test_windows_in_short_and_odd_reads():
    rng = random.Random(6)
    reads = ["".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=rng.randrange(60))) for _ in range(400)] + ["", "ACGTA"]
    codes, offsets = kc.string_codes(pa.array(reads))
    want = [int(o) + i for r, o in zip(reads, offsets) for i in range(len(r) - 12) if "N" not in r[i:i + 13]]
    assert kc.clean_starts(codes, offsets, 13).tolist() == want


def test_sorted_counts_are_stored_as_differences(spark):
    from pyarrow import fs

    from readmend.sources import files
    from readmend.sources.scratch import written

    n = 200_000
    table = written(spark.range(0, n, 1, 2).selectExpr("id * 15000000 + id % 7 as kmer", "id % 9 + 2 as n"))
    system, inner = files.resolve(table.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "file:"))
    assert sum(f.size for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith("parquet")) < 4 * n
    assert table.selectExpr("sum(kmer)", "sum(n)").first()[0] == sum(i * 15000000 + i % 7 for i in range(n))


def _shuffled(spark):
    """Bytes of each shuffle's data that lie on the disk."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [found.apply(i) for i in range(found.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_only_solid_kmers_are_stored_and_no_shuffle_is_left(spark):
    reads = spark.createDataFrame([(s,) for _, s, _, _ in simulate()], "seq string").repartition(3)
    counts = spectrum.kmer_counts(reads, 13)
    hist = spectrum.kmer_histogram(counts)
    threshold = spectrum.find_threshold(hist)
    assert threshold > 2
    want = {tuple(r) for r in counts.where(F.col("n") >= threshold).collect()}
    before = _shuffled(spark)
    table, least, n_solid = spectrum.solid_counts(counts)
    assert (least, n_solid) == (threshold, len(want))
    assert {tuple(r) for r in table.collect()} == want
    # the runs of the reads took 30 KB and more; one row of a task is left
    assert sum(size for name, size in _shuffled(spark).items() if name not in before) < 3000
    assert spectrum.unique_solid(hist, threshold).first()["n_solid"] == n_solid


def test_solid_counts_without_a_valley_raise(spark):
    reads = spark.createDataFrame([("ACGTTGCATTACGGAC",)] * 2, "seq string")
    with pytest.raises(InputError, match="no valley"):
        spectrum.solid_counts(spectrum.kmer_counts(reads, 13))


def test_bloom_params_store_the_histogram_only(spark, tmp_path):
    from readmend.plans import catalog
    from readmend.sources.scratch import scratch_dir

    rng = random.Random(9)
    text = "".join(rng.choices("acgt", k=20_000))
    copies = [text] * 4 + [text[:at] + "tgca" + text[at + 4:] for at in range(100, 20_000, 1000)]
    spark.createDataFrame(enumerate(copies), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(scratch_dir(spark).removeprefix("file:"))
    before = set(folder.rglob("*.parquet"))
    found = catalog.bloom_params(spark, str(tmp_path)).first()
    assert found["num_kmers"] > 15_000
    assert sum(p.stat().st_size for p in folder.rglob("*.parquet") if p not in before and p.is_file()) < 20_000
