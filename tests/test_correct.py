import numpy as np
import pytest
from conftest import complement
from plain_corrector import correct_all
from pyspark.sql import functions as F

from readmend import config as C
from readmend.functions.kmers import kmer_text
from readmend.operators import bloom, correct, quality, spectrum
from readmend.operators.joined import JoinedSearcher
from readmend.operators.repair import ShippedSearcher

COLUMNS = ("seq", "qual", "n_edits", "trim5", "trim3", "rejected")


def as_dict(done):
    return {r["read_id"]: tuple(r[c] for c in COLUMNS) for r in done.collect()}


def prepared(spark, rows, k, threshold=None):
    reads = spark.createDataFrame([r[:3] for r in rows], "read_id bigint, seq string, qual string")
    profile = quality.profile(quality.quality_histogram(reads))
    counts = spectrum.kmer_counts(reads, k).cache()
    hist = spectrum.kmer_histogram(counts)
    t = threshold or spectrum.find_threshold(hist)
    solid = spectrum.solid_kmers(counts, t)
    texts = {r[0] for r in solid.select(kmer_text(F.col("kmer"), k)).collect()}
    return reads, profile, solid, texts


@pytest.mark.parametrize("k, threshold", [(13, None), (21, 5), (35, 4)])
def test_same_as_plain_correction(spark, simulated, k, threshold):
    reads, profile, solid, texts = prepared(spark, simulated, k, threshold)
    members = bloom.ship_kmers(solid, k, len(texts))
    got = as_dict(correct.corrected(reads, ShippedSearcher(members), k, profile))
    want = correct_all([r[:3] for r in simulated], texts, k, profile.offset,
                       profile.cutoff, profile.extremely_low)
    different = {i: (got[i], want[i]) for i in want if got[i] != want[i]}
    assert not different, (len(different), list(different.items())[:2])
    assert sum(v[2] > 0 for v in got.values()) > 100


def test_most_planted_errors_are_repaired(spark, simulated):
    reads, profile, solid, texts = prepared(spark, simulated, 21, 5)
    got = as_dict(correct.corrected(
        reads, ShippedSearcher(bloom.ship_kmers(solid, 21, len(texts))), 21, profile))
    before = after = 0
    for rid, seq, _, truth in simulated:
        new, qual, _, t5, t3, _ = got[rid]
        assert len(new) == len(qual) == len(truth) - t5 - t3 or got[rid][5]
        kept = truth[t5:len(truth) - t3]
        raw = seq.upper()[t5:len(truth) - t3]
        before += sum(a != b for a, b in zip(raw, kept))
        after += sum(a != b for a, b in zip(new, kept))
    assert after < before * 0.2, (before, after)


def test_joins_find_what_shipped_kmers_find(spark, simulated):
    rows = simulated[:300]
    reads, profile, solid, texts = prepared(spark, simulated, 21, 5)
    some = reads.where(F.col("read_id") < len(rows))
    shipped = as_dict(correct.corrected(
        some, ShippedSearcher(bloom.ship_kmers(solid, 21, len(texts))), 21, profile))
    counts = spectrum.kmer_counts(reads, 21)
    joined = as_dict(correct.corrected(
        some, JoinedSearcher.over(solid, 21, counts), 21, profile))
    assert joined == shipped


def test_filter_never_misses_and_seldom_errs(spark, simulated, tmp_path):
    reads, profile, solid, texts = prepared(spark, simulated, 21, 5)
    model = bloom.build_filter(solid, 21, len(texts), 5, f"{tmp_path}/m", 0.01)
    again = bloom.FilterModel.load(f"{tmp_path}/m", 21)
    assert again == model
    members = again.ship(spark)
    known = spark.createDataFrame([(t,) for t in texts], "kmer string")
    assert bloom.solid_membership(known, members).where(~F.col("solid")).count() == 0
    import random
    rng = random.Random(1)
    other = set()
    while len(other) < 4000:
        t = "".join(rng.choice("ACGT") for _ in range(21))
        t = min(t, complement(t))
        if t not in texts:
            other.add(t)
    probed = spark.createDataFrame([(t,) for t in other], "kmer string")
    assert bloom.solid_membership(probed, members).where("solid").count() < 4000 * 0.02
    with pytest.raises(C.ConfigError):
        bloom.FilterModel.load(f"{tmp_path}/m", 31)


def test_no_size_is_too_large(spark, simulated, tmp_path):
    """A filter in parts answers alike near the data and shipped, wherever it is cut."""
    _, _, solid, texts = prepared(spark, simulated, 21, 5)
    assert bloom.ship_kmers(solid, 21, len(texts), ship_limit=100) is None
    model = bloom.build_filter(solid, 21, len(texts), 5, f"{tmp_path}/m", 0.05, part_bytes=400)
    assert model.parts > 5
    again = bloom.FilterModel.load(f"{tmp_path}/m", 21)
    assert again == model
    rows = spark.createDataFrame([(t,) for t in sorted(texts)], "kmer string").unionByName(
        spark.createDataFrame([(min(t[::-1], complement(t[::-1])),) for t in sorted(texts)], "kmer string"))
    got = {r["kmer"]: r["solid"] for r in bloom.filter_membership(rows, again).collect()}
    parts, keys = again.in_parts, np.array([list(t.encode()) for t in got], np.uint8)
    assert list(got.values()) == parts.contains(keys, parts.part_of(keys)).tolist()
    assert all(got[t] for t in texts) and sum(got.values()) < len(texts) * 1.15
    with pytest.raises(C.ConfigError):
        again.ship(spark)


def test_filter_of_one_part_near_the_data_equals_shipped(spark, simulated, tmp_path):
    reads, profile, solid, texts = prepared(spark, simulated[:250], 21, 3)
    some = reads.where(F.col("read_id") < 60)
    model = bloom.build_filter(solid, 21, len(texts), 3, f"{tmp_path}/m", 0.2)
    shipped = as_dict(correct.corrected(some, ShippedSearcher(model.ship(spark)), 21, profile))
    moved = as_dict(correct.corrected(some, JoinedSearcher.over_filter(model), 21, profile))
    assert moved == shipped


def test_correction_with_shipped_kmers_does_not_shuffle(spark, simulated):
    reads, profile, solid, texts = prepared(spark, simulated, 21, 5)
    searcher = ShippedSearcher(bloom.ship_kmers(solid, 21, len(texts)))
    plan = correct.corrected(reads, searcher, 21, profile)._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString()


def test_scalar_rules_differ_only_where_stated(spark, simulated):
    reads, profile, solid, texts = prepared(spark, simulated, 21, 5)
    searcher = ShippedSearcher(bloom.ship_kmers(solid, 21, len(texts)))
    same = as_dict(correct.corrected(reads, searcher, 21, profile))
    other = as_dict(correct.corrected(reads, searcher, 21, profile, compat="scalar"))
    assert same.keys() == other.keys()
    assert sum(same[i] != other[i] for i in same) < len(same) * 0.1


@pytest.mark.parametrize("k, n", [(10, 1), (10, 3000), (21, 40000), (31, 2000)])
def test_kmers_are_shipped_without_what_neighbours_share(spark, monkeypatch, k, n):
    from pyspark.sql import DataFrame

    def refuse(*_):
        raise AssertionError("k-mers pass the driver")

    rng = np.random.default_rng(k)
    values = np.unique(np.concatenate((rng.integers(0, 4**k, n), [0, 4**k - 1]))).astype(np.int64)
    solid = spark.createDataFrame([(int(v),) for v in values], "kmer bigint").repartition(3)
    if hasattr(DataFrame, "toArrow"):
        monkeypatch.setattr(type(solid), "toArrow", refuse)
    members = bloom.ship_kmers(solid, k, len(values))
    probed = np.unique(np.concatenate((values, values ^ 1, rng.integers(0, 4**k, 5000)))).astype(np.uint64)
    assert (members.contains(probed) == np.isin(probed, values.astype(np.uint64))).all()
    assert members.layout.size(83_000_000) < 8 * 83_000_000 or k == 31


@pytest.mark.parametrize("k, n", [(10, 3000), (21, 40000), (30, 9000), (31, 2000)])
def test_kmers_move_in_slabs_before_they_are_shipped(spark, monkeypatch, k, n):
    """Not as rows that are sorted by range, which took most of the disk."""
    from pyspark.sql import DataFrame

    rng = np.random.default_rng(k)
    values = np.unique(np.concatenate((rng.integers(0, 4**k, n), np.arange(300), [4**k - 1]))).astype(np.int64)
    solid = spark.createDataFrame([(int(v),) for v in values], "kmer bigint").repartition(3)
    monkeypatch.setattr(type(solid), "repartitionByRange", None)
    monkeypatch.setattr(bloom, "_SLAB_KMERS", 64)
    monkeypatch.setattr(bloom, "_KMERS_AT_ONCE", 500)
    members = bloom.ship_kmers(solid, k, len(values))
    probed = np.unique(np.concatenate((values, values ^ 1, rng.integers(0, 4**k, 5000)))).astype(np.uint64)
    assert (members.contains(probed) == np.isin(probed, values.astype(np.uint64))).all()


def test_no_kmers_are_shipped(spark):
    members = bloom.ship_kmers(spark.createDataFrame([], "kmer bigint"), 21, 0)
    assert not members.contains(np.arange(9, dtype=np.uint64)).any()


def test_a_gigabyte_of_reads_has_its_kmers_shipped():
    """83 million solid 21-mers, as 1 GB of documents has, took 664 MB."""
    from readmend.functions.membership import WordLayout

    assert WordLayout.of(83_000_000, 21).size(83_000_000) < 256 << 20


@pytest.mark.parametrize("k, part_bytes", [(21, 300_000), (21, 5000), (35, 7000)])
def test_filter_bits_without_an_aggregate(spark, monkeypatch, tmp_path, k, part_bytes):
    from readmend.functions.murmur import murmur3_32

    monkeypatch.setattr(bloom, "_SLAB_BITS", 1 << 16)
    monkeypatch.setattr(bloom, "_KMERS_AT_ONCE", 700)
    rng = np.random.default_rng(4)
    texts = sorted({"".join(rng.choice(list("ACGT"), k)) for _ in range(3000)})
    keys = np.array([list(t.encode()) for t in texts], np.uint8)
    rows = spark.createDataFrame([(t,) for t in texts], "kmer string").repartition(3)
    if k == 21:
        rows = bloom.pack_column(rows, k)
    model = bloom.build_filter(rows, k, len(texts), 3, f"{tmp_path}/m", 0.01, part_bytes=part_bytes)
    assert (model.parts > 1) == (part_bytes < 100_000)
    part = (murmur3_32(keys, model.part_seed) % model.parts if model.parts > 1 else np.zeros(len(keys), int))
    want = {(int(p), int(b)) for s in model.seeds
            for p, b in zip(part, murmur3_32(keys, s).astype(np.int64) % model.part_bits)}
    bits = bloom.filter_bits(rows, model)
    assert "Aggregate" not in bits._jdf.queryExecution().executedPlan().toString()
    found = bits.collect()
    assert len({(r["part"], r["bucket"]) for r in found}) == len(found)
    got = {(r["part"], r["bucket"] * 32768 + int(i)) for r in found
           for i in np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little"))}
    assert got == want
    assert model.in_parts.contains(keys, part).all()


def test_common_edits_do_not_compare_each_with_each(spark):
    import time

    from readmend.operators.repair import common_edits

    def shared(*lists):
        rows = [([[(p, b) for p, b in one] for one in lists],)]
        df = spark.createDataFrame(rows, "lists array<array<struct<pos:int,base:string>>>")
        out = df.select(F.expr(common_edits("lists")).alias("c"))
        assert out.schema["c"].dataType.simpleString() == "array<struct<pos:int,base:string>>"
        found = out.first()["c"]
        return found if found is None else [tuple(e) for e in found]

    assert shared() is None and shared([]) == [] and shared([(3, "A")], []) == []
    assert shared([(5, "A"), (5, "A"), (1, "C")]) == [(5, "A"), (5, "A"), (1, "C")]
    assert shared([(12, "A"), (7, "T"), (1, "C")], [(1, "C"), (1, "2"), (7, "G"), (12, "A")]) == [(12, "A"), (1, "C")]
    many = [(i, "ACGT"[i % 4]) for i in range(30000)]
    start = time.time()
    assert shared(many, many[::-1]) == many
    assert time.time() - start < 10
