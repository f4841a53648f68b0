"""Looking k-mers up in shipped tables and filters."""

import numpy as np
import pytest

from readmend.functions import kmer_codes as kc
from readmend.functions import membership
from readmend.functions.murmur import Keys, murmur3_32
from readmend.operators import bloom


def test_kmers_of_one_prefix_lie_evenly(spark):
    """Few k-mers share an entry of the table, whatever their bases; a look-up reads few of them."""
    values = np.arange(0, 120_000, 3, dtype=np.int64)  # all begin with the same 12 bases
    solid = spark.createDataFrame([(int(v),) for v in values], "kmer bigint").repartition(3)
    members = bloom.ship_kmers(solid, 21, len(values))
    probed = np.concatenate((np.arange(130_000), 4 ** 21 - 1 - np.arange(1000))).astype(np.uint64)
    assert (members.contains(probed) == np.isin(probed, values.astype(np.uint64))).all()
    data = membership._mapped(members.file, np.uint8)
    before = data[:4 * ((1 << members.layout.prefix_bits) + 1)].view(np.uint32)
    assert np.diff(before.astype(np.int64)).max() < 40
    assert members.layout.size(len(values)) + 2000 > len(data)


@pytest.mark.parametrize("k", [10, 16, 21, 31])
def test_mixing_is_one_to_one(k):
    rng = np.random.default_rng(k)
    values = np.unique(np.concatenate((np.arange(5000), rng.integers(0, 4 ** k, 5000)))).astype(np.uint64)
    mixed = membership.WordLayout.of(10 ** 6, k).mixed(values)
    assert len(np.unique(mixed)) == len(values) and int(mixed.max()) < 4 ** k


@pytest.mark.parametrize("bits", [1, 3, 18, 21, 33, 62])
def test_low_bits_are_packed_end_to_end(bits):
    layout = membership.WordLayout(31, 62 - bits)
    values = np.random.default_rng(bits).integers(0, 1 << bits, 136).astype(np.uint64)
    whole = int.from_bytes(layout.packed(values | np.uint64(1 << bits if bits < 62 else 0)), "little")
    assert [whole >> i * bits & (1 << bits) - 1 for i in range(136)] == values.tolist()


@pytest.mark.parametrize("k", [10, 15, 20, 21, 31])
def test_packed_kmers_hash_as_their_characters(k):
    values = np.random.default_rng(k).integers(0, 4 ** k, 900).astype(np.uint64)
    for seed in (0, 77, 2 ** 31 - 1):
        want = murmur3_32(kc.to_bytes(values, k), seed)
        keys = Keys.of_packed(values, k)
        assert (keys.hashes(seed) == want).all()
        for width in (1000, 12345672, 2 ** 32):
            assert (keys.places(seed, width) == want.astype(np.int64) % width).all()


def test_known_hashes():
    text = np.frombuffer(b"hello", np.uint8).reshape(1, 5)
    assert murmur3_32(text, 0).tolist() == [0x248BFA47]
    assert murmur3_32(np.frombuffer(b"test", np.uint8).reshape(1, 4), 0).tolist() == [0xBA6BD213]


def test_the_profile_scans_the_reads_once(spark, monkeypatch):
    from readmend.operators import quality
    from readmend.plans import catalog

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    reads = spark.createDataFrame([(1, "#5AJ", "ACGT")] * 70, "mate int, qual string, seq string").mapInArrow(
        counted, "mate int, qual string, seq string")
    monkeypatch.setattr(catalog, "reads", lambda *_: reads)
    profile = catalog._profile(spark, "")
    assert seen.value == 70
    assert profile == quality.profile(quality.quality_histogram(reads))


def test_a_built_filter_leaves_no_shuffle_and_moves_three_bytes_a_bit(spark, tmp_path):
    def on_disk():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        files = [found.apply(i) for i in range(found.size())]
        return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}

    values = np.random.default_rng(2).integers(0, 4 ** 21, 60_000)
    solid = spark.createDataFrame([(int(v),) for v in values], "kmer bigint").repartition(3).cache()
    solid.count()
    before = set(on_disk())
    model = bloom.build_filter(solid, 21, len(values), 3, f"{tmp_path}/m", 0.001)
    assert sum(size for name, size in on_disk().items() if name not in before) < 20_000
    moved = bloom.filter_bits(solid, model)
    moved.write.format("noop").mode("overwrite").save()
    shuffled = sum(size for name, size in on_disk().items() if name not in before)
    assert len(values) < shuffled < 3.3 * len(values) * model.num_hash
    keys = Keys.of_packed(values, 21)
    assert model.in_parts.contains(keys, np.zeros(len(values), int)).all()
    solid.unpersist()
