import gzip
import os

import pytest
from pyspark.sql import functions as F

from readmend import config as C
from readmend.operators import correct, quality, spectrum
from readmend.plans import cli
from readmend.plans.correction import correct_group, correct_read_list, spread
from readmend.sources.fastq import read_fastq, write_fastq
from readmend.sources.readlist import group_prefix, read_list

TRICKY = [
    ("a 1", "ACGT", "+", "@@@@"), ("b", "GG", "+b", "+@"), ("c", "ACGTN", "+", "@+I@I"),
    ("d", "T", "+", "+"), ("e", "CATTAG", "+e x", "@IIIII"),
]


def text_of(records, end="\n"):
    return end.join(line for n, s, p, q in records for line in (f"@{n}", s, p, q))


def rows(df):
    return [(r["name"], r["seq"], r["plus"], r["qual"])
            for r in df.orderBy("file_id", "read_idx").collect()]


@pytest.mark.parametrize("size", [1, 3, 7, 16, 50, 10000])
def test_ranges_do_not_change_the_records(spark, tmp_path, size):
    many = TRICKY * 4
    path = tmp_path / "x.fastq"
    path.write_text(text_of(many))      # no newline at the end
    df = read_fastq(spark, str(path), size)
    assert rows(df) == many
    assert df.select("read_idx").distinct().count() == len(many)


def test_carriage_returns_and_gzip(spark, tmp_path):
    path = tmp_path / "x.fastq"
    path.write_bytes(text_of(TRICKY, "\r\n").encode())
    packed = tmp_path / "y.fastq.gz"
    packed.write_bytes(gzip.compress((text_of(TRICKY) + "\n").encode()))
    df = read_fastq(spark, [str(path), str(packed)])
    assert rows(df) == TRICKY * 2
    write_fastq(df.where("file_id = 1"), str(tmp_path / "out"), gzip=True, sort=True)
    written = sorted(p for p in os.listdir(tmp_path / "out") if p.endswith(".gz"))
    joined = "".join(gzip.open(tmp_path / "out" / p, "rt").read() for p in written)
    assert joined == text_of(TRICKY) + "\n"


def test_empty_and_broken_files(spark, tmp_path):
    (tmp_path / "empty.fastq").write_text("")
    with pytest.raises(Exception, match="is empty"):
        read_fastq(spark, str(tmp_path / "empty.fastq")).count()
    (tmp_path / "bad.fastq").write_text("@a\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="not as long"):
        read_fastq(spark, str(tmp_path / "bad.fastq")).count()


@pytest.mark.parametrize("lines", [1, 2, 3])
@pytest.mark.parametrize("size", [5, 40, 10000])
def test_a_cut_off_record_is_an_error(spark, tmp_path, lines, size):
    whole = text_of(TRICKY).split("\n")
    path = tmp_path / "cut.fastq"
    path.write_text("\n".join(whole[:len(whole) - lines]) + "\n")
    with pytest.raises(Exception, match="ends inside a record|no record"):
        read_fastq(spark, str(path), size).count()


def test_lines_without_a_record_are_an_error(spark, tmp_path):
    path = tmp_path / "no.fastq"
    path.write_text(text_of(TRICKY) + "\n" + "ACGT\n" * 60)
    with pytest.raises(Exception, match="no record|does not begin"):
        read_fastq(spark, str(path), 40).count()


def test_groups_of_one_name_are_refused(spark):
    with pytest.raises(C.ConfigError, match="write over"):
        correct_read_list(spark, [["a/x.fastq"], ["b/x.fastq"]], C.RunConfig(k=21))


def test_quality_characters_out_of_range(spark):
    def profile_of(*codes):
        return quality.profile(spark.createDataFrame(
            [(c, 100) for c in codes], "code int, n bigint"))

    with pytest.raises(C.InputError, match="beyond"):
        profile_of(70, 100, 127)
    assert any("above" in w for w in profile_of(35, 60, 77).warnings)


def test_a_filter_in_parts_keeps_order_mates_and_files(spark, simulated, tmp_path):
    """The route without a shipped filter writes what it should, in order."""
    files = []
    for mate in (0, 1):
        path = tmp_path / f"x_{mate + 1}.fastq"
        path.write_text(text_of(
            [(f"r{i // 2}/{mate + 1}", s, "+", q) for i, s, q, _ in simulated[mate:80:2]]) + "\n")
        files.append(str(path))
    texts = {}
    for name, extra in {"one": {}, "parts": {"part_bytes": 4096}, "exact": {"membership": "exact"}}.items():
        config = C.RunConfig(k=21, prefix=f"{tmp_path}/{name}", threshold=2, **extra)
        report = correct_group(spark, files, config, range_bytes=3000)
        texts[name] = [folder_text(o) for o in report.outputs]
        assert os.path.exists(f"{tmp_path}/{name}.bf.size") == (name != "exact")
    assert texts["parts"] == texts["one"] == texts["exact"]
    for number, text in enumerate(texts["parts"], 1):
        assert text.splitlines()[::4] == [f"@r{i}/{number}" for i in range(40)]
    config = C.RunConfig(k=21, prefix=f"{tmp_path}/again")
    loaded = correct_group(spark, files, config, load=f"{tmp_path}/parts", range_bytes=3000)
    assert [folder_text(o) for o in loaded.outputs] == texts["parts"]


def test_gzip_input_is_spread_and_written_in_order(spark, simulated, tmp_path):
    text = text_of([(f"r{i}", s, "+", q) for i, s, q, _ in simulated[:300]]) + "\n"
    (tmp_path / "x.fastq").write_text(text)
    (tmp_path / "x.fastq.gz").write_bytes(gzip.compress(text.encode()))
    out = []
    for name in ("x.fastq", "x.fastq.gz"):
        config = C.RunConfig(k=21, prefix=f"{tmp_path}/o{len(out)}", threshold=2, paired=False)
        report = correct_group(spark, [f"{tmp_path}/{name}"], config)
        assert report.n_reads == 300
        out.append(folder_text(report.outputs[0]))
    assert out[0] == out[1] and out[0].splitlines()[::4] == [f"@r{i}" for i in range(300)]
    scan = spread(read_fastq(spark, f"{tmp_path}/x.fastq.gz"), [f"{tmp_path}/x.fastq.gz"])
    assert scan.select(F.spark_partition_id()).distinct().count() > 4


def test_paths_with_and_without_a_scheme(spark, simulated, tmp_path):
    (tmp_path / "x.fastq").write_text(text_of([(f"r{i}", s, "+", q) for i, s, q, _ in simulated[:40]]) + "\n")
    out = []
    for path, prefix in ((f"file://{tmp_path}/x.fastq", f"file://{tmp_path}/a"), (f"file:{tmp_path}/x.fastq", f"{tmp_path}/b"),
                         (f"{tmp_path}/x.fastq", f"file:{tmp_path}/c")):
        config = C.RunConfig(k=21, prefix=prefix, threshold=2, paired=False)
        correct_group(spark, [path], config)
    for name in "abc":
        out.append(folder_text(f"{tmp_path}/{name}.corrected.fastq"))
        assert (tmp_path / f"{name}.histo.qs").exists() and (tmp_path / f"{name}.bf.data").exists()
    assert out[0] == out[1] == out[2]


def test_tally_counts_characters_and_reads(spark):
    df = spark.createDataFrame([(1, "IIJ"), (2, "J"), (2, None), (1, ""), (2, "!é")], "mate int, qual string")
    assert sorted(map(tuple, quality.tally(df).collect())) == [
        (1, -1, 2), (1, 73, 2), (1, 74, 1), (2, -1, 3), (2, 33, 1), (2, 74, 1), (2, 169, 1), (2, 195, 1)]
    assert quality.quality_histogram(df.limit(0)).count() == 0


def test_read_lists(tmp_path):
    path = tmp_path / "l"
    path.write_text("d/x_1.fastq\nd/x_2.fastq\n")
    assert read_list(str(path)) == [["d/x_1.fastq", "d/x_2.fastq"]]
    assert read_list(str(path), paired=False) == [["d/x_1.fastq"], ["d/x_2.fastq"]]
    assert group_prefix("out", ["d/x_1.fastq", "d/x_2.fastq.gz"]) == "out.x_1.x_2"
    path.write_text("one\n")
    with pytest.raises(C.ConfigError):
        read_list(str(path))


def folder_text(path):
    return "".join(open(os.path.join(path, p)).read()
                   for p in sorted(os.listdir(path)) if p.startswith("part-"))


def test_paired_run_then_loaded_filter(spark, simulated, tmp_path, capsys):
    files = []
    for mate in (0, 1):
        path = tmp_path / f"x_{mate + 1}.fastq"
        path.write_text(text_of(
            [(f"r{i // 2}/{mate + 1}", s, "+", q) for i, s, q, _ in simulated[mate::2]]) + "\n")
        files.append(str(path))
    (tmp_path / "list").write_text("\n".join(files) + "\n")
    common = ["-readlist", str(tmp_path / "list"), "-kmerlength", "21"]
    assert cli.main([*common, "-prefix", f"{tmp_path}/o", "-count", "5"], spark) == 0
    assert "k-mer occurrence threshold: 5" in capsys.readouterr().out
    prefix = f"{tmp_path}/o.x_1.x_2"
    first = folder_text(f"{prefix}.1.corrected.fastq")
    names = first.splitlines()[::4]
    assert names == [f"@r{i}/1" for i in range(len(names))] and len(names) == 450
    histogram = open(f"{prefix}.histo.k-mer").read().splitlines()
    assert histogram[0].startswith("      5: ") and histogram[-1].startswith("<=  255: ")
    assert len(open(f"{prefix}.histo.qs").read().splitlines()) == 42
    assert cli.main([*common, "-prefix", f"{tmp_path}/l", "-load", prefix], spark) == 0
    assert folder_text(f"{tmp_path}/l.x_1.x_2.1.corrected.fastq") == first
    # one file by itself, without trimming
    assert cli.main(["-read", files[0], "-kmerlength", "21", "-prefix", f"{tmp_path}/s",
                     "-load", prefix, "-notrim", "-single-end"], spark) == 0
    alone = folder_text(f"{tmp_path}/s.x_1.corrected.fastq").splitlines()
    assert [len(s) for s in alone[1::4]] == [len(s) for _, s, _, _ in simulated[::2]]


def test_command_line_refuses(spark, tmp_path):
    base = ["-read", "x", "-prefix", "p"]
    assert cli.main([*base, "-kmerlength", "9"], spark) == 1
    assert cli.main([*base, "-kmerlength", "21", "-count", "1"], spark) == 1
    assert cli.main([*base, "-kmerlength", "21", "-fpr", "0"], spark) == 1
    assert cli.main([*base, "-kmerlength", "21", "-extend", "0"], spark) == 1
    assert cli.main([*base, "-kmerlength", "21", "-max_mem", "2"], spark) == 1
    assert cli.main([*base, "-kmerlength", "21", "-read1", "y"], spark) == 1


def test_phred_rules(spark):
    def offset(lo, hi, rule="paired"):
        hist = spark.createDataFrame([(lo, 1), (hi, 1)], "code int, n bigint")
        row = quality.with_offset(hist, rule).first()
        return row["offset"], row["note"]

    assert offset(35, 78) == (33, "ok")
    assert offset(35, 79) == (None, "error")
    assert offset(35, 75, "single") == (None, "error")
    assert offset(35, 76, "single76") == (33, "ok")
    assert offset(32, 60) == (None, "error")
    assert offset(60, 75) == (33, "hard to tell")
    assert offset(60, 76) == (64, "ok")
    assert offset(75, 104) == (64, "ok")
    assert offset(76, 104) == (64, "ok")
    with pytest.raises(C.InputError):
        quality.profile(spark.createDataFrame([(20, 1)], "code int, n bigint"))


def test_thresholds(spark):
    def threshold(*pairs):
        hist = spark.createDataFrame(list(pairs), "occ int, n_kmers bigint")
        return spectrum.kmer_threshold(hist).first()["threshold"]

    assert threshold((2, 90), (3, 10), (4, 20)) == 3
    assert threshold((2, 1), (3, 5)) == 2
    assert threshold((2, 9), (3, 5)) is None        # 4 onward are empty
    assert threshold((2, 9), (254, 1), (255, 5)) == 253
    assert threshold((2, 9), (255, 5)) is None      # the last bucket takes no part
    with pytest.raises(C.InputError):
        spectrum.find_threshold(spark.createDataFrame([(2, 9)], "occ int, n_kmers bigint"))


def test_mates_must_match(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "mate int")
    with pytest.raises(C.InputError):
        quality.check_mates(df)


def test_trims_within_the_budget(spark):
    df = spark.createDataFrame(
        [(1, 10, 10, 30), (2, 25, 10, 30), (3, 25, 40, 30), (4, 40, 40, 30)],
        "id int, trim5 int, trim3 int, max_trim int")
    got = {r["id"]: (r["trim5"], r["trim3"]) for r in correct.reconciled_trims(df).collect()}
    assert got == {1: (10, 10), 2: (0, 10), 3: (25, 0), 4: (0, 30)}
    off = correct.reconciled_trims(df, trim=False)
    assert off.where((F.col("trim5") > 0) | (F.col("trim3") > 0)).count() == 0


def test_stream_gives_what_a_batch_gives(spark, simulated, tmp_path):
    from test_correct import as_dict, prepared

    from readmend.operators import bloom
    from readmend.operators.joined import JoinedSearcher
    from readmend.operators.repair import ShippedSearcher
    from readmend.streaming.correct_stream import start_correction

    reads, profile, solid, texts = prepared(spark, simulated, 21, 5)
    reads.write.parquet(f"{tmp_path}/in")
    searcher = ShippedSearcher(bloom.ship_kmers(solid, 21, len(texts)))
    stream = spark.readStream.schema(reads.schema).parquet(f"{tmp_path}/in")
    with pytest.raises(C.ConfigError):
        start_correction(stream, JoinedSearcher.over(solid, 21), 21, profile, "unused", "unused")
    query = start_correction(stream, searcher, 21, profile, f"{tmp_path}/out",
                             f"{tmp_path}/state", availableNow=True)
    query.awaitTermination(120)
    assert query.exception() is None
    assert as_dict(spark.read.parquet(f"{tmp_path}/out")) == as_dict(
        correct.corrected(reads, searcher, 21, profile))
