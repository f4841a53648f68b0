"""The registered queries: every operator on reads derived from `documents`.

Each takes (spark, sf_dir) and returns a DataFrame; all run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmend import config as C
from readmend.functions import bases as B
from readmend.functions.kmers import kmer_text
from readmend.operators import bloom, correct, quality, regions, spectrum
from readmend.operators.repair import (
    common_edits, disputed_positions, touched_positions, trim_disputed, with_first_kmer_candidates)
from readmend.operators.runs import joined_by_runs
from readmend.plans.correction import exact_searcher, filter_searcher
from readmend.sources import documents, reports
from readmend.sources.scratch import scratch_dir, written

K = 21
FPR = 0.001


def reads(spark: SparkSession, sf: str) -> DataFrame:
    return documents.reads_from_documents(spark, sf)


def pairs(spark, sf):
    return documents.read_pairs(spark, sf)


# --- profile ---------------------------------------------------------------------

def mate_count_check(spark, sf):
    return quality.mate_counts(reads(spark, sf))


def quality_histogram(spark, sf):
    return quality.quality_histogram(reads(spark, sf))


def quality_range(spark, sf):
    return quality.quality_range(quality_histogram(spark, sf))


def phred_offset(spark, sf):
    return quality.with_offset(quality_histogram(spark, sf))


def phred_offset_single(spark, sf):
    return quality.with_offset(quality_histogram(spark, sf), "single")


def quality_total_bases(spark, sf):
    return quality.total_bases(quality_histogram(spark, sf))


def quality_cutoffs(spark, sf):
    return quality.quality_cutoffs(quality_histogram(spark, sf))


def histogram_report_qs(spark, sf):
    return reports.quality_lines(quality_histogram(spark, sf), 33)


def _profile(spark, sf):
    """The cutoffs; the histogram is stored, so that the reads are scanned once."""
    return quality.profile(written(quality_histogram(spark, sf)))


# --- reads -----------------------------------------------------------------------

def normalize_reads(spark, sf):
    return correct.normalized(reads(spark, sf), K).select("read_id", "seq", "n_count")


def read_gate(spark, sf):
    return correct.normalized(reads(spark, sf), K).select(
        "read_id", "len", F.col("gate").cast("int").alias("gate"))


def trim_limits(spark, sf):
    return correct.normalized(reads(spark, sf), K).select("read_id", "max_trim", "check_len")


# --- spectrum --------------------------------------------------------------------

def kmers(spark, sf):
    return spectrum.window_counts(reads(spark, sf), K, "mate")


def canonical_kmers(spark, sf):
    return counts(spark, sf, at_least=1).select(kmer_text(F.col("kmer"), K).alias("kmer"), "n")


def long_kmer_counts(spark, sf):
    """k = 33 takes two words a k-mer."""
    return spectrum.kmer_counts(reads(spark, sf), 33)


def counts(spark, sf, k=K, at_least=C.MIN_COUNT):
    return spectrum.kmer_counts(reads(spark, sf), k, at_least)


def kmer_counts(spark, sf):
    return counts(spark, sf).select(kmer_text(F.col("kmer"), K).alias("kmer"), "n")


def kmer_histogram(spark, sf):
    return spectrum.dense_histogram(spectrum.kmer_histogram(counts(spark, sf)))


def kmer_threshold(spark, sf):
    return spectrum.kmer_threshold(spectrum.kmer_histogram(counts(spark, sf)))


def histogram_report_kmer(spark, sf):
    return reports.kmer_lines(spectrum.kmer_histogram(counts(spark, sf)))


def _spectrum(spark, sf):
    """Counts of the solid k-mers (cut off from their lineage), threshold, number of solid k-mers."""
    return spectrum.solid_counts(counts(spark, sf))


def unique_solid(spark, sf):
    hist = written(spectrum.kmer_histogram(counts(spark, sf)))
    return spectrum.unique_solid(hist, spectrum.find_threshold(hist))


def solid(spark, sf) -> DataFrame:
    table, threshold, _ = _spectrum(spark, sf)
    return spectrum.solid_kmers(table, threshold)


def solid_kmers(spark, sf):
    return solid(spark, sf).select(kmer_text(F.col("kmer"), K).alias("kmer"))


def _joined_windows(spark, sf):
    """The k-mers of every read past the gate, joined to the solid ones; some rows a read."""
    gated = correct.normalized(reads(spark, sf), K).where("gate").select("read_id", "seq")
    return joined_by_runs(gated, solid(spark, sf), K, "read_id")


def solid_semi_join(spark, sf):
    found = _joined_windows(spark, sf).where("n_solid > 0").select("read_id", "n_solid")
    return found.repartition("read_id").groupBy("read_id").agg(F.sum("n_solid").alias("n_solid"))


def weak_anti_join(spark, sf):
    found = _joined_windows(spark, sf).where("n_weak > 0").select("read_id", "n_weak", "first_weak")
    return found.repartition("read_id").groupBy("read_id").agg(
        F.sum("n_weak").alias("n_weak"), F.min("first_weak").alias("first_weak"))


# --- membership ------------------------------------------------------------------

def _exact(spark, sf):
    table, threshold, n = _spectrum(spark, sf)
    return exact_searcher(spectrum.solid_kmers(table, threshold), K, n, table)


def _filter(spark, sf):
    import uuid

    table, threshold, n = _spectrum(spark, sf)
    kmers_in = spectrum.solid_kmers(table, threshold)
    prefix = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    return kmers_in, bloom.build_filter(kmers_in, K, n, threshold, prefix, FPR)


def bloom_params(spark, sf):
    n = unique_solid(spark, sf).first()["n_solid"]
    width, hashes = bloom.filter_size(n, FPR)
    return spark.createDataFrame(
        [(n, width, width // 8, hashes)],
        "num_kmers bigint, width_bits bigint, width_bytes bigint, num_hash int")


def bloom_membership_no_false_negative(spark, sf):
    kmers_in, model = _filter(spark, sf)
    text = kmers_in.select(kmer_text(F.col("kmer"), K).alias("kmer"))
    tested = bloom.filter_membership(text, model)
    return tested.agg(F.count(F.lit(1)).alias("n_solid"), F.coalesce(
        F.sum(F.when(~F.col("solid"), 1)), F.lit(0)).cast("bigint").alias("n_missing"))


def filter_bit_positions(spark, sf):
    """The bits of every solid k-mer, in order of the hash functions."""
    kmers_in, model = _filter(spark, sf)
    positions = bloom.bit_positions(F.col("kmer"), K, model.part_bits, model.seeds)
    return kmers_in.select(kmer_text(F.col("kmer"), K).alias("kmer"),
                           F.array_join(positions.cast("array<string>"), ",").alias("positions"))


def bloom_bit_count(spark, sf):
    kmers_in, model = _filter(spark, sf)
    bits = bloom.filter_bits(kmers_in, model)
    return bits.agg(F.count(F.lit(1)).alias("n_buckets"),
                    F.sum(F.bitmap_count("bits")).cast("bigint").alias("n_bits"))


def bloom_false_positives(spark, sf):
    """How many of the reads' other k-mers the filter takes for solid."""
    kmers_in, model = _filter(spark, sf)
    others = counts(spark, sf, at_least=1).select("kmer").join(kmers_in, "kmer", "left_anti")
    tested = bloom.filter_membership(
        others.select(kmer_text(F.col("kmer"), K).alias("kmer")), model)
    return tested.agg(F.count(F.lit(1)).alias("n_probed"),
                      F.sum(F.col("solid").cast("int")).cast("bigint").alias("n_false"))


# --- regions ---------------------------------------------------------------------

def _flagged(spark, sf):
    df = correct.normalized(reads(spark, sf), K)
    return correct.with_solid_flags(df, _exact(spark, sf)).where("gate")


def solid_flags(spark, sf):
    return _flagged(spark, sf).select("read_id", "flags")


def fully_solid_reads(spark, sf):
    return _flagged(spark, sf).where(~F.col("weak")).select("read_id", "len")


def _regions_of(df, column):
    r = F.explode(F.col(column)).alias("r")
    return df.select("read_id", r).select("read_id", "r.first", "r.last")


def solid_islands(spark, sf):
    return _regions_of(regions.with_runs(_flagged(spark, sf)), "runs")


def short_islands_dropped(spark, sf):
    df = regions.with_runs(_flagged(spark, sf))
    return _regions_of(df.withColumn("runs", F.expr(regions.drop_short("runs"))), "runs")


def near_islands_merged(spark, sf):
    df = regions.with_runs(_flagged(spark, sf))
    df = df.withColumn("runs", F.expr(regions.drop_short("runs")))
    return _regions_of(df.withColumn("runs", F.expr(regions.merge_near("runs"))), "runs")


def adjusted_regions(spark, sf):
    """After every adjustment; with the mode each read is repaired in."""
    profile = _profile(spark, sf)
    df = correct.with_read_regions(_flagged(spark, sf), K, profile)
    return df.where("weak").select(
        "read_id", F.col("by_region").cast("int").alias("by_region"),
        F.expr("array_join(transform(regions, x -> concat(x.first, '-', x.last)), ' ')")
        .alias("regions"))


# --- repair ----------------------------------------------------------------------

def single_substitution_candidates(spark, sf):
    """Changes of one base that make a weak first k-mer solid. Without spots the only
    combination is the k-mer itself, which decides where it is solid."""
    gated = correct.normalized(reads(spark, sf), K).where("gate").select(
        "read_id", F.expr(f"named_struct('kmer', substring(seq, 1, {K}), "
                          "'spots', cast(array() as array<int>))").alias("first_kmer"),
        F.lit(1).alias("_n_low"))
    found = with_first_kmer_candidates(gated, _exact(spark, sf), K)
    return found.select("read_id", F.explode("candidates").alias("edits")).select(
        "read_id", F.explode("edits").alias("e")).select("read_id", "e.pos", "e.base")


def path_set_ops(spark, sf):
    """Two edit lists per pair, its first read turned into the second one and
    into that one backwards: what they share and dispute."""
    p = pairs(spark, sf).select(
        "pair_id", F.split(F.upper("seq1"), "").alias("s"), F.split("seq2", "").alias("x"),
        F.split(F.reverse("seq2"), "").alias("y"))

    def edits(to):
        return (f"transform(filter(sequence(0, least(size(s), size({to})) - 1), i -> get(s, i) <> get({to}, i)), "
                f"i -> named_struct('pos', i, 'base', get({to}, i)))")

    lists = p.select("pair_id", F.expr(edits("x")).alias("a"), F.expr(edits("y")).alias("b"))
    sets = lists.select("pair_id", F.array("a", "b").alias("lists")).select(
        "pair_id", F.expr(common_edits("lists")).alias("common"),
        F.expr(touched_positions("lists")).alias("touched"))
    return sets.select(
        "pair_id", F.size("common").alias("n_common"), F.size("touched").alias("n_union"),
        F.expr(f"array_join({disputed_positions('touched', 'common')}, ',')").alias("disputed"))


def disputed_trims(spark, sf):
    """Trims over the disputed positions of `path_set_ops`."""
    lengths = pairs(spark, sf).select(
        "pair_id", F.length("seq1").alias("len"),
        B.max_trimmed_bases(F.length("seq1")).alias("max_trim"))
    df = path_set_ops(spark, sf).join(lengths, "pair_id").withColumn("positions", F.expr(
        "transform(filter(split(disputed, ','), x -> x <> ''), x -> cast(x as int))"))
    z = F.expr(trim_disputed("0", "0", "positions", "false")).alias("z")
    return df.select("pair_id", z).select("pair_id", "z.t5", "z.t3")


def trim_reconcile(spark, sf):
    """Trims to the outer solid islands, brought within the budget."""
    df = regions.with_runs(_flagged(spark, sf)).where(F.size("runs") > 0)
    df = df.withColumns({
        "trim5": F.expr("runs[0].first"),
        "trim3": F.expr(f"len - {K} - runs[size(runs) - 1].last")})
    return correct.reconciled_trims(df).select("read_id", "trim5", "trim3")


def _island_ends(spark, sf):
    """Reads whose first run stops before their end: k-1 bases, and the rest."""
    df = regions.with_runs(_flagged(spark, sf)).where(F.size("runs") > 0)
    df = df.withColumn("p", F.expr(f"runs[0].last + {K}")).where("p < len")
    return df.select("read_id", F.expr(
        f"array(named_struct('ctx', substring(seq, p - {K - 2}, {K - 1}), "
        "'own', substring(seq, p + 1, len - p), "
        "'forced', concat('1', repeat('0', len - p - 1))))").alias("search"))


def right_walks(spark, sf):
    """Every walk from the first run to the end of its read, k-mers all solid; one row
    with `given_up` where a read has too many."""
    found = _exact(spark, sf).test(
        _island_ends(spark, sf), {"walks": ("walks", "search")})
    each = found.select("read_id", F.explode("walks").alias("w"))
    given_up = F.col("w").isNull()
    walks = F.when(given_up, F.array(F.lit(None).cast("string"))).otherwise(F.col("w"))
    return each.select("read_id", F.explode(walks).alias("walk"),
                       given_up.cast("int").alias("given_up"))


def outside_extension(spark, sf):
    """Whether five solid k-mers can follow the end of a read."""
    df = correct.normalized(reads(spark, sf), K).where("gate").select(
        "read_id", F.expr(f"array(named_struct('ctx', right(seq, {K - 1}), 'steps', 5))")
        .alias("search"))
    return _exact(spark, sf).test(df, {"ok": ("exists", "search")}).select(
        "read_id", F.expr("cast(ok[0] as int)").alias("extends"))


# --- correction ------------------------------------------------------------------

def _corrected(spark, sf, searcher=None):
    profile = _profile(spark, sf)
    return correct.corrected(reads(spark, sf), searcher or _exact(spark, sf), K, profile)


def correct_reads(spark, sf):
    return _corrected(spark, sf).select(
        "read_id", "seq", "qual", "n_edits", "trim5", "trim3",
        F.col("rejected").cast("int").alias("rejected"))


def correct_reads_bloom(spark, sf):
    _, model = _filter(spark, sf)
    return _corrected(spark, sf, filter_searcher(spark, model)).select(
        "read_id", "seq", "qual", "n_edits", "trim5", "trim3")


def correction_stats(spark, sf):
    return correct.run_stats(_corrected(spark, sf))


def corrected_fastq(spark, sf):
    done = _corrected(spark, sf).withColumn("name", F.concat(
        F.lit("@r"), F.col("pair_id"), F.lit("/"), F.col("mate"))).withColumn("plus", F.lit("+"))
    return done.select("mate", "read_id", reports.fastq_record().alias("record"))


QUERIES = {f.__name__: f for f in (
    mate_count_check, quality_histogram, quality_range, phred_offset, phred_offset_single,
    quality_total_bases, quality_cutoffs, histogram_report_qs,
    normalize_reads, read_gate, trim_limits,
    kmers, canonical_kmers, long_kmer_counts, kmer_counts, kmer_histogram, kmer_threshold,
    histogram_report_kmer, unique_solid, solid_kmers, solid_semi_join, weak_anti_join,
    bloom_params, filter_bit_positions, bloom_membership_no_false_negative, bloom_bit_count, bloom_false_positives,
    solid_flags, fully_solid_reads, solid_islands, short_islands_dropped, near_islands_merged,
    adjusted_regions, single_substitution_candidates, path_set_ops, disputed_trims,
    trim_reconcile, right_walks, outside_extension,
    correct_reads, correct_reads_bloom, correction_stats, corrected_fastq,
)} | {"reads_from_documents": reads, "read_pairs": pairs}
