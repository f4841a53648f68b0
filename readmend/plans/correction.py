"""Whole runs: profile, count, build or load the filter, correct, write."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmend import config as C
from readmend.functions.kmers import kmer_text
from readmend.operators import bloom, correct, quality, spectrum
from readmend.operators.joined import JoinedSearcher
from readmend.operators.repair import Searcher, ShippedSearcher
from readmend.sources import files, reports
from readmend.sources.fastq import DEFAULT_RANGE, read_by_one_task, read_fastq, write_fastq
from readmend.sources.package import send_package
from readmend.sources.readlist import group_prefix
from readmend.sources.scratch import checkpointed, written


@dataclass
class RunReport:
    """What a run found and did."""

    profile: C.QualityProfile
    n_reads: int
    threshold: int
    n_solid: int
    filter_bits: int | None = None
    num_hash: int | None = None
    stats: dict = field(default_factory=dict)
    outputs: list[str] = field(default_factory=list)

    def lines(self) -> list[str]:
        out = [
            f"reads or pairs: {self.n_reads}",
            f"quality offset: {self.profile.offset}",
            f"quality threshold: {self.profile.cutoff}",
            f"low quality threshold: {self.profile.extremely_low}",
            f"k-mer occurrence threshold: {self.threshold}",
            f"unique solid k-mers: {self.n_solid}",
        ]
        if self.filter_bits:
            out += [f"filter: {self.filter_bits} bits, {self.num_hash} hash functions"]
        else:
            out += ["filter: none, exact membership"]
        out += [f"warning: {w}" for w in self.profile.warnings]
        return out + [f"{k}: {v}" for k, v in self.stats.items()]


def profile_reads(reads: DataFrame, config: C.RunConfig
                  ) -> tuple[C.QualityProfile, DataFrame, dict[int, int]]:
    """The score cutoffs, the histogram, and the number of reads of each mate; one pass."""
    tallied = checkpointed(quality.tally(reads))
    counts = {r["mate"]: r["n"] for r in tallied.where("code = -1").collect()}
    hist = quality.histogram_of(tallied)
    return quality.profile(hist, config.rule), hist, counts


def spread(reads: DataFrame, paths: list[str]) -> DataFrame:
    """A gzip file without blocks is read by one task; its reads are dealt over all tasks. They are put
    in order again when they are written."""
    if not any(read_by_one_task(p) for p in paths):
        return reads
    n = max(reads.sparkSession.sparkContext.defaultParallelism,
            int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return reads.repartition(n, "file_id", "read_idx").sortWithinPartitions("file_id", "read_idx")


def build_model(reads: DataFrame, config: C.RunConfig, prefix: str, write_report: bool = True
                ) -> tuple[Searcher, bloom.FilterModel | None, int, int]:
    """Count, choose the threshold, and make the solid k-mers searchable, by the
    filter or exactly. Their number decides how a test finds them, not its answer."""
    counts = written(spectrum.kmer_counts(reads, config.k, config.threshold or C.MIN_COUNT))
    hist = checkpointed(spectrum.kmer_histogram(counts))
    threshold = config.threshold or spectrum.find_threshold(hist)
    # the histogram saturates, so a threshold beyond it is counted on the table
    n_solid = (counts.where(F.col("n") >= threshold).count()
               if threshold > C.HISTOGRAM_TOP
               else spectrum.unique_solid(hist, threshold).first()["n_solid"])
    if write_report:
        low = min(config.threshold or C.MIN_COUNT, C.HISTOGRAM_TOP)
        reports.write_lines(reports.kmer_lines(hist, low), f"{prefix}.histo.k-mer")
    solid = spectrum.solid_kmers(counts, threshold)
    if config.membership == "exact":
        return exact_searcher(solid, config.k, n_solid, counts), None, threshold, n_solid
    model = bloom.build_filter(solid, config.k, n_solid, threshold, prefix, config.fpr,
                               config.seed, config.part_bytes)
    return filter_searcher(reads.sparkSession, model), model, threshold, n_solid


def filter_searcher(spark: SparkSession, model: bloom.FilterModel) -> Searcher:
    if model.parts > 1:
        return JoinedSearcher.over_filter(model)
    return ShippedSearcher(model.ship(spark))


def exact_searcher(solid: DataFrame, k: int, n_solid: int,
                   counts: DataFrame | None = None) -> Searcher:
    members = bloom.ship_kmers(solid, k, n_solid)
    return JoinedSearcher.over(solid, k, counts) if members is None else ShippedSearcher(members)


def correct_group(spark: SparkSession, group: list[str], config: C.RunConfig,
                  load: str | None = None, range_bytes: int = DEFAULT_RANGE) -> RunReport:
    """Correct one file or one pair of mates and write the results."""
    send_package(spark)
    if load is not None and config.threshold is not None:
        raise C.ConfigError("a count threshold cannot be given with a loaded filter")
    group = [files.qualified(spark, p) for p in group]
    prefix = files.qualified(spark, config.prefix)
    load = load and files.qualified(spark, load)
    scored = read_fastq(spark, group, range_bytes, ["file_id", "qual"])
    profile, hist, counts = profile_reads(scored.withColumn("mate", F.col("file_id") + 1), config)
    reports.write_lines(reports.quality_lines(hist, profile.offset), f"{prefix}.histo.qs")
    n_reads = quality.equal_mates(counts) if len(group) == 2 else counts.get(1, 0)
    if load is not None:
        model = bloom.FilterModel.load(load, config.k)
        searcher = filter_searcher(spark, model)
        threshold, n_solid = model.threshold, model.num_kmers
    else:
        bases = read_fastq(spark, group, range_bytes, ["file_id", "read_idx", "seq"])
        searcher, model, threshold, n_solid = build_model(spread(bases, group), config, prefix)
    report = RunReport(profile, n_reads, threshold, n_solid,
                       model and model.width_bits, model and model.num_hash)
    totals: dict[str, int] = {}
    for number, path in enumerate(group, 1):
        reads = spread(read_fastq(spark, path, range_bytes), [path])
        done = correct.corrected(reads, searcher, config.k, profile, config.max_extension,
                                 config.trim, config.compat)
        mark = f".{number}" if len(group) == 2 else ""
        out = f"{prefix}{mark}.corrected.fastq"
        stats = _write_with_stats(done, out, config.gzip,
                                  read_by_one_task(path) or isinstance(searcher, JoinedSearcher))
        totals = {k: totals.get(k, 0) + v for k, v in stats.items()}
        report.outputs.append(out)
    report.stats = totals
    return report


def _write_with_stats(done: DataFrame, path: str, gzip: bool, sort: bool) -> dict[str, int]:
    """Write and sum in one pass over the reads; `sort` where a shuffle has lost
    their order."""
    from pyspark.sql import Observation

    seen = Observation()
    accepted = ~F.col("rejected")
    trimmed = F.col("trim5") + F.col("trim3")

    def total(value):
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    observed = done.observe(
        seen,
        total(F.when(accepted, F.col("n_edits"))).alias("corrected_errors"),
        total(F.when(accepted & ((F.col("n_edits") > 0) | (trimmed > 0)), 1))
        .alias("corrected_reads"),
        total(trimmed).alias("trimmed_bases"))
    if sort:  # the range shuffle samples the reads first: sum what it reads
        observed = checkpointed(observed)
    write_fastq(observed, path, gzip, sort)
    return dict(seen.get)


def correct_read_list(spark: SparkSession, groups: list[list[str]], config: C.RunConfig,
                      load: str | None = None) -> list[RunReport]:
    """Every group of a read list, each with a prefix of its own."""
    prefixes = [group_prefix(config.prefix, g) for g in groups]
    twice = sorted({p for p in prefixes if prefixes.count(p) > 1})
    if twice:
        raise C.ConfigError(f"groups would write over each other's results: {', '.join(twice)}")
    return [correct_group(spark, g, replace(config, prefix=p), load)
            for g, p in zip(groups, prefixes)]


def solid_table(reads: DataFrame, config: C.RunConfig) -> DataFrame:
    """(kmer as bases, n): the solid k-mers with their counts."""
    counts = (written(spectrum.kmer_counts(reads, config.k, config.threshold)) if config.threshold
              else spectrum.solid_counts(spectrum.kmer_counts(reads, config.k))[0])
    return counts.select(
        kmer_text(F.col("kmer"), config.k).alias("kmer"), "n")
