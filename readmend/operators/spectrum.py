"""k-mer spectrum: counts, histogram, valley threshold, solid k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readmend import config as C
from readmend.functions.kmers import kmer_text, window_kmers
from readmend.operators.runs import count_by_runs, windows_by_runs
from readmend.sources.scratch import written


def kmer_counts(reads: DataFrame, k: int, min_count: int = C.MIN_COUNT) -> DataFrame:
    """(kmer, n) of canonical k-mers seen at least `min_count` times.

    Counted by minimizer runs at every k; k-mers above 31 bases are strings in the result.
    """
    return count_by_runs(reads, k, min_count)


def window_counts(reads: DataFrame, k: int, by: str) -> DataFrame:
    """(`by`, kmer, n, min_pos, max_pos) of the k-mers as read, uppercase text; `by` is an int column.

    Windows of bases alone move as runs (k up to 31), and so do those with N (k up to 21); those with other characters,
    which no such k-mer equals, as text.
    """
    reads = reads.select(by, F.upper("seq").alias("seq"))
    figures = (F.count(F.lit(1)).alias("n"), F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"))
    if k > C.PACKED_MAX_K:
        return window_kmers(reads, k, keep=[by]).groupBy(by, "kmer").agg(*figures)
    tag = F.col(by).cast(reads.schema[by].dataType).alias(by)
    # one character each, so places stay
    spelled = reads.withColumn("seq", F.regexp_replace("seq", "[^ACGT]", "N"))
    found = windows_by_runs(spelled, k, by).select(
        tag, kmer_text(F.col("kmer"), k).alias("kmer"), "n", "min_pos", "max_pos")
    odd = "[^ACGT]"
    if 3 * k <= 64:  # an N takes a third bit a base
        odd = "[^ACGTN]"
        with_n = reads.where(F.col("seq").contains("N")).withColumn("seq", F.regexp_replace("seq", odd, "x"))
        found = found.unionAll(windows_by_runs(with_n, k, by, with_n=True).select(tag, "kmer", "n", "min_pos", "max_pos"))
    others = window_kmers(reads.where(F.col("seq").rlike(odd)), k, keep=[by]).where(
        F.col("kmer").rlike(odd)).groupBy(by, "kmer").agg(*figures)
    return found.unionAll(others)


def kmer_histogram(counts: DataFrame) -> DataFrame:
    """(occ, n_kmers); the last bucket, 255, holds all larger counts."""
    return counts.groupBy(
        F.least(F.col("n"), F.lit(C.HISTOGRAM_TOP)).cast("int").alias("occ")
    ).agg(F.count(F.lit(1)).alias("n_kmers"))


def dense_histogram(hist: DataFrame, low: int = C.MIN_COUNT) -> DataFrame:
    """Every bucket from `low` to 255, absent ones 0."""
    buckets = hist.sparkSession.range(low, C.HISTOGRAM_TOP + 1).select(
        F.col("id").cast("int").alias("occ"))
    return buckets.join(hist, "occ", "left").select(
        "occ", F.coalesce("n_kmers", F.lit(0)).cast("bigint").alias("n_kmers"))


def kmer_threshold(hist: DataFrame) -> DataFrame:
    """One row, `threshold`: the bucket before the first rise from 3 up to 254
    (null without a rise). A rise at 2 does not count."""
    previous = F.lag("n_kmers").over(Window.orderBy("occ"))  # 254 rows
    rises = dense_histogram(hist).withColumn("prev", previous).where(
        (F.col("n_kmers") > F.col("prev")) & (F.col("occ") < C.HISTOGRAM_TOP))
    return rises.agg((F.min("occ") - 1).cast("int").alias("threshold"))


def unique_solid(hist: DataFrame, threshold: int) -> DataFrame:
    return hist.where(F.col("occ") >= min(threshold, C.HISTOGRAM_TOP)).agg(
        F.coalesce(F.sum("n_kmers"), F.lit(0)).cast("bigint").alias("n_solid"))


def find_threshold(hist: DataFrame) -> int:
    return min(_valley(kmer_threshold(hist).first()["threshold"]), C.MAX_THRESHOLD)


def _valley(threshold: int | None) -> int:
    if threshold is None:
        raise C.InputError(
            "the k-mer histogram has no valley; give a count threshold or another k")
    return threshold


def solid_counts(counts: DataFrame) -> tuple[DataFrame, int, int]:
    """(kmer, n) of the solid k-mers as a table, the threshold and their number, `counts` being run once: its
    histogram and the solid k-mers read one exchange, and the others are never stored."""
    least = kmer_threshold(kmer_histogram(counts)).select(
        F.least(F.col("threshold"), F.lit(C.MAX_THRESHOLD)).alias("threshold"))
    table = written(counts.withColumn("threshold", least.scalar()).where(F.col("n") >= F.col("threshold")))
    found = table.agg(F.min("threshold").alias("threshold"), F.count(F.lit(1)).alias("n_solid")).first()
    # a threshold lies below a rise, so some k-mers reach it
    return table.drop("threshold"), _valley(found["threshold"]), found["n_solid"]


def solid_kmers(counts: DataFrame, threshold: int) -> DataFrame:
    return counts.where(F.col("n") >= threshold).select("kmer")
