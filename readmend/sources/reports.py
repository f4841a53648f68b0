"""Text reports and FASTQ text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmend import config as C
from readmend.operators.spectrum import dense_histogram
from readmend.sources import files


def quality_lines(hist: DataFrame, offset: int) -> DataFrame:
    """(row, line) for scores 0..41: '%4d: %14d'."""
    scores = hist.sparkSession.range(C.MAX_PHRED + 1).select(F.col("id").cast("int").alias("row"))
    counts = hist.select((F.col("code") - offset).alias("row"), "n")
    return scores.join(counts, "row", "left").select(
        "row", F.format_string("%4d: %14d", "row", F.coalesce("n", F.lit(0))).alias("line"))


def kmer_lines(hist: DataFrame, low: int = C.MIN_COUNT) -> DataFrame:
    """(row, line) for buckets `low`..255: '%7d: %10d', the last '<=%5d: %10d'."""
    last = F.col("occ") == C.HISTOGRAM_TOP
    return dense_histogram(hist, low).select(
        F.col("occ").alias("row"),
        F.when(last, F.format_string("<=%5d: %10d", "occ", "n_kmers"))
        .otherwise(F.format_string("%7d: %10d", "occ", "n_kmers")).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """A report of at most 256 rows to one text file."""
    rows = lines.orderBy("row").collect()
    files.write_text(path, "".join(r["line"] + "\n" for r in rows))


def fastq_record() -> Column:
    return F.concat_ws("\n", "name", "seq", "plus", "qual")
