"""Correction of reads: gate, test, repair, trim, apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmend import config as C
from readmend.functions import bases as B
from readmend.operators.regions import low_positions, with_regions
from readmend.operators.repair import Searcher, repaired


def normalized(reads: DataFrame, k: int) -> DataFrame:
    """Adds len, n_count, gate, max_trim, check_len; `seq` becomes uppercase
    with N as A."""
    length = F.length("seq")
    return reads.select(
        *[c for c in reads.columns if c != "seq"],
        B.substitute_n(F.col("seq")).alias("seq"),
        length.alias("len"),
        B.n_count(F.col("seq")).alias("n_count"),
        B.correctable(F.col("seq"), k).alias("gate"),
        B.max_trimmed_bases(length).alias("max_trim"),
        B.min_check_length(length).alias("check_len"),
    )


def with_solid_flags(df: DataFrame, searcher: Searcher) -> DataFrame:
    """`flags` of reads past the gate ('' for others) and `weak`: some k-mer is
    not solid, so there is something to repair."""
    df = df.withColumn("_gated", F.when(F.col("gate"), F.col("seq")))
    df = searcher.test(df, {"flags": ("flags", "_gated")}).drop("_gated")
    return df.withColumn("weak", F.col("flags").contains("0"))


def with_read_regions(df: DataFrame, k: int, quality: C.QualityProfile,
                      compat: str = "intended") -> DataFrame:
    """`qv`, `low`, `regions`, `by_region`; reads that are not weak get none of
    them computed."""
    df = df.withColumn("qv", F.when(
        F.col("weak"), B.quality_values(F.col("qual"), quality.offset)))
    df = df.withColumn("low", F.expr(low_positions("qv", quality.cutoff)))
    df = df.withColumn("flags", F.when(F.col("weak"), F.col("flags")).otherwise(F.lit("")))
    df = with_regions(df, k, compat)
    return df.withColumn("by_region", F.col("by_region") | ~F.col("weak"))


def reconciled_trims(df: DataFrame, trim: bool = True) -> DataFrame:
    """Bring trim5 + trim3 within the budget: give up the 5' side if the other
    fits, else the 3' side if that one fits, else trim the budget at the 3' end."""
    t5, t3, top = F.col("trim5"), F.col("trim3"), F.col("max_trim")
    if not trim:
        return df.withColumns({"trim5": F.lit(0), "trim3": F.lit(0)})
    fits = t5 + t3 <= top
    return df.withColumns({
        "trim5": F.when(fits, t5).when(t3 <= top, 0).when(t5 <= top, t5).otherwise(0),
        "trim3": F.when(fits | (t3 <= top), t3).when(t5 <= top, 0).otherwise(top),
    })


def applied(df: DataFrame) -> DataFrame:
    """Substitute the edits inside the kept part and cut bases and quality
    alike; reads with too many edits stay as they are."""
    df = df.withColumn("n_edits", F.size("edits")).withColumn(
        "rejected", F.col("n_edits") * 100 > F.col("len") * C.MAX_EDIT_SHARE_PCT)
    kept = "e.pos >= trim5 and e.pos < len - trim3"
    df = df.withColumn("_new", F.expr(
        f"aggregate(filter(edits, e -> {kept}), seq, "
        "(s, e) -> overlay(s placing e.base from e.pos + 1))"))
    cut = "substring({c}, trim5 + 1, len - trim5 - trim3)"
    return df.withColumn("out_seq", F.expr(
        f"if(rejected, seq, {cut.format(c='_new')})")).withColumn("out_qual", F.expr(
            f"if(rejected, qual, {cut.format(c='qual')})")).drop("_new")


def repair_columns(df: DataFrame, searcher: Searcher, k: int, quality: C.QualityProfile,
                   max_extension: int = 5, compat: str = "intended") -> DataFrame:
    """From `normalized` reads to edits, trim5, trim3 before reconciliation."""
    df = with_solid_flags(df, searcher)
    df = with_read_regions(df, k, quality, compat)
    df = repaired(df, searcher, k, quality.extremely_low, max_extension, compat)
    untouched = ~F.col("weak")
    return df.withColumns({
        "trim5": F.when(untouched, 0).otherwise(F.col("trim5")),
        "trim3": F.when(untouched, 0).otherwise(F.col("trim3")),
    })


def corrected(reads: DataFrame, searcher: Searcher, k: int, quality: C.QualityProfile,
              max_extension: int = 5, trim: bool = True, compat: str = "intended") -> DataFrame:
    """The reads' own columns with corrected `seq` and `qual`, and n_edits,
    trim5, trim3, rejected.

    With shipped k-mers this is one stage without a shuffle: scan, test,
    repair, write.
    """
    extra = [c for c in reads.columns if c not in ("seq", "qual")]
    df = repair_columns(normalized(reads, k), searcher, k, quality, max_extension, compat)
    df = applied(reconciled_trims(df, trim))
    return df.select(*extra, F.col("out_seq").alias("seq"), F.col("out_qual").alias("qual"),
                     "n_edits", "trim5", "trim3", "rejected")


def run_stats(done: DataFrame) -> DataFrame:
    """corrected_errors (of accepted reads), corrected_reads (edited, or only
    trimmed), trimmed_bases (rejected reads included), n_reads."""
    accepted = ~F.col("rejected")
    trimmed = F.col("trim5") + F.col("trim3")

    def total(value):
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return done.agg(
        total(F.when(accepted, F.col("n_edits"))).alias("corrected_errors"),
        total(F.when(accepted & ((F.col("n_edits") > 0) | (trimmed > 0)), 1))
        .alias("corrected_reads"),
        total(trimmed).alias("trimmed_bases"),
        F.count(F.lit(1)).alias("n_reads"),
    )
