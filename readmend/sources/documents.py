"""Read pairs derived from a table of texts.

Letters become bases, windows of a text become reads, near copies of texts act
as sequencing errors. The whole of each text is used: pair j has the windows
at letters 100 j and 100 j + 50, each up to 100 letters long, so the last ones
are shorter; a missing second window repeats the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LETTER_BASES = "ACGTACGTACGTACGTACGTACgTAN"
LETTER_QUALITIES = "J4JJJ@=JJ+.JDJJ7&JJJF1C(:#"
READ_LETTERS = 100
STRIDE = 50
PAIRS_PER_TEXT = 100000000        # pair_id = doc_id * this + j; no text of 2 GiB has more
# -----------------------------------------------------------------------------
_OTHER_STRAND = LETTER_BASES.upper().translate(str.maketrans("ACGT", "TGCA"))


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts; a table of fewer splits than cores is spread out first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores).sortWithinPartitions("doc_id", "text")
    return docs


def read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, seq1, qual1, seq2, qual2; no shuffle but the spreading."""
    letters = load_documents(spark, sf_dir).select(
        "doc_id", F.regexp_replace(F.lower("text"), "[^a-z]+", "").alias("t"))
    # the whole text is translated once, and bytes are cut without walking the text
    spelled = letters.select(
        "doc_id", F.length("t").alias("n"),
        F.translate("t", LETTERS, LETTER_BASES).cast("binary").alias("bases"),
        F.translate("t", LETTERS, _OTHER_STRAND).cast("binary").alias("other"),
        F.translate("t", LETTERS, LETTER_QUALITIES).cast("binary").alias("quals"))
    # no filter on t: pushed below, it would find the letters twice
    windows = (
        spelled.withColumn("j", F.explode(F.expr(
            f"if(n > 0, sequence(0L, (n - 1) div {READ_LETTERS}), array())")))
        .withColumn("at", F.col("j") * READ_LETTERS + 1)
        .withColumn("at2", F.when(F.col("at") + STRIDE <= F.col("n"), F.col("at") + STRIDE)
                    .otherwise(F.col("at"))))

    def window(text, at):
        return F.expr(f"cast(substring({text}, {at}, {READ_LETTERS}) as string)")

    return windows.select(
        (F.col("doc_id") * PAIRS_PER_TEXT + F.col("j")).cast("bigint").alias("pair_id"),
        window("bases", "at").alias("seq1"),
        F.reverse(window("quals", "at")).alias("qual1"),
        F.reverse(window("other", "at2")).alias("seq2"),
        window("quals", "at2").alias("qual2"),
    )


def mates_to_reads(pairs: DataFrame) -> DataFrame:
    """Pairs to one row per read: read_id, pair_id, mate, seq, qual."""
    both = pairs.withColumn("mate", F.explode(F.array(F.lit(1), F.lit(2))))

    def of_mate(name):  # a column nobody reads is not made
        return F.when(F.col("mate") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}2")).alias(name)

    return both.select(
        (F.col("pair_id") * 2 + F.col("mate") - 1).alias("read_id"), "pair_id",
        "mate", of_mate("seq"), of_mate("qual"))


def reads_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mates_to_reads(read_pairs(spark, sf_dir))
