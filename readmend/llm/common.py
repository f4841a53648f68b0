"""What the operators share: tables, scratch tables, the label split, ranks in slices."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readmend.sources.scratch import scratch_dir

#: ASCII white space; a word is a run of anything else.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of one Arrow batch: texts may be long, so fewer than Spark's own 10,000.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts the lineage, and
    what was computed survives a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the rows whose labels are never learnt from."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3
    return F.coalesce(remainder == 1, F.lit(False))


def clean_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) that may be learnt from, a row a doc_id. Labels that are null, held
    out, or disagree on one doc_id, are left out."""
    return (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
            .groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("high"))
            .where("low = high").select("doc_id", F.col("low").cast("int").alias("label")))


def sampling_rates(labels: DataFrame, label: str, most: dict[int, int]) -> dict[int, float]:
    """Which share of the clean labels of each value `learning_sample` takes."""
    found = {r["label"]: r["n"] for r in clean_labels(labels, label)
             .where(F.col("label").isin(list(most))).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {value: min(1.0, n / found[value]) if found.get(value) else 1.0 for value, n in most.items()}


def learning_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """(doc_id, text, label) of at most `most[value]` documents of each label value, chosen
    by a hash of the doc_id from the clean labels. Each value has its own rate then
    (`sampling_rates`), which a model of the share of a value has to undo. Only ids are
    sorted; the texts meet the chosen ids, a bounded number, by a broadcast."""
    clean = clean_labels(labels, label)
    chosen = None
    for value, n in most.items():
        part = clean.where(F.col("label") == value).orderBy(
            F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id")


def garbage_dropped(spark: SparkSession) -> None:
    """Let the driver collect its garbage: the heap shrinks, and Spark's cleaner drops shuffles and broadcasts
    of DataFrames that are gone."""
    gc.collect()  # what Python still holds
    spark.sparkContext._jvm.System.gc()
