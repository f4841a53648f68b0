"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with their
columns; the last one returns the packed pieces. A stage's result is written as Parquet and
reread before the next one begins, and the driver drops what the one before left behind. Further columns of `docs` are kept as they are.

1. quality: documents scored under one half by the rule ensemble go.
2. toxicity: documents scored 0.7 or more go.
3. near_duplicates: one document of each group stays, the one with the least doc_id.
4. mixing: each document is repeated as often as its source's target asks for, or goes.
5. packing: sequences of at most 1024 tokens.

Both models learn from the labelled documents that reach their stage, never from the third
of them that is held out; with no labels they keep everything above their smoothed share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readmend.llm import balance, minhash, packing, rule_quality, toxicity
from readmend.llm.common import garbage_dropped, scratch_path, table
from readmend.llm.tokens import public_path
from readmend.sources.package import send_package

#: Learnt models and iterative components are not SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    garbage_dropped(spark)
    return rule_quality.good_documents(docs, table(spark, sf_dir, "labels"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    garbage_dropped(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    garbage_dropped(spark)
    return minhash.deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    garbage_dropped(spark)
    return balance.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    garbage_dropped(spark)
    return packing.pack_documents(docs, public_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("toxicity", without_toxic),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces with their sequences."""
    send_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        done = stage(spark, docs, sf_dir)
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
