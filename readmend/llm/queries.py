"""The registered queries of the operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from readmend.llm import (
    balance, decontaminate, fill_in_middle, line_cleaning, minhash, order_minhash, packing, resampling,
    rule_quality, token_files, toxicity, url_alias, warc)
from readmend.llm.common import table
from readmend.llm.tokens import public_path


def op1_rule_quality(spark, sf_dir):
    return rule_quality.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_cleaning(spark, sf_dir):
    cleaned = line_cleaning.clean_documents(table(spark, sf_dir, "documents"))
    return cleaned.drop("clean_text")


def op3_url_alias(spark, sf_dir):
    return url_alias.filter_pages(table(spark, sf_dir, "pages"))


def op4_order_minhash(spark, sf_dir):
    return order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op6_linear_grouping(spark, sf_dir):
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op7_entropy_balancing(spark, sf_dir):
    return balance.mix_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"),
        "source", "copies")


def op8_token_files(spark, sf_dir):
    manifest = token_files.write_token_files(
        table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
    return token_files.read_token_files(manifest)


def op9_toxicity(spark, sf_dir):
    return toxicity.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark, sf_dir):
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op12_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_wu_manber(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_rule_quality, op2_line_cleaning, op3_url_alias, op4_order_minhash, op5_warc,
    op6_linear_grouping, op7_entropy_balancing, op8_token_files, op9_toxicity, op10_minhash,
    op11_fill_in_middle, op12_resampling, op13_wu_manber)}
ORACLES = {
    "op2_line_cleaning": line_cleaning.oracle(),
    "op3_url_alias": url_alias.oracle(),
    "op5_warc": warc.oracle(),
    "op11_fill_in_middle": fill_in_middle.oracle(),
    "op12_resampling": resampling.oracle(),
    "op13_wu_manber": decontaminate.oracle(),
}
