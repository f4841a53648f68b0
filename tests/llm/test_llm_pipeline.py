import math

from helpers_llm import SF, near_duplicates, rows_of, words
from pyspark.sql import functions as F

import corpus_pipeline
from readmend.llm import balance, minhash, packing, rule_quality, toxicity
from readmend.llm.common import table


def test_each_stage_does_its_work(spark, tmp_path):
    raw = table(spark, SF, "documents")
    odd = raw.limit(4).withColumns({"doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string")})
    docs = raw.unionByName(odd).unionByName(raw.limit(3)).withColumn("score", F.lit(1))
    labels, columns = table(spark, SF, "labels"), docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert out.columns == columns
        if name == "quality":
            good = rule_quality.quality(F.col("text"), rule_quality.learn(docs, labels)) >= 0.5
            assert rows_of(out) == rows_of(docs.where(good))
            assert 0 < out.count() < docs.count()
        if name == "toxicity":
            model = toxicity.learn(docs, labels)
            assert rows_of(out) == sorted((tuple(r) for r in docs.collect() if model.score(r.text) < 0.7), key=str)
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            groups = {c for _, _, c in near_duplicates(rows) if c is not None}
            kept = [r.doc_id for r in out.collect()]
            assert sorted(i for i in kept if i is not None) == sorted(groups)
            assert kept.count(None) == sum(i is None for i, _ in rows)
        if name == "mixing":
            report = balance.mix_report(docs).collect()
            assert out.count() == sum(r.copies for r in report)
            assert sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in report)
        if name == "packing":
            sequences = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
            assert all(r.n <= 1024 for r in sequences)
            assert len(sequences) <= 1.05 * math.ceil(sum(r.n for r in sequences) / 1024) + 1
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_drops_what_was_left_behind(spark, monkeypatch):
    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = table(spark, SF, "documents")
    for operator, name in ((rule_quality, "good_documents"), (toxicity, "without_toxic"), (minhash, "deduplicated"),
                           (balance, "mixed_documents"), (packing, "pack_documents")):
        monkeypatch.setattr(operator, name, lambda docs, *args: docs)
    for _, stage in corpus_pipeline.STAGES:
        before = collections()
        stage(spark, docs, SF)
        assert collections() > before
