"""Headline timings: prints one JSON line.

Reads are derived from the texts of $BENCH_SF_DIR once (not timed) and written
as FASTQ and parquet to the session's scratch folder, as a run would find them. One
untimed count of the FASTQ checks them and starts the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("readmend-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.files.maxPartitionBytes", str(8 << 20))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from readmend.operators import bloom, correct, quality, spectrum
    from readmend.operators.repair import ShippedSearcher
    from readmend.sources.documents import reads_from_documents
    from readmend.sources.fastq import read_fastq, write_fastq
    from readmend.sources.scratch import scratch_dir

    k = 21
    folder = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    made = reads_from_documents(spark, sf_dir).select(
        F.col("read_id").alias("read_idx"), F.col("read_id").cast("string").alias("name"),
        "seq", F.lit("+").alias("plus"), "qual")
    made.write.parquet(f"{folder}/reads")
    write_fastq(spark.read.parquet(f"{folder}/reads"), f"{folder}/fastq")
    parts = sorted(f"{folder}/fastq/{p}" for p in os.listdir(f"{folder}/fastq")
                   if p.startswith("part-") and os.path.getsize(f"{folder}/fastq/{p}"))
    reads = spark.read.parquet(f"{folder}/reads")
    n_reads = reads.count()
    if read_fastq(spark, parts, 8 << 20).count() != n_reads:
        raise SystemExit("the FASTQ files do not hold all reads")
    seconds: dict[str, float] = {}

    def timed(name, action):
        began = time.perf_counter()
        out = action()
        seconds[name] = round(time.perf_counter() - began, 3)
        return out

    def drained(df):
        df.write.format("noop").mode("overwrite").save()

    timed("fastq_scan", lambda: drained(read_fastq(spark, parts, 8 << 20)))
    timed("quality_histogram", lambda: quality.quality_histogram(reads).collect())
    profile = quality.profile(quality.quality_histogram(reads))
    counts = spectrum.kmer_counts(reads, k)
    timed("kmer_counts", lambda: counts.write.parquet(f"{folder}/counts"))
    counts = spark.read.parquet(f"{folder}/counts")
    hist = spectrum.kmer_histogram(counts)
    threshold = timed("kmer_threshold", lambda: spectrum.find_threshold(hist))
    n_solid = spectrum.unique_solid(hist, threshold).first()["n_solid"]
    solid = spectrum.solid_kmers(counts, threshold)
    model = timed("filter_build", lambda: bloom.build_filter(
        solid, k, n_solid, threshold, f"{folder}/model"))
    searcher = ShippedSearcher(model.ship(spark))
    flags = correct.with_solid_flags(correct.normalized(reads, k), searcher)
    timed("solid_flags", lambda: drained(flags))
    done = correct.corrected(reads, searcher, k, profile)
    timed("correct_and_write", lambda: write_fastq(
        done.select("read_idx", "name", "seq", "plus", "qual"), f"{folder}/corrected"))
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "profile, count, filter and correct all reads", "value": total, "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "n_reads": n_reads, "reads_per_sec": round(n_reads / total), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
