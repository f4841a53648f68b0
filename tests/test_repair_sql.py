"""The repair in SQL, the plain repair and the Spark plan are written apart from each other."""

from collections import Counter

import duckdb
import pandas as pd
import pytest
from conftest import complement, simulate
from plain_corrector import correct_all
from pyspark.sql import functions as F

from readmend.functions.kmers import kmer_text
from readmend.operators import bloom, correct, quality, spectrum
from readmend.operators.repair import ShippedSearcher
from readmend.plans.catalog import K
from readmend.plans.oracles import correction_of

SELECT = "select read_id, seq, qual, n_edits, trim5, trim3, rejected from cor"


def in_sql(rows, solid):
    con = duckdb.connect()
    con.register("given", pd.DataFrame([r[:3] for r in rows], columns=["read_id", "seq", "qual"]))
    con.register("kmers", pd.DataFrame({"kmer": sorted(solid)}))
    reads = "select read_id::bigint read_id, read_id::bigint pair_id, 1 mate, seq, qual from given"
    sql = correction_of(reads, "select kmer from kmers", "select * from prof")
    profile = tuple(map(int, con.execute(sql).fetchone()))
    done = con.execute(correction_of(reads, "select kmer from kmers", SELECT)).fetchall()
    return profile, {r[0]: r[1:] for r in done}


def solid_of(rows, least):
    found = Counter()
    for _, seq, *_ in rows:
        for i in range(len(seq) - K + 1):
            word = seq[i:i + K].upper()
            if set(word) <= set("ACGT"):
                found[min(word, complement(word))] += 1
    return {w for w, n in found.items() if n >= least}


@pytest.mark.parametrize("seed, rate, least", [(7, 0.01, 5), (11, 0.03, 4), (12, 0.06, 3), (13, 0.015, 2)])
def test_sql_corrects_as_the_plain_version(seed, rate, least):
    rows = simulate(seed=seed, genome=2500, n=700, rate=rate)
    solid = solid_of(rows, least)
    profile, got = in_sql(rows, solid)
    want = correct_all([r[:3] for r in rows], solid, K, *profile)
    different = {i: (got[i], want[i]) for i in want if got[i] != want[i]}
    assert not different, (len(different), list(different.items())[:2])
    assert sum(v[2] > 0 for v in got.values()) > 100


def test_sql_corrects_as_spark_does(spark, simulated):
    reads = spark.createDataFrame([r[:3] for r in simulated], "read_id bigint, seq string, qual string")
    solid = spectrum.solid_kmers(spectrum.kmer_counts(reads, K), 5)
    texts = {r[0] for r in solid.select(kmer_text(F.col("kmer"), K)).collect()}
    profile = quality.profile(quality.quality_histogram(reads))
    done = correct.corrected(reads, ShippedSearcher(bloom.ship_kmers(solid, K, len(texts))), K, profile)
    found, want = in_sql(simulated, texts)
    assert found == (profile.offset, profile.cutoff, profile.extremely_low)
    assert {r["read_id"]: tuple(r[c] for c in (
        "seq", "qual", "n_edits", "trim5", "trim3", "rejected")) for r in done.collect()} == want
