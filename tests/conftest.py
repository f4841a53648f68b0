import os
import random
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("readmend-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def complement(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def simulate(seed=7, genome=3000, length=100, n=900, rate=0.01):
    """Reads of a random genome with substitutions, low quality at most of
    them; rows (read_id, seq, qual, truth)."""
    rng = random.Random(seed)
    text = "".join(rng.choice("ACGT") for _ in range(genome))
    text += text[:400]            # a repeat
    rows = []
    for i in range(n):
        at = rng.randrange(len(text) - length)
        size = length if rng.random() > 0.05 else rng.randrange(15, length)
        truth = text[at:at + size]
        if rng.random() < 0.5:
            truth = complement(truth)
        seq, qual = list(truth), [rng.choice("FGHIJ") for _ in truth]
        burst = rng.random() < 0.06
        spots = set(p for p in range(size) if rng.random() < rate)
        if burst:
            start = rng.randrange(max(size - 12, 1))
            spots |= set(range(start, min(start + 9, size), rng.choice((1, 2))))
        for p in spots:
            seq[p] = rng.choice([b for b in "ACGT" if b != seq[p]])
            qual[p] = rng.choice("#$%&+.5J")
        for p in range(size):
            if rng.random() < 0.01:
                qual[p] = "&"
            if rng.random() < 0.004:
                seq[p], qual[p] = "N", "#"
        if rng.random() < 0.1:
            seq = [b.lower() for b in seq]
        rows.append((i, "".join(seq), "".join(qual), truth))
    return rows


@pytest.fixture(scope="session")
def simulated():
    return simulate()
