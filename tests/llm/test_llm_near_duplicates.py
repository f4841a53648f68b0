import random

import numpy as np
import pytest
from helpers_llm import SF, least_reachable, near_duplicates, rows_of, texts

from readmend.llm import minhash
from readmend.llm.common import table
from readmend.llm.components import connected_components
from readmend.llm.text_hash import BLOCK, grams, word_hashes

COLUMNS = ("doc_id", "n_shingles", "component_id")


def near_group(n=60, seed=5):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(n):
        w = base[:]
        for _ in range(rng.choice([0, 2, 5, 8, 12])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((1000 + k, (" " if k % 3 else "\n\t").join(w)))
    return rows


def test_components_and_kept_equal_brute_force(spark):
    df = texts(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()] + near_group()
    df = df.unionByName(texts(spark, near_group()))
    got = minhash.near_duplicates(df)
    assert rows_of(got, *COLUMNS) == sorted(near_duplicates(rows), key=str)
    for r in got.collect():
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(
        {c for _, _, c in near_duplicates(rows) if c is not None})
    assert ids.count(None) == 2


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(minhash.near_duplicates(docs), *COLUMNS) == sorted(near_duplicates(rows), key=str)


def test_empty_table(spark):
    assert minhash.near_duplicates(texts(spark).limit(0)).count() == 0
    assert minhash.deduplicated(texts(spark).limit(0)).count() == 0


def test_blocks_find_what_pivots_leave(spark, monkeypatch):
    """Without pivots all links come from the blocks."""
    rows = near_group(40, 6)
    monkeypatch.setattr(minhash, "PIVOTS", 0)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
    monkeypatch.setattr(minhash, "SLICE_DOCS", 3)
    assert rows_of(minhash.near_duplicates(texts(spark, rows)), *COLUMNS) == sorted(
        near_duplicates(rows), key=str)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges += [(i, i + 1) for i in range(400, 460)] + [(900, i) for i in range(901, 960)] + [(5, 5)]
    df = spark.createDataFrame(edges + [(None, 3)], "u long, v long")
    find = least_reachable([e for e in edges if e[0] != e[1]])
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert rows_of(connected_components(df)) == sorted(((n, find(n)) for n in nodes), key=str)


def test_word_hashes_do_not_depend_on_blocks():
    text = ("Ab cd\n" + "e" * (BLOCK + 5) + " " + "fg hi " * (BLOCK // 3)).encode()
    parts = [word_hashes(w)[0] for w in text.split()[:4]]
    whole = word_hashes(text)
    assert len(whole) == len(text.split())
    assert list(whole[:4]) == parts
    assert word_hashes(b"AB") == word_hashes(b"ab") and word_hashes(b"AB", False) != word_hashes(b"ab", False)
    assert len(grams(whole[:3], 5)) == 1 and len(grams(whole[:7], 5)) == 3 and not len(grams(whole[:0], 5))


@pytest.mark.parametrize("share", [0.3, 0.6, 0.8, 0.95])
def test_signatures_estimate_similarity(share):
    rng = np.random.default_rng(1)
    common = int(2000 * share)
    x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    y = np.concatenate([x[:common], rng.integers(0, 1 << 63, 2000 - common, dtype=np.uint64)])
    true = common / (4000 - common)
    a, b = minhash.minima(x), minhash.minima(y)
    assert abs((a == b).mean() - true) < 0.12
    agree = 256 - int(np.bitwise_count(minhash.sketch(a).view(np.uint64) ^ minhash.sketch(b).view(np.uint64)).sum())
    assert abs(agree / 256 - (1 + true) / 2) < 0.12
