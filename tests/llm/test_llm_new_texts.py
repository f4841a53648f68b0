"""Fill-in-middle, resampling and benchmark decontamination."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from helpers_llm import ODD_TEXTS, SF, UPPER, rows_of, texts

from readmend.llm import decontaminate, fill_in_middle, resampling
from readmend.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MORE = ODD_TEXTS + [(20, "x <P> y"), (21, "a<S"), (22, "<" * 50), (23, " lead and trail \t"), (24, "   \x1c wide"),
                    (25, "É \U0001f600 \U0001f600 end"), (26, "<S a M> <P b <M c")] + [(100 + i, f"w{i} <S <P {i} " * i) for i in range(60)]


def low_words(text):
    return WORD.findall((text or "").translate(UPPER))


def against_twin(spark, df, got, sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows.toPandas())
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert rows_of(got, *columns) == sorted(found.fetchall(), key=str)


# --- fill-in-middle

def plain_form(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(tokens), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_forms_equal_the_plain_version(spark):
    df = texts(spark, MORE)
    got = rows_of(fill_in_middle.fill_in_middle(df))
    assert got == sorted(((i, *plain_form(i, t)) for i, t in MORE), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    for r in rows_of(fill_in_middle.digests(df), "output_sha256", "restored_sha256", "form"):
        assert len(r[0]) == 64 and (r[0] == r[1]) == (r[2] == "plain")
    own = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in MORE)
    assert sorted(r[0] for r in rows_of(fill_in_middle.digests(df), "restored_sha256")) == own


def test_forms_equal_the_sql_twin(spark):
    docs = table(spark, SF, "documents")
    against_twin(spark, docs, fill_in_middle.digests(docs), fill_in_middle.oracle(), documents=docs)
    assert rows_of(fill_in_middle.digests(docs.limit(0))) == []


@pytest.mark.parametrize("n", [0, 1, 2, 5, 6, 7, 8, 40, 1000, 70_000])
def test_skip_list_reaches_every_rank(n):
    sizes = np.random.default_rng(n).integers(1, 30, n)
    tokens = fill_in_middle.SkipList(sizes)
    before = np.concatenate([[0], np.cumsum(sizes)])
    for rank in {0, n, n // 2, n // 3, max(n - 1, 0), *random.Random(n).choices(range(n + 1), k=60)}:
        assert tokens.code_points_before(rank) == before[rank]
    assert all(units.sum() == n for units, _, _ in tokens.lanes)
    assert n < 1000 or len(tokens.lanes) > 3
    with pytest.raises(IndexError):
        tokens.code_points_before(n + 1)


def test_long_text_is_cut_whole(spark):
    text = "word é " * 300_000
    rows = [(i, text) for i in range(12)]
    assert rows_of(fill_in_middle.fill_in_middle(texts(spark, rows))) == sorted(
        ((i, *plain_form(i, t)) for i, t in rows), key=str)


# --- resampling

def plain_sample(docs, target):
    def features(text):
        w = low_words(text)
        return [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = [0] * 10000, [0] * 10000
    for counts, rows in ((s, [x for _, x in docs]), (t, target)):
        for text in rows:
            for b in features(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t)]
    out = []
    for doc_id, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((-r[3], r[0] is None, r[0] or 0) for r, (_, x) in zip(out, docs) if len(low_words(x)) >= 20)
    return out, enough[:25 * len(enough) // 100]


def test_sample_equals_the_plain_version(spark):
    words = "Alpha beta, GAMMA deltaé 日本 x1 eps".split()
    rng = random.Random(3)
    docs = MORE + [(1000 + i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(80)]
    docs += docs[-5:] + [(None, "null and void " * 10)] * 3
    target = ["alpha beta gamma deltaé alpha beta", None, "", "x1 eps " * 9]
    wanted, drawn = plain_sample(docs, target)
    got = rows_of(resampling.resample(texts(spark, docs), texts(spark, list(enumerate(target)))))
    assert sorted((r[:4] for r in got), key=str) == sorted(wanted, key=str)
    ranked = sorted((r[4], r[3], r[0]) for r in got if r[4] is not None)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-s, i is None, i or 0) for _, s, i in ranked] == drawn


def test_sample_equals_the_sql_twin(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    against_twin(spark, docs, resampling.resample(docs, bench), resampling.oracle(), documents=docs, benchmark=bench)


def test_empty_tables_sample_nothing(spark):
    some = texts(spark)
    assert rows_of(resampling.resample(some.limit(0), some)) == []
    docs = [(1, "a b c"), (2, None)]
    got = rows_of(resampling.resample(texts(spark, docs), some.limit(0)), "doc_id", "n_features", "weight", "score")
    assert got == sorted(plain_sample(docs, [])[0], key=str)


@pytest.mark.parametrize("text", ["a " * 400_000 + "Béc", "x" * 600_000 + " y", "\x00a/b:c@d`e{f", "İ K K"])
def test_offset_pairs_find_the_words(text):
    n, hashes = resampling.feature_hashes(text)
    w = low_words(text)
    assert n == len(w)
    assert hashes.tolist() == [zlib.crc32(x.encode()) for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


# --- decontamination

def plain_hits(text, items, size=10):
    w, hit, names = low_words(text), set(), set()
    for item, other in items:
        v = low_words(other)
        k = min(size, len(v))
        runs = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1) if k else ():
            if tuple(w[i:i + k]) in runs:
                hit |= set(range(i, i + k))
                names |= {str(item)} if item is not None else set()
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def benchmark_like(rng, n=40):
    words = [f"w{i}" for i in range(30)] + ["a", "b", "ab", "été"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice((1, 2, 3, 9, 10, 11, 25, 60))))) for i in range(n)]
    items += [(None, "w1 w2 w3 w4"), (7, "another text of item seven"), (50, None), (51, " ./ "), items[3], (52, items[4][1].upper())]
    docs = []
    for i in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            text = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(text) + 1)
            parts += [", ".join(text[at:at + rng.randrange(30)]).upper(), "w0 w1"]
        docs.append((i, "\n".join(parts)))
    return items, docs + ODD_TEXTS + [(500, "a a a a a a a a a a a a"), (501, "xa bx ab")]


@pytest.mark.parametrize("part_bytes, held", [(1 << 20, 1 << 24), (300, 2000)])
def test_hits_equal_the_plain_version(spark, part_bytes, held, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 12 if held == 2000 else 2000)
    items, docs = benchmark_like(random.Random(part_bytes))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(texts(spark, docs), bench, part_bytes=part_bytes, held_bytes=held)
    found = sorted(((i, n, h, len(names), decontaminate.item_ids_sha256(names), h > 0)
                    for i, n, h, names in got.collect()), key=str)
    assert found == sorted(((i, *plain_hits(t, items)) for i, t in docs), key=str)
    assert len(decontaminate.write_parts(bench, part_bytes=part_bytes)) > (1 if held == 2000 else 0)


def test_report_equals_the_sql_twin(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = decontaminate.report(docs, bench)
    against_twin(spark, docs, got, decontaminate.oracle(), documents=docs, benchmark=bench)
    assert got.where("contaminated").count() > 0
    clean = decontaminate.without_contaminated(docs, bench)
    assert clean.count() == got.where("not contaminated").count() and clean.columns == docs.columns


def test_empty_tables_hit_nothing(spark):
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert rows_of(decontaminate.report(texts(spark).limit(0), some)) == []
    assert {r[0] for r in rows_of(decontaminate.report(texts(spark), some.limit(0)), "n_hit")} == {0}
    assert {r[0] for r in rows_of(decontaminate.report(texts(spark), spark.createDataFrame(
        [(1, None), (2, "--")], "item_id long, text string")), "n_hit")} == {0}


def test_shifts_never_skip_an_occurrence():
    rng = random.Random(5)
    for _ in range(300):
        patterns = {bytes(rng.choices(b"ab ", k=rng.randrange(1, 9))): 0 for _ in range(rng.randrange(1, 6))}
        patterns = {p: i for i, p in enumerate(patterns)}
        text = bytes(rng.choices(b"ab ", k=rng.randrange(60)))
        found = sorted(decontaminate.Search(patterns, rng.randrange(1, 5)).occurrences(text))
        assert found == sorted((i, i + len(p), k) for p, k in patterns.items()
                               for i in range(len(text)) if text.startswith(p, i))
