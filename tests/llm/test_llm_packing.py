import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers_llm import SF, rows_of, texts

from readmend.llm import packing, token_files
from readmend.llm.common import table
from readmend.llm.tokens import PieceTokenizer, public_path

BYTES, WORDS = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_library_ids(path):
    rng = random.Random(1)
    odd = ["", "  a  b ", "\n\n a\tb \n\n", "a\xa0b\u3000c", "x\x1cy z", "<|endoftext|> hi",
           "don't  we'll\n\nI'VE 123 ½²", "ΑΣ ΑΣΑ Σ", "e\u0301 \u0301a İ", "a" * 3000, "日本語 テキスト。",
           "\r\n\r\n x", "ª º. µ ß ÿ Ÿ À. ÑÜ, a.. a., !a . ,"]
    odd += ["".join(rng.choice(" \n\t aB'sé1.,!ÀßÍ\u0301\u3000<|") for _ in range(40)) for _ in range(1500)]
    own = PieceTokenizer(path)
    for _ in range(2):  # unknown pieces first, then known ones
        for text, ids in zip(odd, own.encode_all(odd)):
            assert list(np.frombuffer(ids, "<u4")) == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_plain_texts_are_cut_without_a_regular_expression():
    own = PieceTokenizer(BYTES)
    rng = random.Random(2)
    words = ["aB", "é", "don't", "x,", "12.5%", "a%%%.", "___", "I'm1", "½a", "日本", "!a"]
    texts = ["".join(rng.choice(words) + rng.choice("    \n") for _ in range(30)) + "z" for _ in range(300)]
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    def refuse(text):
        raise AssertionError(text)

    own.pieces = refuse
    for _ in range(2):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in own.encode_all(texts)] == want


def test_symbols_after_a_word_do_not_go_to_the_library():
    own = PieceTokenizer(BYTES)
    want = {p: own.tokenizer.encode(p, add_special_tokens=False).ids for p in (" mot%%%", " fin***", "Ça,%%%", " a1&&&.")}
    own.encode_all(["%%%", "***", "1", "&&&.", ",%%%"])
    own.tokenizer = None
    assert {p: np.frombuffer(own.encode(p), "<u4").tolist() for p in want} == want


def plan_of(counts, **options):
    plan = packing.plan_packing(dict(counts), **options)
    used = Counter()
    for times, lengths in plan:
        assert times > 0 and sum(lengths) <= options.get("capacity", 1024)
        for length in lengths:
            used[length] += times
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sum(times for times, _ in plan)


def test_plans_are_whole_and_tight():
    rng = random.Random(3)
    for _ in range(40):
        top = rng.choice([1024, 600, 40])
        counts = Counter(rng.randint(1, top) for _ in range(rng.choice([0, 1, 5, 300])))
        n = plan_of(counts, groups=rng.choice([1, 5, 30]))
        assert n <= 2 * math.ceil(sum(k * v for k, v in counts.items()) / 1024)
    big = Counter(min(1024, int(rng.expovariate(1 / 300)) + 1) for _ in range(50000))
    assert plan_of(big) <= 1.005 * math.ceil(sum(k * v for k, v in big.items()) / 1024)
    # sizes that best fit alone packs badly: 512 + 512 and 3 of 341 leave nothing over
    assert plan_of({512: 1000, 341: 3000}) <= 1510
    with pytest.raises(ValueError):
        packing.plan_packing({2000: 1})


def pieces_of(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
    cuts = [0, *range(first, len(ids) + 1, 1024)] if first else [0]
    return [(p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]


@pytest.mark.parametrize("whole", [False, True])
def test_pack_documents(spark, whole):
    df = table(spark, SF, "documents") if whole else texts(spark)
    got = packing.pack_documents(df, BYTES)
    library = PieceTokenizer(BYTES).tokenizer
    expected = [(r.doc_id, *p) for r in df.collect() for p in pieces_of(r.text, library)]
    assert rows_of(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(expected, key=str)
    sequences = {}
    for r in got.collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    bound = math.ceil(sum(e[3] for e in expected) / 1024)
    assert len(sequences) <= bound + max(1, bound // 50)


def test_empty_tables(spark):
    none = texts(spark).limit(0)
    assert packing.pack_documents(none, BYTES).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(none, WORDS)).count() == 0


@pytest.mark.parametrize("values", [
    [], [0], [7] * 1000, list(range(3000)), [-10, -10, 0, 2 ** 40, 2 ** 40],
    sorted(random.Random(1).randrange(10 ** 9) for _ in range(5000)),
    sorted(random.Random(2).randrange(50) for _ in range(5000))])
def test_elias_fano(values):
    ef = token_files.EliasFano.of(values)
    assert list(ef.slice(0, len(values))) == values
    back, used = token_files.EliasFano.read(memoryview(ef.parts()), ef.n, *ef.spec)
    assert used == len(ef.parts())
    for i in random.Random(3).sample(range(len(values)), min(len(values), 40)):
        assert back.select(i) == values[i]
    if len(values) > 2000 and values[-1] > 10 ** 8:
        bits = 8 * len(ef.parts()) / len(values)
        assert bits <= 2 + math.log2(values[-1] / len(values)) + 1.2


@pytest.mark.parametrize("whole", [False, True])
def test_token_files(spark, whole, monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 7)
    df = table(spark, SF, "documents") if whole else texts(spark)
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (
        r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    library, at, expected = PieceTokenizer(WORDS).tokenizer, 0, []
    for doc_id, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        expected.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = token_files.read_token_files(token_files.write_token_files(df, WORDS))
    assert rows_of(got) == sorted(expected, key=str)


def test_ids_that_do_not_fit_are_refused(tmp_path):
    rows = [(1, np.array([5, 70_000], "<u4").tobytes())]
    with pytest.raises(ValueError, match="70000"):
        token_files.write_shard(str(tmp_path / "a"), rows, 2)
    token_files.write_shard(str(tmp_path / "b"), rows, 4)
    with open(tmp_path / "b", "rb") as f:
        data = f.read()
    assert np.frombuffer(data[:8], "<u4").tolist() == [5, 70_000]
