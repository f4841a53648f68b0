import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from helpers_llm import SF, rows_of, texts
from pyspark.sql import functions as F

from readmend.llm import line_cleaning, order_minhash, rule_quality, toxicity
from readmend.llm.common import held_out, table


def twin(df, sql, name):
    """Rows of the SQL twin on the same table."""
    con = duckdb.connect()
    con.register(name, df.toPandas().astype(object).where(lambda x: x.notna(), None))
    got = con.execute(sql)
    return [c[0] for c in got.description], sorted(got.fetchall(), key=str)


# --- line cleaning

def test_lines_equal_the_sql_twin(spark):
    df = texts(spark).select("doc_id", "text").unionByName(table(spark, SF, "documents").select("doc_id", "text"))
    columns, rows = twin(df.select(F.col("doc_id").cast("int"), "text"), line_cleaning.oracle(), "documents")
    got = rows_of(line_cleaning.clean_documents(df), *columns)
    assert [tuple(x if x is None else int(x) for x in r) for r in got] == [
        tuple(x if x is None else int(x) for x in r) for r in rows]


def test_bad_lines_go_and_good_ones_stay():
    prose = "\n".join(f"Sentence n{i} names{i} seven{i} things{i}, each{i} quite{i} ordinary{i}." for i in range(12))
    bad = ["HOME | NEWS | ABOUT | HELP", "$$$ win*** now### big&&&", "ALL OF THIS IS SHOUTED",
           "buy buy buy buy buy", "All rights reserved.", prose.split("\n")[3],
           "one two three four five six seven eight nine ten eleven"]
    row = dict(zip(line_cleaning._NAMES, line_cleaning.judge_text(prose + "\n" + "\n".join(bad))))
    assert row["kept"] and row["clean_text"] == prose and row["n_bad_lines"] == len(bad)
    row = dict(zip(line_cleaning._NAMES, line_cleaning.judge_text("\n".join(f"{b} {i}" for i in range(30) for b in bad))))
    assert not row["kept"]


@pytest.mark.parametrize("text, n", [("a b c", 0), ("a b c a b c", 6), ("a a a a", 4), ("", 0),
                                     ("a b c x a b c d", 6), ("q a b c d a b c d q", 8)])
def test_repeated_words(text, n):
    assert line_cleaning.repeated_words(text.encode().split()) == n


# --- fingerprints

def plain_pairs(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        changed = order_minhash.edited(text, following)
        a, b, c = map(order_minhash.fingerprint, (text, changed, following))
        yield (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), order_minhash.as_text(a),
               order_minhash.as_text(b), order_minhash.likeness(a, b), order_minhash.likeness(a, c))


@pytest.mark.parametrize("n", [0, 1, None])
def test_fingerprints_equal_brute_force(spark, n):
    df = texts(spark) if n is None else texts(spark).limit(n)
    if n is None:
        df = df.unionByName(table(spark, SF, "documents"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert rows_of(order_minhash.edited_fingerprints(df)) == sorted(plain_pairs(rows), key=str)


def plain_fingerprint(text):
    """Straight from the definition, one function at a time."""
    keys = order_minhash.kmers(text)
    seen, pairs = {}, []
    for key in keys.tolist():
        seen[key] = seen.get(key, -1) + 1
        pairs.append((key + seen[key] * int(order_minhash._PLACES[order_minhash.K])) % 2 ** 64)
    pairs = (order_minhash.mixed(np.array(pairs, np.uint64)) >> np.uint64(32)).tolist()
    chosen = []
    for a, b in zip(order_minhash._FACTORS[:, 0].tolist(), order_minhash._SHIFTS[:, 0].tolist()):
        ranked = sorted(range(len(pairs)), key=lambda i: ((a * pairs[i] + b) % 2 ** 32, i))
        chosen.append(sorted(ranked[:order_minhash.PICKED]))
    return chosen


def test_least_pairs_keep_the_order_of_the_text():
    text = " ".join(f"word{i % 13}" for i in range(900))
    keys = order_minhash.kmers(text)
    pairs = (order_minhash.mixed(keys + order_minhash.occurrence_numbers(keys).astype(np.uint64)
             * order_minhash._PLACES[order_minhash.K]) >> np.uint64(32)).astype(np.uint32)
    assert order_minhash._least(pairs).tolist() == plain_fingerprint(text)


def test_order_counts():
    parts = [f"{w}{i * 7919 % 1000} {i * 104729 % 9973}{w[::-1]}; " for i, w in enumerate("alpha beta gamma delta epsilon zeta eta theta".split() * 6)]
    text, turned = "".join(parts), "".join(parts[::-1])
    small = text.replace(parts[2], "something else; ")
    p = order_minhash.fingerprint(text)
    near, far = (order_minhash.likeness(p, order_minhash.fingerprint(t)) for t in (small, turned))
    assert near > 0.8 and far < near - 0.2
    assert order_minhash.likeness(p, order_minhash.fingerprint("")) == 0
    assert order_minhash.likeness(order_minhash.EMPTY, order_minhash.fingerprint(None)) == 1


# --- learnt scores

def documents(spark, sf):
    return table(spark, f"/root/testdata/{sf}", "documents"), table(spark, f"/root/testdata/{sf}", "labels")


def held(scores, labels, label):
    return scores.where("held_out").join(labels.where(f"{label} is not null"), "doc_id").select(
        "predicted", F.col(label).alias("y")).toPandas()


def test_quality_on_held_out_documents(spark):
    docs, labels = documents(spark, "sf0.01")
    got = held(rule_quality.score_documents(docs, labels), labels, "quality")
    assert (got.predicted == got.y).mean() >= 0.96
    assert (got.predicted[got.y == 0] == 0).mean() >= 0.8


def test_toxicity_on_held_out_documents(spark):
    docs, labels = documents(spark, "sf0.1")
    got = held(toxicity.score_documents(docs, labels), labels, "toxic")
    assert (got.predicted[got.y == 0] == 0).mean() >= 0.99
    assert (got.predicted[got.y == 1] == 1).mean() >= 0.75


@pytest.mark.parametrize("operator", [rule_quality, toxicity])
def test_odd_rows_have_scores(spark, operator):
    _, labels = documents(spark, "sf0.001")
    df = texts(spark)
    none = labels.limit(0)
    for truth in (labels, none, labels.where("toxic = 0 and quality = 1"),
                  labels.withColumn("toxic", F.lit(None).cast("int")).withColumn("quality", F.lit(None).cast("int"))):
        rows = operator.score_documents(df, truth).collect()
        assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
        for r in rows:
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert operator.score_documents(df.limit(0), labels).count() == 0


def test_rules_compile_to_the_same_scores(spark):
    docs, labels = documents(spark, "sf0.001")
    model = rule_quality.learn(docs, labels)
    assert model.rules
    rows = docs.unionByName(texts(spark).select("doc_id", "text"), allowMissingColumns=True).select(
        rule_quality.statistics(F.col("text")).alias("s"), rule_quality.quality(F.col("text"), model).alias("p"))
    x = rows.select("s.*", "p").toPandas().to_numpy(float)
    assert np.allclose(model.scores(x[:, :-1]), x[:, -1])
    assert np.array_equal(np.isnan(x), np.zeros_like(x, bool))


def test_lasso_finds_the_rule_that_counts():
    rng = np.random.default_rng(4)
    x = rng.random((1500, len(rule_quality.STATISTICS)))
    y = ((x[:, 3] > 0.6) & (x[:, 5] <= 0.5)).astype(float)
    model = rule_quality.fit(x, y)
    fresh = rng.random((1500, x.shape[1]))
    truth = (fresh[:, 3] > 0.6) & (fresh[:, 5] <= 0.5)
    assert ((model.scores(fresh) >= 0.5) == truth).mean() > 0.97
    assert len(model.rules) < 120


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = documents(spark, "sf0.001")
    wrong = labels.withColumns({c: F.when(held_out(), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for operator in (rule_quality, toxicity):
        assert rows_of(operator.score_documents(docs, labels)) == rows_of(operator.score_documents(docs, wrong))


def test_toxic_words_are_caught_and_others_left():
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}{c}" for a in "ba ke li mo nu".split() for b in "ren tis dor".split() for c in "al em or".split()]
    bad = ["grumblefax", "snorkwit", "dunderlug"]
    rows = []
    for i in range(400):
        text = list(rng.choice(plain, 60))
        if i % 4 == 0:
            for w in rng.choice(bad, 2):
                text.insert(int(rng.integers(0, 60)), w)
        rows.append((" ".join(text), int(i % 4 == 0)))
    model = toxicity.fit(rows[:300])
    assert np.mean([(model.score(t) >= 0.7) == bool(y) for t, y in rows[300:]]) > 0.97


def test_levels_follow_all_labels_and_not_the_caps(spark, monkeypatch):
    docs, labels = documents(spark, "sf0.1")
    whole = rule_quality.learn(docs, labels).level, toxicity.learn(docs, labels).level
    # caps that take three tenths of one label value only
    monkeypatch.setattr(rule_quality, "MOST_ROWS", {0: 4000, 1: 678})
    monkeypatch.setattr(toxicity, "MOST_ORDINARY", 700)
    fit_quality, fit_toxicity = rule_quality.fit, toxicity.fit
    as_sampled = []
    for module, fit in ((rule_quality, fit_quality), (toxicity, fit_toxicity)):
        monkeypatch.setattr(module, "fit", lambda *rows, f=fit: as_sampled.append(f(*rows[:-1]).level) or f(*rows))
    capped = rule_quality.learn(docs, labels).level, toxicity.learn(docs, labels).level
    gaps = [c - s for c, s in zip(capped, as_sampled)]
    assert np.allclose(gaps, [np.log(2260 / 678), np.log(700 / 2331)])
    assert all(abs(c - w) < abs(s - w) for c, s, w in zip(capped, as_sampled, whole))
    print("levels: whole", whole, "capped, not corrected", as_sampled, "capped", capped)


def test_share_without_both_labels_follows_all_labels():
    x = np.zeros((50, len(rule_quality.STATISTICS)))
    for model in (rule_quality.fit(x, np.ones(50), {0: 1.0, 1: 0.1}),
                  toxicity.fit([(f"text {'a' * i}", 1) for i in range(50)], {0: 1.0, 1: 0.1})):
        assert np.isclose(model.level, np.log(500.5 / 0.5))
