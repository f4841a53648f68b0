import pytest
from helpers_llm import SF, rows_of, words

from readmend.llm import balance
from readmend.llm.common import table


def plain_targets(sizes):
    """`sizes` in order of the sources."""
    weights = [balance.WEIGHTS[i % 3] for i in range(len(sizes))]
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in capped)
        open_ = sum(w for i, w in enumerate(weights) if i not in capped)
        targets = [3.0 * s if i in capped else w * rest / open_ if open_ else 0.0
                   for i, (s, w) in enumerate(zip(sizes, weights))]
        more = {i for i, t in enumerate(targets) if i not in capped and t > 3 * sizes[i]}
        if not more:
            return targets
        capped |= more


def order(source):
    return (source is None, (source or "").encode())


def test_mix(spark):
    docs = table(spark, SF, "documents")
    rows = balance.mix_report(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    names = sorted(sizes, key=order)
    targets = dict(zip(names, plain_targets([sizes[s] for s in names])))
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    smallest = min(r.size for r in rows)
    for s in names:
        assert abs(taken[s] - targets[s]) <= max(0.02 * targets[s], smallest)
    again = balance.mix_report(docs.repartition(5))
    assert rows_of(again) == sorted(map(tuple, rows), key=str)


ROWS = [(None, "a b", None), (None, None, "x"), (3, "", ""), (3, "a b c", "y"), (3, "a b c", "y"),
        (-5, "x " * 900, None), (8, "k " * 20, "Z"), (9, "k " * 20, "z")]


def test_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    rows = balance.mix_report(df).collect()
    assert sorted(((r.doc_id, r.size, r.source) for r in rows), key=str) == sorted(
        ((d, len(words(t)), s) for d, t, s in ROWS), key=str)
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    names = sorted(sizes, key=order)
    targets = dict(zip(names, plain_targets([sizes[s] for s in names])))
    assert all(r.target == pytest.approx(targets[r.source]) for r in rows)
    # sources that stop at three times their size take every document three times
    assert all(r.copies == 3 for r in rows if r.size and r.target >= 3 * r.source_size)
    mixed = balance.mixed_documents(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert balance.mix_report(df.limit(0)).count() == 0
    assert balance.mixed_documents(df.limit(0)).count() == 0


def taken_of(spark, sizes, rate, target):
    rates = spark.createDataFrame([(i, 0, s, 1, rate) for i, s in enumerate(sizes)],
                                  "doc_id long, sid long, size long, n long, rate double")
    sources = spark.createDataFrame([(0, sum(sizes), len(sizes), target)],
                                    "sid long, source_size long, docs long, target double")
    rows = balance.whole_copies(rates, sources).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(sizes)))
    assert all(0 <= r.copies <= 3 and r.size == sizes[r.doc_id] for r in rows)
    return sum(r.copies * r.size for r in rows)


# the bounds: half a small document for each slice of 400, or what is out of reach
@pytest.mark.parametrize("sizes, rate, target, most", [
    ([200_000] + [100] * 400, 0.525, 126_000.0, 6_000),       # 0 of it and 3 of all others is the nearest
    ([200_000] + [100] * 4000, 0.52, 312_000.0, 11 * 50),     # one of it, the others take up the rest
    ([200_000, 150_000] + [70] * 3000, 1.3, 728_000.0, 8 * 35),
    ([9_000] * 50 + [100] * 50, 0.51, 232_050.0, 50),         # mostly giants
    ([100] * 3000, 0.9, 600_000.0, 8 * 50),                   # rates that did not reach the target
    ([100] * 3000, 1.2, 150_000.0, 8 * 50),
    ([0, 0], 1.0, 0.0, 0)])
def test_a_giant_document_does_not_move_its_source_off_target(spark, sizes, rate, target, most):
    assert abs(taken_of(spark, sizes, rate, target) - target) <= most


def test_giant_document_with_clashing_columns(spark):
    rows = [(i, "w " * 100, "b", i, -1.0, 7) for i in range(300)] + [(999, "w " * 90_000, "b", 5, 2.0, 7)]
    rows += [(1000 + i, "w " * 50, "a", 5, 2.0, 7) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long, rate double, copies int")
    report = balance.mix_report(df).collect()
    sizes = [30_000, 120_000]
    for source, target in zip("ab", plain_targets(sizes)):
        taken = sum(r.taken for r in report if r.source == source)
        assert all(r.target == pytest.approx(target) for r in report if r.source == source)
        assert abs(taken - target) <= 50
    mixed = balance.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in report)
