"""Plain versions of the operators, one row at a time."""

import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}

ODD_TEXTS = [
    (None, "a b c"), (None, None), (1, ""), (2, None), (3, " \n\t"), (4, "one"), (5, "one"),
    (6, "x" * 30000), (7, "a b c d e f g h\n" * 400), (8, "A B c d e f g h\n" * 400),
    (9, "ünïcödé 日本語 текст. \n zzz"), (9, "another text under the same id"), (10, "one"),
    (-5, "tie tie tie tie"), (11, "tie tie tie tie"), (12, "\n\n."), (13, "| a | b | c | d"),
]


def words(text):
    return WORD.findall(text or "")


def shingle_set(text):
    w = [x.translate(UPPER) for x in words(text)]
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def least_reachable(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return find


def near_duplicates(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    edges = []
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            common = len(a & b)
            if a and b and None not in (i, j) and 100 * common >= 75 * (len(a) + len(b) - common):
                edges.append((i, j))
    find = least_reachable(edges)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=str)


def texts(spark, rows=ODD_TEXTS):
    """With columns that clash with those the operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in (
        "kept", "rep", "bucket", "score", "length", "source", "digest", "lang", "rank")})
