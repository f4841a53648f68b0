"""Order MinHash fingerprints.

The k-mers of a text (runs of `K` code points) are numbered by occurrence, so that a text is
a set of distinct (k-mer, number) pairs. Each of `FUNCTIONS` hash functions selects its
`PICKED` least pairs; they are put back in the order of the text, and the tuple of their
k-mers is hashed to 32 bits. Two texts' entries agree if the same k-mers are least and come
in the same order, so moving passages lowers the likeness, as it raises the edit distance.

A text shorter than `K` is one k-mer. A null or empty text has one fixed fingerprint, all
zeros: like itself, unlike any other. Equal texts have equal fingerprints.

`edited_fingerprints` also compares each document with its successor in descending doc_id
(nulls last, ties by text, the first after the last). Rows are dealt to ranges of doc_id;
the first row of a range is given to the range before it as well, so that no range has to
wait for another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmend.llm.text_hash import mixed

K = 8
PICKED = 2
FUNCTIONS = 64
RANGES_A_PARTITION = 4
_BLOCK = 4096

_SEEDS = np.random.default_rng(8)
_FACTORS = (_SEEDS.integers(0, 1 << 31, FUNCTIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFTS = _SEEDS.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32)[:, None]
_PLACES = _SEEDS.integers(0, 1 << 63, K + PICKED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROWS = np.arange(FUNCTIONS)
EMPTY = np.zeros(FUNCTIONS, np.uint32)

ROWS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double")


def kmers(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    k = min(K, len(points))
    out = np.full(len(points) - k + 1, k, np.uint64)
    for j in range(k):
        out += (points[j:len(points) - k + 1 + j] + np.uint64(1)) * _PLACES[j]
    return mixed(out)


def occurrence_numbers(keys: np.ndarray) -> np.ndarray:
    """How often the same key came before."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.empty(len(keys), bool)
    first[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=first[1:])
    starts = np.flatnonzero(first)
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
    return out


def _least(pairs: np.ndarray) -> np.ndarray:
    """The places of the `PICKED` least pairs by each function, in the order of the text."""
    places, values = [], []
    for at in range(0, len(pairs), _BLOCK):
        h = _FACTORS * pairs[None, at:at + _BLOCK] + _SHIFTS
        for _ in range(min(PICKED, h.shape[1])):
            j = h.argmin(axis=1)
            places.append(j + at)
            values.append(h[_ROWS, j].astype(np.uint64))
            h[_ROWS, j] = np.uint32(0xFFFFFFFF)
    places, values = np.stack(places, 1), np.stack(values, 1)
    if places.shape[1] > PICKED:
        chosen = np.argsort(values, axis=1, kind="stable")[:, :PICKED]
        places = np.take_along_axis(places, chosen, 1)
    return np.sort(places, axis=1)


def fingerprint(text: str | None) -> np.ndarray:
    if not text:
        return EMPTY
    keys = kmers(text)
    pairs = (mixed(keys + occurrence_numbers(keys).astype(np.uint64) * _PLACES[K])
             >> np.uint64(32)).astype(np.uint32)
    places = _least(pairs)
    out = np.full(FUNCTIONS, places.shape[1], np.uint64)
    for j in range(places.shape[1]):
        out = mixed(out * _PLACES[K + 1] + keys[places[:, j]])
    return (out >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float((x == y).mean())


def as_text(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _ranges(docs: DataFrame) -> DataFrame:
    """Rows with `range` and `extra`: true for the copy of a range's first row that the
    range before it gets."""
    spark = docs.sparkSession
    n = RANGES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n), float)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(-cuts[::-1], -ids.to_numpy("float64", na_value=np.nan), side="left")
        return pd.Series(np.where(ids.isna(), len(cuts) + 1, at))

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "range", range_of("doc_id"))
    tops = rows.groupBy("range").agg(F.max("doc_id").alias("top")).orderBy("range").collect()
    before = [(r["range"], r["top"], tops[i - 1]["range"]) for i, r in enumerate(tops)]
    small = spark.createDataFrame(before or [(0, 0, 0)], "of int, top long, before int")
    here = F.struct(F.col("range"), F.lit(False).alias("extra"))
    there = F.struct(F.col("before").alias("range"), F.lit(True).alias("extra"))
    # a row a range: as many as there are partitions, times a constant
    return rows.join(F.broadcast(small), F.col("range") == F.col("of")).select(
        "doc_id", "text", F.explode(
            F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(here, there))
            .otherwise(F.array(here))).alias("at")).select("doc_id", "text", "at.*")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """`ROWS` of every document."""
    fields = [c.split() for c in ROWS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def compare(batches):
        last = None  # (range, doc_id, text, fingerprint) that waits for its successor
        for batch in batches:
            cols = [[] for _ in fields]
            for doc_id, text, at, extra in zip(*(batch.column(i).to_pylist() for i in range(4))):
                waits = last is not None and last[0] == at
                if extra and not waits:
                    continue
                own = fingerprint(text)
                if waits:
                    _, before, old, old_print = last
                    changed = edited(old, text)
                    other = old_print if changed == old else fingerprint(changed)
                    for c, v in zip(cols, (
                            before, len(old),
                            hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                            as_text(old_print), as_text(other), likeness(old_print, other),
                            likeness(old_print, own))):
                        c.append(v)
                last = None if extra else (at, doc_id, text, own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kinds[f[1]]) for c, f in zip(cols, fields)], [f[0] for f in fields])

    ordered = _ranges(docs).repartition(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "range").sortWithinPartitions(
        "range", "extra", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.select("doc_id", "text", "range", "extra").mapInArrow(compare, ROWS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every document."""
    @F.pandas_udf("string")
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series([as_text(fingerprint(t)) for t in texts])

    return docs.select("doc_id", make("text").alias("fingerprint"))
