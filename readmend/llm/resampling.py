"""Importance resampling of documents towards a target.

Words come from the pre-tokenizer of the tokenizers library, an untrained `Split` by a regular
expression over the text with A-Z lower-cased, as pairs of offsets. Features are runs of 1
to `RUN` neighbouring pairs, the words joined by one space; a feature's bucket is the CRC-32
of its bytes modulo `BUCKETS`. The features of all documents and of all target texts are
counted by bucket; a bucket's gain is the floored 1000-fold logarithm of its smoothed share
in the target over that in the documents, and a document's weight the floored mean of
its features' gains. Weights and Gumbel noise, drawn from the doc_id, make scores; the
documents with the highest scores are drawn, which samples without replacement in proportion
to exp(weight / 1000).

Texts are split once. Their buckets, 2 bytes a feature, are kept as a table in the shared
folder, which is counted and then weighed; each task sends one count a bucket, and one
number a bucket comes to the driver, whatever the input. Ranks follow from a sort by ranges
of the score, in which equal scores may be cut anywhere.

A null text has no words. A null doc_id draws the noise of an empty one and comes last among
equal scores. Rows that repeat count and are drawn each on its own. Texts are split in blocks
of `BLOCK` characters that end between words. Columns besides the ids and texts are not read.
Empty tables give no rows, an empty target even gains.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmend.llm.common import stored

BUCKETS = 10_000
RUN = 2
LEAST_WORDS = 20
DRAWN_PCT = 25
SEED = 7
BLOCK = 1 << 18
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
COUNTED = "doc_id long, n_words long, n_features long, buckets binary"

_SPLIT: list = []


def splitter():
    """One pre-tokenizer per worker."""
    if not _SPLIT:
        from tokenizers import Regex, pre_tokenizers

        _SPLIT.append(pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True))
    return _SPLIT[0]


def _blocks(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > BLOCK:
        gap = _GAP.search(text, at + BLOCK)
        cut = gap.start() if gap else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def offset_pairs(text: str | None) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Blocks of the lower-cased text, and where their words are."""
    low = (text or "").encode("utf-8", "replace").lower().decode()
    for block in _blocks(low):
        yield block, [pair for _, pair in splitter().pre_tokenize_str(block)]


def feature_hashes(text: str | None, run: int = RUN) -> tuple[int, np.ndarray]:
    """The number of words, and the CRC-32 of every feature."""
    words = []
    for block, pairs in offset_pairs(text):
        if block.isascii():
            data = block.encode()
            words += [data[a:b] for a, b in pairs]
        else:
            words += [block[a:b].encode() for a, b in pairs]
    sums = list(map(zlib.crc32, words))
    found, spaced = [sums], [b" " + w for w in words]
    for k in range(1, run):  # a run goes on from the checksum of the run without its last word
        sums = list(map(zlib.crc32, islice(spaced, k, None), sums))
        found.append(sums)
    n = sum(map(len, found))
    return len(words), np.fromiter(chain.from_iterable(found), np.uint32, n)


def counted(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """`COUNTED` of every row of (doc_id, text)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches):
        for batch in batches:
            cols = [batch.column("doc_id").to_pylist(), [], [], []]
            for text in batch.column("text"):
                n, hashes = feature_hashes(text.as_py(), run)
                for c, v in zip(cols[1:], (n, len(hashes), (hashes % np.uint32(buckets)).astype(kind).tobytes())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                [c.split()[0] for c in COUNTED.split(", ")])

    return texts.select("doc_id", "text").mapInArrow(count, COUNTED)


def histogram(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features; a task sends one row a bucket at most."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def add(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column("buckets"):
                total += np.bincount(np.frombuffer(data.as_buffer(), kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return features.select("buckets").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket; `documents` and `target` are histograms."""
    spark = documents.sparkSession
    both = (spark.range(buckets).select(F.col("id").alias("bucket"))
            .join(documents.withColumnRenamed("n", "s"), "bucket", "left")
            .join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"]))
    all_s, all_t = both.agg(F.sum("s").cast("double"), F.sum("t").cast("double")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    gain = F.floor(1000 * F.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))
    rows = both.select("bucket", gain.alias("gain")).collect()  # a row a bucket
    out = [0] * buckets
    for bucket, g in rows:
        out[bucket] = g
    return out


def weighed(features: DataFrame, gains: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    kind, table = "<u2" if len(gains) <= 1 << 16 else "<u4", np.array(gains, np.int64)
    names = ["doc_id", "n_words", "n_features", "weight"]

    def weigh(batches):
        for batch in batches:
            weights = []
            for data in batch.column("buckets"):
                own = table[np.frombuffer(data.as_buffer(), kind)]
                weights.append(int(own.sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names[:3]), pa.array(weights, pa.int64())], names)

    return features.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def with_scores(weights: DataFrame, seed: int = SEED) -> DataFrame:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weights.withColumn("score", (F.col("weight") + noise).cast("long"))


def with_ranks(scores: DataFrame, least_words: int = LEAST_WORDS, drawn_pct: int = DRAWN_PCT) -> DataFrame:
    """Adds `rank`, null for what is not drawn."""
    spark = scores.sparkSession
    table = stored(scores.withColumns({
        "open": F.col("n_words") >= least_words, "row": F.monotonically_increasing_id()}), "scores")
    drawn = drawn_pct * table.where("open").count() // 100
    order = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(table.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(
        "place", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("place", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(
        F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    firsts, before = [], 0
    for p, n in counts:
        firsts.append((p, before))
        before += n
    firsts = spark.createDataFrame(firsts or [(0, 0)], "p long, first long")
    rank = F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("p", part).join(F.broadcast(firsts), "p").withColumn(
        "rank", F.when(rank <= drawn, rank)).drop("p", "first", "place", "row", "open")


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; `target` has a `text`."""
    features = stored(counted(docs), "features")
    wanted = stored(counted(target.select(F.lit(None).cast("long").alias("doc_id"), "text")), "target")
    gains = bucket_gains(histogram(features), histogram(wanted))
    return with_ranks(with_scores(weighed(features, gains))).select(
        "doc_id", "n_features", "weight", "score", "rank")


def oracle(docs: str = "documents", target: str = "benchmark") -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "case when v % 2 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end"
    return rf"""
with recursive bits as (
  select range v0, range v, 0 k from range(256) union all select v0, {step}, k + 1 from bits where k < 8),
crc as materialized (select list(v order by v0) t from bits where k = 8),
d as (select row_number() over () r, doc_id, coalesce(regexp_extract_all({low}, '{WORD}'), []) w from {docs}),
b as (select coalesce(regexp_extract_all({low}, '{WORD}'), []) w from {target}),
df as (select r, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) f from d),
bf as (select unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) f from b),
names as (select distinct f from df union select distinct f from bf),
bytes as (select f, list_prepend(4294967295::bigint, list_transform(range(1, strlen(f) + 1),
                 lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::bigint)) o from names),
hashed as materialized (
  select f, xor(list_reduce(o, lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295::bigint) % {BUCKETS} bucket
  from bytes, crc),
s as (select bucket, count(*) s from df join hashed using (f) group by bucket),
t as (select bucket, count(*) t from bf join hashed using (f) group by bucket),
gains as (select range bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from df) + {BUCKETS})::double
            / ((coalesce(s, 0) + 1)::double * ((select count(*) from bf) + {BUCKETS})::double)))::bigint gain
          from range({BUCKETS}) left join s on s.bucket = range left join t on t.bucket = range),
w as (select r, count(*) n_features, floor(sum(gain)::double / count(*))::bigint weight
      from df join hashed using (f) join gains using (bucket) group by r),
h as (select r, doc_id, len(w) n_words, (('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5)
             / 4294967296 h from d),
z as (select h.r, doc_id, n_words, coalesce(n_features, 0)::bigint n_features, coalesce(weight, 0) weight,
             (coalesce(weight, 0) + floor(-1000 * ln(-ln(h::double))))::bigint score from h left join w using (r)),
k as (select r, row_number() over (order by score desc, doc_id nulls last) rank from z where n_words >= {LEAST_WORDS})
select doc_id, n_features, weight, score,
       case when rank <= {DRAWN_PCT} * (select count(*) from k) // 100 then rank end rank
from z left join k using (r)"""
