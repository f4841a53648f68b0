"""Near-duplicates: universal hash minima with banding, signature verification, a check on
the full sets, and components by large-star and small-star.

1. A document's set is its distinct 5-word shingles, A-Z lower-cased, as 64-bit hashes.
   Documents of one word sequence are represented by the least doc_id.
2. `HASHES` multiply-shift functions of the shingles are minimised. `BANDS` groups of `ROWS`
   minima are bucket keys: two sets of similarity s share one with probability
   1 - (1 - s^5)^40, that is all but 2 in 100,000 at s = 0.75. The lowest bit of each
   minimum makes a sketch of 256 bits; bits agree with probability (1 + s) / 2.
3. Candidates are pairs of one bucket, of possible sizes and with sketches that agree in at
   least `MIN_AGREEING` bits (5.5 standard deviations below the mean at 0.75), tested
   inside the join. Each is confirmed on the full sets, in integers.
4. Groups of near copies would make all pairs. So each bucket first tests its members
   against one of them, the pivot; components found so are left out of what follows. After
   `PIVOTS` such rounds the documents outside of their bucket's main component are tested
   against every block of up to `BLOCK_DOCS` members of another component in the bucket:
   one row for a document and a block, sketches and then full sets inside, and at most one
   link out. Only pairs inside one component, which can't change the result, are never
   tested. This last test costs (documents outside) x (members) / `BLOCK_DOCS` rows.

Rows without a doc_id take no part: their component is null and they are kept. Rows that
share a doc_id are one document: what is linked to one of its texts is linked to it.
Documents without a word are linked with nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readmend.llm.common import garbage_dropped, stored
from readmend.llm.components import connected_components
from readmend.llm.text_hash import grams, mixed, word_hashes

SHINGLE = 5
SIMILARITY_PCT = 75
HASHES, BANDS, ROWS = 256, 40, 5
MIN_AGREEING = 195
PIVOTS = 2
BLOCK_DOCS, SLICE_DOCS = 256, 400
_BLOCK = 512

_SEEDS = np.random.default_rng(75)
_FACTORS = (_SEEDS.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_SHIFTS = _SEEDS.integers(0, 1 << 63, HASHES, dtype=np.uint64)[:, None]
_BAND_KEYS = _SEEDS.integers(0, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "doc_id long, sequence binary, n_shingles long, bands array<long>, sketch array<long>"


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(grams(word_hashes((text or "").encode()), SHINGLE))


def minima(items: np.ndarray) -> np.ndarray:
    """The minimum of each hash function, 32 bits; multiply-add-shift of 32-bit keys."""
    keys = (items >> np.uint64(32))[None, :]
    out = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for at in range(0, keys.shape[1], _BLOCK):
        h = _FACTORS * keys[:, at:at + _BLOCK]
        h += _SHIFTS
        np.minimum(out, h.min(axis=1), out=out)
    return out >> np.uint64(32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature[:BANDS * ROWS].reshape(BANDS, ROWS)
    return mixed((rows * _BAND_KEYS[:, :ROWS]).sum(axis=1, dtype=np.uint64) + _BAND_KEYS[:, ROWS])


def sketch(signature: np.ndarray) -> np.ndarray:
    bits = mixed(signature + np.uint64(1)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def signed(docs: DataFrame) -> DataFrame:
    """`SIGNED` of every document; without a word, `sequence` is null."""
    names = [c.split()[0] for c in SIGNED.split(", ")]

    def sign(batches):
        for batch in batches:
            cols = [batch.column("doc_id").to_pylist(), [], [], [], []]
            for text in batch.column("text").to_pylist():
                words = word_hashes((text or "").encode())
                if not len(words):
                    row = (None, 0, None, None)
                else:
                    items = np.unique(grams(words, SHINGLE))
                    signature = minima(items)
                    row = (hashlib.blake2b(words, digest_size=16).digest(), len(items),
                           band_keys(signature).view(np.int64), sketch(signature))
                for c, v in zip(cols[1:], row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([
                pa.array(c, t) for c, t in zip(cols, (
                    pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                names)

    return docs.select("doc_id", "text").mapInArrow(sign, SIGNED)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= SIMILARITY_PCT * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as edges (u, v)."""
    def check(batches):
        for batch in batches:
            known, good = {}, []
            cols = [batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")]
            for a, b, text_a, text_b in zip(*cols):
                # a pivot comes again and again
                sets = [known[t] if t in known else known.setdefault(t, shingles(t))
                        for t in (text_a, text_b)]
                good.append(_similar(*sets))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(keep), batch.column("b").filter(keep)], ["u", "v"])

    both = (pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "u long, v long")


def _plausible(x: str, y: str) -> str:
    """Sizes and sketches of two rows allow the similarity."""
    bits = " + ".join(f"bit_count({x}.s{i} ^ {y}.s{i})" for i in range(4))
    return (f"100 * least({x}.n, {y}.n) >= {SIMILARITY_PCT} * greatest({x}.n, {y}.n) "
            f"and {bits} <= {HASHES - MIN_AGREEING}")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _labelled(members: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Members of the buckets that hold more than one component, with `component`, and
    the one that most members of the bucket have."""
    if edges is None:
        found = members.withColumn("component", F.col("rep"))
    else:
        names = connected_components(edges)
        found = members.join(names, F.col("rep") == F.col("node"), "left").withColumn(
            "component", F.coalesce("component", "rep")).drop("node")
    sizes = found.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("bucket").agg(
        F.max(F.struct("size", F.negative("component").alias("order"))).alias("top"),
        F.count(F.lit(1)).alias("components")).where("components > 1").select(
        "bucket", F.negative("top.order").alias("main"))
    return stored(found.join(main, "bucket"), "buckets")


def _links_to_blocks(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) of each document outside of its bucket's main component with other
    components of the bucket, one for each block and component. Blocks hold documents
    whose buckets have one main component in common."""
    numbers = ["n", "s0", "s1", "s2", "s3"]
    text = texts.select(F.col("doc_id").alias("rep"), "text")
    reps = rows.groupBy("rep", "component", *numbers).agg(F.min("main").alias("home"))
    sizes = reps.groupBy("home").agg(F.count(F.lit(1)).alias("size"))
    reps = stored(reps.join(sizes, "home").withColumn("part", F.pmod(
        F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK_DOCS))), "open")
    places = rows.join(reps.select("rep", "home", "part").distinct(), "rep").groupBy(
        "bucket", "home", "part").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    outside = rows.where("component <> main").select("bucket", "rep", "component")
    tasks = stored(outside.join(places, "bucket").where(
        "component <> low or component <> high").select("rep", "home", "part").distinct(), "tasks")
    slices = tasks.groupBy("home", "part").agg(
        F.ceil(F.count(F.lit(1)) / SLICE_DOCS).alias("slices"))
    members = (reps.join(slices, ["home", "part"])
               .withColumn("slice", F.explode(F.expr("sequence(0L, slices - 1)")))
               .join(text, "rep"))
    askers = (tasks.join(slices, ["home", "part"])
              .withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")))
              .join(reps.select("rep", "component", *numbers), "rep").join(text, "rep"))
    keys = ["home", "part", "slice"]
    columns = ["rep", "component", *numbers, "text"]

    def read(t: pa.Table):
        rep, component, n, *bits = (t.column(c) for c in t.column_names[3:-1])
        return (rep.to_pylist(), component.to_numpy(), n.to_numpy(),
                np.stack([b.to_numpy() for b in bits], 1).view(np.uint64),
                t.column(t.num_columns - 1).to_pylist())

    def test(asking: pa.Table, block: pa.Table) -> pa.Table:
        found, known = ([], []), {}
        if asking.num_rows and block.num_rows:
            ids, components, sizes, bits, own = read(block)
            for rep, component, n, mine, asked in zip(*read(asking)):
                agreeing = HASHES - np.bitwise_count(bits ^ mine).sum(1, dtype=np.int64)
                order = np.flatnonzero(
                    (components != component) & (agreeing >= MIN_AGREEING)
                    & (100 * np.minimum(sizes, n) >= SIMILARITY_PCT * np.maximum(sizes, n)))
                items, linked = shingles(asked) if len(order) else None, set()
                for j in order[np.argsort(-agreeing[order], kind="stable")]:
                    if components[j] in linked:
                        continue
                    if j not in known:
                        known[j] = shingles(own[j])
                    if _similar(items, known[j]):
                        linked.add(components[j])
                        found[0].append(rep)
                        found[1].append(ids[j])
        return pa.table({"u": pa.array(found[0], pa.int64()), "v": pa.array(found[1], pa.int64())})

    # columns under names of their own: both sides come from the same tables
    asking = askers.select(*[F.col(c).alias(f"ask_{c}") for c in keys + columns])
    return asking.groupBy(*[f"ask_{c}" for c in keys]).cogroup(
        members.select(*keys, *columns).groupBy(*keys)).applyInArrow(test, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    table = stored(signed(docs), "signatures")
    with_words = table.where("doc_id is not null and sequence is not null")
    reps = stored(with_words.groupBy("sequence").agg(F.min("doc_id").alias("rep")), "sequences")
    first = with_words.join(reps, (with_words.doc_id == reps.rep)
                            & (with_words.sequence == reps.sequence)).select(
        "rep", "n_shingles", "bands", "sketch").dropDuplicates(["rep", "n_shingles", "sketch"])
    first = stored(first, "representatives")

    rows = first.select("rep", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = rows.join(shared, "bucket").select("bucket", "rep")
    members = members.join(first.select(
        "rep", F.col("n_shingles").alias("n"), *[F.col("sketch")[i].alias(f"s{i}") for i in range(4)]),
        "rep")
    members = stored(members, "members")
    texts = stored(docs.select("doc_id", "text").join(
        members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")

    # rows of one doc_id with several word sequences
    own = with_words.select("doc_id", "sequence").join(reps, "sequence").select("doc_id", "rep")
    least = own.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("top")).where("v < top")
    edges = stored(own.join(least, "doc_id").select(F.col("rep").alias("u"), "v").distinct(), "links")

    numbers = ["n", "s0", "s1", "s2", "s3"]
    for turn in range(PIVOTS):
        garbage_dropped(docs.sparkSession)
        open_rows = _labelled(members, edges)
        # first the least document of the main component, then the least one outside of it
        outside = F.col("component") != F.col("main")
        pivots = open_rows.groupBy("bucket").agg(F.min(F.struct(
            (outside if turn % 2 == 0 else ~outside).alias("later"), "rep", "component",
            *numbers)).alias("p")).select("bucket", "p.*")
        pairs = open_rows.alias("m").join(
            pivots.alias("p"), F.expr("m.bucket = p.bucket and m.component <> p.component and "
                                      + _plausible("m", "p")))
        pairs = _pairs(pairs.select(F.col("m.rep").alias("x"), F.col("p.rep").alias("y")))
        edges = stored(edges.union(confirmed(pairs, texts)), "links")
    garbage_dropped(docs.sparkSession)
    edges = stored(edges.union(_links_to_blocks(_labelled(members, edges), texts)), "links")

    names = connected_components(edges).select(F.col("node").alias("rep"), "component")
    groups = reps.join(names, "rep", "left").select(
        "sequence", F.coalesce("component", "rep").alias("group"))
    found = table.select("doc_id", "sequence", "n_shingles").join(groups, "sequence", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("group", "doc_id"))
    out = found.select("doc_id", "n_shingles", component.cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: where rows share the id of the kept
    document, the one with the least text. Rows without an id stay."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    again = F.row_number().over(Window.partitionBy("id").orderBy(F.col("row.text")))
    found = docs.select(row, docs["doc_id"].alias("id")).join(
        kept.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    return (found.withColumn("again", again).where("again = 1").select("row.*")
            .unionByName(docs.where("doc_id is null")))
