"""Mixing sources to target word counts by entropy balancing.

Every document i gets a rate r_i, near 1, so that each source's words add up to its target:
minimise the sum of r_i log r_i - r_i + 1 over all documents, under sum(r_i * size_i) = T_s
for each source and r_i <= `MAX_COPIES`. The dual has one variable a source, and its
solution tilts exponentially by size: r_i = min(MAX_COPIES, exp(l_s * size_i / mean_s)).
Newton steps on log(sum) = log(T_s), kept inside a bracket, find l_s for all sources at once.
A step sums over (source, size, count), the table of distinct sizes, and joins the sums to
one row a source; nothing is collected but one number, the largest miss.

Rates become whole copies in slices of about `SLICE_DOCS` documents of a source, largest
first: what rounding leaves over is carried to the next document. Documents of more than 1 /
`GIANTS` of their source, so fewer than `GIANTS` a source, are rounded before, to counts that
leave the others a sum they can reach. What a source then lacks or has too much of (left over in
slices, by giants, or by rates that `STEPS` steps did not bring to `TOLERANCE`) is dealt over its
slices by what they can give or take. So a slice ends within half of its smallest document of what
it was dealt, and a source misses its target by more than these only where giants leave no other
way: half of the smallest giant at most, or what all other documents at 0 or `MAX_COPIES` leave.

Weights go by the rank of the source name, in code point order, null last. A source's target
stops at MAX_COPIES times its size; the excess goes to the others by weight. Documents
without a word are taken no times. Rows with the same doc_id, source and size are one
case with a count. A null text has no words. An empty table gives no rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmend.llm.common import garbage_dropped, stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
STEPS = 40
TOLERANCE = 1e-9
SLICE_DOCS = 400
GIANTS = 64
WORD = r"[^\x20\x09-\x0D]+"

COPIES = "doc_id long, sid long, slice long, size long, copies int, n long"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, n): documents with equal values are one row."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", words.alias("size")).groupBy(
        "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, sid, source_size, docs): `sid` is the rank, 0 on. Range partitions in
    order; ranks follow from their numbers of rows."""
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    order = F.col("source").asc_nulls_last()
    parts = stored(
        totals.repartitionByRange(order).sortWithinPartitions(order)
        .withColumn("id", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("id", 33)
    counts = {r["p"]: r["n"] for r in parts.groupBy(part.alias("p")).agg(
        F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    starts, at = [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    starts = spark.createDataFrame(starts or [(0, 0)], "p long, first long")
    return parts.withColumn("p", part).join(F.broadcast(starts), "p").select(
        "source", (F.col("first") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("sid"),
        "source_size", "docs")


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Each round fixes the sources above their limit and shares out the rest anew."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    limit = F.col("source_size").cast("double") * MAX_COPIES
    table = sources.withColumns({"weight": weight, "limit": limit})
    level, stopped = 0.0, -1
    while True:
        over = F.col("weight") * level >= F.col("limit") if stopped >= 0 else F.lit(False)
        row = table.agg(
            F.sum("source_size").alias("total"), F.sum(over.cast("int")).alias("stopped"),
            F.sum(F.when(over, F.col("limit"))).alias("fixed"),
            F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if row["stopped"] == stopped or not row["open"]:
            break
        stopped = row["stopped"]
        level = (row["total"] - (row["fixed"] or 0.0)) / row["open"]
    return table.withColumn("target", F.least(F.col("weight") * level, F.col("limit"))).drop(
        "weight", "limit")


def solve_rates(histogram: DataFrame, sources: DataFrame) -> DataFrame:
    """(sid, tilt, mean, full) of every source: rates are min(MAX_COPIES,
    exp(tilt * size / mean)), or MAX_COPIES throughout where `full`."""
    size = F.col("source_size").cast("double")
    state = sources.select(
        "sid", "target", (size / F.greatest("docs", F.lit(1))).alias("mean"),
        (F.col("target") >= size * MAX_COPIES * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"), F.lit(math.inf).alias("miss"))
    state = stored(state, "tilts")
    scaled = F.col("size") / F.col("mean")
    rate = F.least(F.exp(F.col("tilt") * scaled), F.lit(float(MAX_COPIES)))
    words = F.col("n") * F.col("size") * rate
    slope = F.when(F.col("tilt") * scaled < math.log(MAX_COPIES), words * scaled).otherwise(0.0)
    for _ in range(STEPS):
        garbage_dropped(histogram.sparkSession)
        sums = histogram.join(state.where("not full"), "sid").groupBy("sid").agg(
            F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        t = state.join(sums, "sid", "left")
        miss = F.coalesce(F.abs(F.log(F.col("words") / F.col("target"))), F.lit(0.0))
        low = F.when(F.col("words") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("words") > F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.log(F.col("words") / F.col("target")) * F.col("words") / F.col("slope")
        t = t.select("sid", "target", "mean", "full", "tilt", low.alias("low"), high.alias("high"),
                     miss.alias("miss"), step.alias("step"))
        # outside the bracket, or nowhere: halve it, or go on doubling
        inside = (F.col("step").isNotNull() & ~F.isnan("step")
                  & (F.col("low").isNull() | (F.col("step") > F.col("low")))
                  & (F.col("high").isNull() | (F.col("step") < F.col("high")))
                  & (F.abs("step") < 1e6))
        other = (F.when(F.col("low").isNull(), 2 * F.col("high") - 1)
                 .when(F.col("high").isNull(), 2 * F.col("low") + 1)
                 .otherwise((F.col("low") + F.col("high")) / 2))
        tilt = F.when(F.col("miss") <= TOLERANCE, F.col("tilt")).when(
            inside, F.col("step")).otherwise(F.coalesce(other, F.col("tilt")))
        state = stored(t.select("sid", "target", "mean", "full", tilt.alias("tilt"), "low", "high",
                                "miss"), "tilts")
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select("sid", "tilt", "mean", "full")


def _largest_first(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["size", "doc_id"], ascending=[False, True], na_position="last")


def _rounded(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole copies of one slice, or of a source's giants (slice -1), largest documents first."""
    rows = _largest_first(rows)
    giants = rows["slice"].iloc[0] == -1
    carry, copies = 0.0, []
    lacking, others = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
    for size, n, rate in zip(rows["size"], rows["n"], rows["rate"]):
        words = size * n
        want = rate * words + carry
        c = min(max(round(want / words), 0), MAX_COPIES) if size else 0
        if giants:
            others -= words

            def badness(c):
                rest = lacking - c * words
                return max(-rest, rest - MAX_COPIES * others, 0.0), abs(want - c * words), c

            c = min(range(MAX_COPIES + 1), key=badness)
            lacking -= c * words
        carry = want - c * words
        copies.append(c)
    return rows.assign(copies=copies)[["doc_id", "sid", "slice", "size", "copies", "n"]]


def _adjusted(rows: pd.DataFrame) -> pd.DataFrame:
    """The slice with `share` words more (less, if negative), as near as it gets."""
    rows = _largest_first(rows)
    left, copies = float(rows["share"].iloc[0]), []
    for size, n, c in zip(rows["size"], rows["n"], rows["copies"]):
        more = min(max(round(left / (size * n)), -c), MAX_COPIES - c) if size else 0
        left -= more * size * n
        copies.append(c + more)
    return rows.assign(copies=copies)[["doc_id", "sid", "slice", "size", "copies", "n"]]


def whole_copies(rates: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, sid, size, copies, n) for (doc_id, sid, size, n, rate) and (sid, source_size,
    docs, target)."""
    words = F.col("size") * F.col("n")
    slices = F.ceil(F.col("docs") / SLICE_DOCS)
    cut = rates.join(sources.select("sid", "source_size", "docs", "target"), "sid").withColumn(
        "slice", F.when(words * GIANTS > F.col("source_size"), F.lit(-1)).otherwise(
            F.pmod(F.xxhash64("doc_id", "size"), slices)).cast("long")).drop("docs")
    first = stored(cut.groupBy("sid", "slice").applyInPandas(_rounded, COPIES), "copies")
    given = (first.groupBy("sid", "slice").agg(
        F.sum(F.col("copies") * words).alias("taken"), F.sum(words).alias("words")))
    room = F.when(F.col("slice") >= 0, MAX_COPIES * F.col("words") - F.col("taken"))
    there = F.when(F.col("slice") >= 0, F.col("taken"))
    misses = given.groupBy("sid").agg(
        F.sum("taken").alias("all_taken"), F.sum(room).alias("all_room"), F.sum(there).alias("all_there")
    ).join(sources.select("sid", "target"), "sid").withColumn("miss", F.col("target") - F.col("all_taken"))
    part = F.when(F.col("miss") > 0, F.least("miss", "all_room") * room / F.nullif(F.col("all_room"), F.lit(0)))
    part = part.otherwise(F.greatest(F.col("miss"), -F.col("all_there")) * there / F.nullif(F.col("all_there"), F.lit(0)))
    shares = given.join(misses, "sid").select("sid", "slice", F.coalesce(part, F.lit(0.0)).alias("share"))
    return first.join(shares, ["sid", "slice"]).groupBy("sid", "slice").applyInPandas(
        _adjusted, COPIES).drop("slice")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sid, size, copies, n) of every case, and (source, sid, source_size, docs,
    target)."""
    sizes = stored(sized(docs), "sizes")
    sources = stored(with_targets(ranked_sources(sizes), weights), "targets")
    keyed = sizes.join(sources.select(F.col("source").alias("of"), "sid"),
                       F.col("source").eqNullSafe(F.col("of"))).drop("source", "of")
    histogram = stored(keyed.where("size > 0").groupBy("sid", "size").agg(
        F.sum("n").alias("n")), "size-histogram")
    tilts = solve_rates(histogram, sources)
    rate = F.when(F.col("full"), F.lit(float(MAX_COPIES))).otherwise(
        F.least(F.exp(F.col("tilt") * F.col("size") / F.col("mean")), F.lit(float(MAX_COPIES))))
    rates = keyed.join(tilts, "sid").select("doc_id", "sid", "size", "n", rate.alias("rate"))
    return whole_copies(rates, sources), sources


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row."""
    copies, sources = mix(docs)
    return (copies.join(sources.drop("docs"), "sid")
            .withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it."""
    copies, sources = mix(docs)
    cases = copies.where("copies > 0").join(sources.select("source", "sid"), "sid").select(
        F.col("doc_id").alias("case_id"), F.col("source").alias("case_source"),
        F.col("size").alias("case_size"), "copies")
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       docs["doc_id"].alias("id"), docs["source"].alias("src"), size.alias("size"))
    found = rows.join(cases, F.col("id").eqNullSafe(F.col("case_id"))
                      & F.col("src").eqNullSafe(F.col("case_source"))
                      & (F.col("size") == F.col("case_size")))
    return found.select("row", F.explode(F.expr("sequence(1, copies)"))).select("row.*")
