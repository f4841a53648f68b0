"""Repair of reads: what to search, which walks to believe, what to change.

One row per read all the way; searching is left to a `Searcher`, so the same
plan runs against shipped k-mers (no shuffle at all) or against a solid-k-mer
table that is joined (no size bound). Three kinds of work:

* `gap`   between two regions, walked to the right;
* `end3`  from the last region to the end, walked to the right;
* `end5`  from the first region to the start: an `end3` of the reverse
  complement, turned back afterwards;
* `whole` for reads without usable regions: candidates for the first k-mer,
  each walked to the end of the read.

Input columns: seq (normalized), qual, len, qv (array<int>), low, regions,
by_region, flags, max_trim, check_len.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmend import config as C
from readmend.functions.bases import reverse_complement
from readmend.functions.probes import (
    any_walk, solid_changes, solid_flags, solid_flags_each, solid_walks)

_EDIT = "struct<pos:int,base:string>"
_NO_EDITS = f"cast(array() as array<{_EDIT}>)"
_EDIT_LISTS = f"array<array<{_EDIT}>>"
_NO_LISTS = f"cast(array() as {_EDIT_LISTS})"


class Searcher(Protocol):
    """How columns of a frame are tested against the solid k-mers."""

    def test(self, df: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
        """Adds columns {name: (kind of test, input column)}; the kinds are
        those of `readmend.functions.probes`: flags, flags_each, changes, walks,
        exists."""


_TESTS = {"flags": solid_flags, "flags_each": solid_flags_each, "changes": solid_changes,
          "walks": solid_walks, "exists": any_walk}


@dataclass(frozen=True)
class ShippedSearcher:
    """Tests inside the tasks against data on every executor. Tests asked for
    together run in one Python pass."""

    members: object

    def test(self, df, wanted):
        return df.withColumns({
            name: _TESTS[kind](self.members, F.col(column))
            for name, (kind, column) in wanted.items()})


# --- candidates for the first k-mer -------------------------------------------

def with_first_kmer_spots(df: DataFrame, k: int, compat: str = "intended") -> DataFrame:
    """`first_kmer`: struct<kmer, spots> for reads repaired as a whole, else
    null. The spots are the low bases of the first k-mer if there are one to
    three, else its three bases of lowest score."""
    low_here = f"filter(low, p -> p < {k})"

    def by_quality(count: str) -> str:
        return (f"transform(array_sort(transform(sequence(0, {count} - 1), "
                "p -> named_struct('q', element_at(qv, p + 1), 'p', p))), x -> x.p)")

    # the scalar rule sorts only as many positions as there are low bases
    many = by_quality(f"size({low_here})") if compat == "scalar" else by_quality(str(k))
    return df.withColumn("_n_low", F.expr(f"size({low_here})")).withColumn(
        "first_kmer", F.expr(
            "case when by_region then null else named_struct("
            f"'kmer', substring(seq, 1, {k}), 'spots', case "
            f"when _n_low = 0 then slice({by_quality(str(k))}, 1, {C.LOW_BASES_IN_COMBOS}) "
            f"when _n_low <= {C.LOW_BASES_IN_COMBOS} then {low_here} "
            f"else slice({many}, 1, {C.LOW_BASES_IN_COMBOS}) end) end"))


def with_first_kmer_candidates(df: DataFrame, searcher: Searcher, k: int) -> DataFrame:
    """`candidates`: array<array<edit>> of solid first k-mers, in search order.

    Without low bases a solid k-mer stands as it is. With one to three the
    combinations decide, and single changes only follow if none is solid.
    """
    df = searcher.test(df, {"_solid": ("changes", "first_kmer")})
    edits = (
        f"transform(filter(sequence(0, {k - 1}), p -> substring(v.kmer, p + 1, 1) <> "
        "substring(first_kmer.kmer, p + 1, 1)), p -> named_struct('pos', p, 'base', "
        "substring(v.kmer, p + 1, 1)))"
    )
    taken = (
        "case when _n_low = 0 and exists(_solid, v -> v.group = 2) "
        "then filter(_solid, v -> v.group = 2) "
        "when _n_low = 0 then filter(_solid, v -> v.group < 2) "
        f"when _n_low <= {C.LOW_BASES_IN_COMBOS} and exists(_solid, v -> v.group = 0) "
        "then filter(_solid, v -> v.group = 0) "
        f"when _n_low <= {C.LOW_BASES_IN_COMBOS} then filter(_solid, v -> v.group = 1) "
        "else _solid end"
    )
    return df.withColumn("candidates", F.expr(
        f"case when first_kmer is null then null else transform({taken}, v -> {edits}) end")
    ).drop("_solid", "first_kmer", "_n_low")


# --- what to search ----------------------------------------------------------------

def _task(kind: str, i: str, p0: str, ctx: str, own: str, forced: str, edits: str,
          s: str, e: str) -> str:
    return (f"named_struct('kind', '{kind}', 'i', cast({i} as int), 'p0', cast({p0} as int), "
            f"'s', cast({s} as int), 'e', cast({e} as int), "
            f"'ctx', {ctx}, 'own', {own}, 'forced', {forced}, 'edits', {edits})")


def with_tasks(df: DataFrame, k: int, extremely_low: int) -> DataFrame:
    """`tasks`: array of searches. `p0` is the first base searched (counted on
    the reverse complement for end5), `ctx` the k-1 bases before it, `own` the
    read's bases from there on, `forced` marks bases where all four are tried,
    `edits` the changes already made to the context."""

    def forced(first: str, to: str, also: str) -> str:
        return (f"array_join(transform(sequence({first}, {to}), p -> if({also} or "
                f"element_at(qv, p + 1) <= {extremely_low}, '1', '0')), '')")

    a, b = "get(regions, i - 1)", "get(regions, i)"
    s, e = f"({a}.last + 1)", f"({b}.first - 1)"
    first = f"({s} + {k - 1})"
    gap_marks = (f"p = {first} or p = {a}.olast + {k - 2} or p = {b}.ofirst + {k - 2}")
    gap = _task("gap", "i", first, f"substring(seq, {s} + 1, {k - 1})",
                f"substring(seq, {first} + 1, {e} - {first} + 1)",
                forced(first, e, gap_marks), _NO_EDITS, s, e)
    gaps = (f"case when size(regions) < 2 then array() else "
            f"transform(filter(sequence(1, size(regions) - 1), "
            f"i -> {b}.first - {a}.last - 1 >= {k}), i -> {gap}) end")

    f0 = "get(regions, 0)"
    s5 = f"({f0}.first - 1)"
    mirrored = (f"array_join(transform(sequence({s5}, 0), p -> if(p = {s5} or "
                f"p = {f0}.ofirst - 1 or element_at(qv, p + 1) <= {extremely_low}, "
                "'1', '0')), '')")
    end5 = _task("end5", "0", f"len - 1 - {s5}", f"substring(rc, len - {s5} - {k - 1}, {k - 1})",
                 f"substring(rc, len - {s5}, {s5} + 1)", mirrored, _NO_EDITS, s5, "0")
    ends5 = f"if({f0}.first > 0, array({end5}), array())"

    z = "get(regions, size(regions) - 1)"
    s3 = f"({z}.last + 1)"
    p3 = f"({s3} + {k - 1})"
    end3 = _task("end3", "size(regions) - 1", p3, f"substring(seq, {s3} + 1, {k - 1})",
                 f"substring(seq, {p3} + 1, len - {p3})",
                 forced(p3, "len - 1", f"p = {p3} or p = {z}.olast + {k}"),
                 _NO_EDITS, s3, "len - 1")
    ends3 = f"if({z}.last < len - {k}, array({end3}), array())"

    changed = (f"aggregate(c, substring(seq, 1, {k}), "
               "(t, x) -> overlay(t placing x.base from x.pos + 1))")
    whole = _task("whole", "i", str(k), f"substring({changed}, 2, {k - 1})",
                  f"substring(seq, {k + 1}, len - {k})",
                  forced(str(k), "len - 1", "false").replace(
                      "if(false or", f"if(p > {k} and"), "c", "1", "len - 1")
    wholes = (f"case when candidates is null or len <= {k} then array() "
              f"else transform(candidates, (c, i) -> {whole}) end")
    return (
        df.withColumn("rc", reverse_complement(F.col("seq")))
        .withColumn("tasks", F.expr(
            f"case when by_region then concat({gaps}, {ends5}, {ends3}) else {wholes} end"))
        .drop("rc")
    )


# --- searching and checking ----------------------------------------------------------

def with_walks(df: DataFrame, searcher: Searcher, k: int, max_extension: int) -> DataFrame:
    """`found`: per task the believable edit lists.

    Struct fields: kind, i, p0, s, e, given_up (too many walks), as_is (some
    walk changes nothing), lists (array<array<edit>>, positions as in `p0`).

    Columns made by a test are handed to higher-order functions as arguments
    and never named inside a lambda body: the optimizer may put the test in
    place of the name, and a test cannot run inside a lambda. Their inputs
    are read again afterwards, which keeps both in the step they were put in.
    """
    df = df.withColumn("_search", F.expr(
        "transform(tasks, t -> named_struct('ctx', t.ctx, 'own', t.own, 'forced', t.forced))"))
    # a candidate whose change is near the start must extend to the left
    smallest = "get(t.edits, 0).pos"
    left = (
        f"transform(tasks, t -> if(t.kind = 'whole' and size(t.edits) > 0 and "
        f"{smallest} < {k - 1}, named_struct('ctx', "
        "reverse(translate(concat(substring(aggregate(t.edits, substring(seq, 1, 1), "
        "(b, x) -> if(x.pos = 0, x.base, b)), 1, 1), left(t.ctx, "
        f"{k - 2})), 'ACGT', 'TGCA')), "
        f"'steps', least({max_extension}, {k - 1} - {smallest})), "
        "named_struct('ctx', '', 'steps', 0)))"
    )
    df = searcher.test(df.withColumn("_left", F.expr(left)), {
        "_walks": ("walks", "_search"), "_left_ok": ("exists", "_left")})
    edits = (
        "concat(z.tasks.edits, transform(filter(sequence(0, length(z.tasks.own) - 1), "
        "u -> substring(w, u + 1, 1) <> substring(z.tasks.own, u + 1, 1)), "
        "u -> named_struct('pos', z.tasks.p0 + u, 'base', substring(w, u + 1, 1))))"
    )
    walks = ("transform(coalesce(z._walks, cast(array() as array<string>)), "
             f"w -> named_struct('walk', w, 'edits', {edits}))")
    df = df.withColumn("_t", F.expr(
        "transform(filter(arrays_zip(tasks, _search, _walks, _left, _left_ok), "
        "z -> z._left.steps = 0 or z._left_ok), z -> named_struct('t', z.tasks, "
        f"'given_up', z._walks is null, 'walks', {walks}))"))
    # what has to hold past the last change: at an end, some extension outside
    # the read; in a gap, most k-mers up to that change
    flat = "flatten(transform(_t, x -> transform(x.walks, y -> {inner})))"
    last = "get(y.edits, size(y.edits) - 1).pos"
    bases = "concat(x.t.ctx, y.walk)"
    outside = (
        f"if(x.t.kind <> 'gap' and size(y.edits) > 0 and {last} > len - {k}, "
        f"named_struct('ctx', right({bases}, {k - 1}), "
        f"'steps', least({max_extension}, {k} - (len - {last}))), "
        "named_struct('ctx', '', 'steps', 0))"
    )
    past = (
        f"if(x.t.kind = 'gap' and size(y.edits) > 0 and {last} > x.t.e - {k - 1}, "
        f"concat(right({bases}, {k}), "
        f"substring(seq, x.t.e + 2, {last} + {k - 1} - x.t.e)), '')"
    )
    df = df.withColumn("_outside", F.expr(flat.format(inner=outside))).withColumn(
        "_past", F.expr(flat.format(inner=past)))
    df = searcher.test(df, {
        "_outside_ok": ("exists", "_outside"), "_past_flags": ("flags_each", "_past")})
    df = df.withColumn("_valid", F.expr(
        "transform(arrays_zip(_outside, _outside_ok, _past, _past_flags), z -> "
        "(z._outside.steps = 0 or z._outside_ok) and (z._past = '' or "
        f"length(replace(z._past_flags, '1', '')) <= {C.ALLOWED_FAILS}))"))
    # lists of task m start at the number of walks of the tasks before it
    start = "aggregate(slice(_t, 1, m), 0, (c, z) -> c + size(z.walks))"
    lists = ("transform(filter(transform(x.walks, (y, n) -> named_struct('edits', y.edits, "
             f"'ok', get(v, get(at, 0) + n))), y -> y.ok and size(y.edits) > 0), "
             "y -> y.edits)")
    found = (
        "named_struct('kind', x.t.kind, 'i', x.t.i, 'p0', x.t.p0, 's', x.t.s, 'e', x.t.e, "
        "'given_up', x.given_up, 'as_is', exists(x.walks, y -> size(y.edits) = 0), "
        f"'lists', flatten(transform(array(array({start})), at -> {lists})))"
    )
    return df.withColumn("found", F.expr(
        f"flatten(transform(array(_valid), v -> transform(_t, (x, m) -> {found})))")).drop(
        "_search", "_walks", "_left", "_left_ok", "_t", "_outside", "_past",
        "_outside_ok", "_past_flags", "_valid", "tasks")


# --- choosing ------------------------------------------------------------------------

_DECISION = ("struct<kind:string,i:int,act:int,t5:int,t3:int,edits:array<" + _EDIT + ">,"
             "common:array<" + _EDIT + ">,disputed:array<int>>")


def with_decisions(df: DataFrame, k: int) -> DataFrame:
    """`decisions`: per task what to do to the read.

    act: 0 nothing, 1 apply `edits`, 2 settle on what all lists agree on.
    t5/t3: trims to set, null where unchanged.
    """
    # all lists of a whole-read repair compete; a given-up candidate voids them
    merged = (
        "case when by_region or size(found) = 0 then found else array(named_struct("
        "'kind', 'whole', 'i', 0, 'p0', 0, 's', 1, 'e', len - 1, "
        "'given_up', exists(found, x -> x.given_up), 'as_is', false, "
        f"'lists', if(exists(found, x -> x.given_up), {_NO_LISTS}, "
        "flatten(transform(found, x -> x.lists))))) end"
    )
    # end5: from mirrored positions to the read's; walks were found in the
    # order of the complement, which matters for ties only
    turned = (
        "transform(x.lists, l -> reverse(transform(l, e -> named_struct('pos', "
        "cast(len - 1 - e.pos as int), 'base', translate(e.base, 'ACGT', 'TGCA')))))"
    )
    score = "aggregate(l, 0, (q, e) -> q + element_at(qv, e.pos + 1))"
    df = df.withColumn("_all", F.expr(merged)).withColumn("_all", F.expr(
        "transform(_all, x -> named_struct('kind', x.kind, 'i', x.i, 's', x.s, 'e', x.e, "
        f"'as_is', x.as_is, 'lists', if(x.kind = 'end5', {turned}, x.lists)))"))
    df = df.withColumn("_scored", F.expr(
        "transform(_all, x -> named_struct('x', x, 'q', "
        f"transform(x.lists, l -> cast({score} as int))))"))
    # lowest sum; of equals the last found. end5 walks were found from T to A at
    # the base next to the region, so the last in read order is the first there.
    best = ("if(y.x.kind = 'end5', array_position(y.q, array_min(y.q)) - 1, "
            "size(y.q) - array_position(reverse(y.q), array_min(y.q)))")
    gap_right = "get(array_sort(y.q), 1) - array_min(y.q)"
    df = df.withColumn("_scored", F.expr(
        "transform(_scored, y -> named_struct('x', y.x, 'n', size(y.q), "
        f"'best', if(size(y.q) = 0, {_NO_EDITS}, get(y.x.lists, cast({best} as int))), "
        f"'margin', if(size(y.q) > 1, {gap_right}, 0)))"))

    w = C.MAX_EDITS_IN_WINDOW
    pos = "get(y.best, {j}).pos"
    n = "size(y.best)"
    forward = (f"get(filter(sequence(0, {n} - {w + 1}), j -> "
               f"{pos.format(j=f'j + {w}')} - {pos.format(j='j')} < check_len), 0)")
    backward = (f"get(filter(sequence({n} - 1, {w}), j -> "
                f"{pos.format(j='j')} - {pos.format(j=f'j - {w}')} < check_len), 0)")
    first, last = pos.format(j="0"), pos.format(j=f"{n} - 1")
    left_of, right_of = "get(regions, y.x.i - 1)", "get(regions, y.x.i)"
    left_long = f"y.x.s - {left_of}.first > {w}"
    right_long = f"{right_of}.last - y.x.e + 2 > {w}"
    two = "y.x.kind = 'gap' and size(regions) = 2"
    # index of the edit where too many follow one another, by the side it is met from
    crowded = (
        f"case when {n} <= {w} then null "
        f"when y.x.kind in ('end3', 'whole') and len - {first} >= check_len then {forward} "
        f"when y.x.kind = 'end5' and {last} + 1 >= check_len then {backward} "
        f"when {two} and {left_long} and not {right_long} "
        f"and {last} - {k} - y.x.s + 2 >= check_len then {backward} "
        f"when {two} and not {left_long} and {right_long} "
        f"and y.x.e - {first} + 1 >= check_len then {forward} end"
    )
    df = df.withColumn("_scored", F.expr(
        "transform(_scored, y -> named_struct('x', y.x, 'n', y.n, 'best', y.best, "
        f"'margin', y.margin, 'right_gap', {two} and {right_long}, 'crowded', {crowded}))"))

    at = "get(y.best, y.crowded).pos"
    cut3 = f"if(len - {at} <= max_trim, len - {at}, null)"
    cut5 = f"if({at} + 1 <= max_trim, {at} + 1, null)"
    # trims set by crowding: the far end first, for end5 the near end first
    is5 = "y.x.kind = 'end5'"
    crowd3 = f"if({is5}, if({cut5} is null, {cut3}, null), {cut3})"
    crowd5 = f"if({is5}, {cut5}, if({cut3} is null, {cut5}, null))"
    before = "slice(y.best, 1, greatest(y.crowded - 1, 0))"
    after = f"slice(y.best, y.crowded + 2, greatest({n} - y.crowded - 1, 0))"
    after5 = f"slice(y.best, y.crowded + 3, greatest({n} - y.crowded - 2, 0))"
    before5 = "slice(y.best, 1, y.crowded)"
    partial = (
        f"case when y.right_gap then {_NO_EDITS} "
        f"when {is5} and {cut5} is not null then {after5} "
        f"when {is5} and {cut3} is not null then {before5} "
        f"when {is5} then {_NO_EDITS} "
        f"when {cut3} is not null then {before} when {cut5} is not null then {after} "
        f"else {_NO_EDITS} end"
    )
    # nothing found in a gap: the first of four trims that fits
    ol, orr = f"{left_of}.olast - 1", f"{right_of}.ofirst - 1"
    fits = [(3, f"len - (y.x.s + {k - 1})"), (5, "y.x.e + 1"),
            (3, f"len - ({ol} + {k - 1})"), (5, f"{orr} + 1")]
    lost3 = "case " + " ".join(
        f"when {v} <= max_trim then {v if side == 3 else 'null'}" for side, v in fits) + " end"
    lost5 = "case " + " ".join(
        f"when {v} <= max_trim then {v if side == 5 else 'null'}" for side, v in fits) + " end"
    lost = "y.n = 0 and y.x.kind = 'gap'"
    common = common_edits("y.x.lists")
    decision = (
        "named_struct('kind', y.x.kind, 'i', y.x.i, "
        f"'act', case when y.x.as_is or y.n = 0 then 0 when y.n = 1 then 1 "
        f"when y.crowded is null and y.margin >= {C.MIN_QUALITY_GAP} then 1 else 2 end, "
        f"'t5', cast(case when y.x.as_is then null when {lost} then {lost5} "
        f"when y.crowded is not null then {crowd5} end as int), "
        f"'t3', cast(case when y.x.as_is then null when {lost} then {lost3} "
        f"when y.crowded is not null then {crowd3} end as int), "
        f"'edits', if(y.n = 1 and y.crowded is not null, {partial}, y.best), "
        f"'common', if(y.n > 1, {common}, {_NO_EDITS}), "
        f"'disputed', if(y.n > 1, {touched_positions('y.x.lists')}, cast(array() as array<int>)))"
    )
    df = df.withColumn("decisions", F.expr(f"transform(_scored, y -> {decision})"))
    return df.withColumn("decisions", F.expr(
        "transform(decisions, d -> named_struct('kind', d.kind, 'i', d.i, 'act', d.act, "
        "'t5', d.t5, 't3', d.t3, 'edits', d.edits, 'common', d.common, "
        f"'disputed', {disputed_positions('d.disputed', 'd.common')}))"
    )).drop("_all", "_scored", "found")


def common_edits(lists: str) -> str:
    """What all lists of edits share. Edits are compared as text, the base last: Spark intersects arrays of
    structs by comparing each with each."""
    texts = f"transform({lists}, l -> transform(l, e -> concat(e.pos, e.base)))"
    return (f"get(transform(array({texts}), t -> transform("
            "aggregate(slice(t, 2, size(t)), get(t, 0), (c, l) -> array_intersect(c, l)), "
            "x -> named_struct('pos', cast(left(x, length(x) - 1) as int), 'base', right(x, 1)))), 0)")


def touched_positions(lists: str) -> str:
    return f"array_distinct(flatten(transform({lists}, l -> transform(l, e -> e.pos))))"


def disputed_positions(touched: str, common: str) -> str:
    return f"array_sort(array_except({touched}, transform({common}, e -> e.pos)))"


# --- carrying out --------------------------------------------------------------------

def trim_disputed(t5: str, t3: str, disputed: str, always: str) -> str:
    """Trim inward over disputed positions, the nearer end first, while the
    budget lasts; struct with t5 and t3."""
    left, right = "get(disp, s.l)", "get(disp, s.r)"
    need5, need3 = f"({left} + 1)", f"(len - {right})"
    take_left = f"{need5} < {need3}"
    fits = f"if({take_left}, {need5} + s.t3 <= max_trim, {need3} <= max_trim)"
    step = (
        f"if(not s.go or not {fits}, named_struct('l', s.l, 'r', s.r, 't5', s.t5, 't3', s.t3, "
        "'go', false), named_struct("
        f"'l', if({take_left}, s.l + 1, s.l), 'r', if({take_left}, s.r, s.r - 1), "
        f"'t5', if({take_left} and ({need5} > s.t5 or {always}), {need5}, s.t5), "
        f"'t3', if(not {take_left} and ({need3} > s.t3 or {always}), {need3}, s.t3), "
        "'go', s.l < s.r))"
    )
    return (
        f"get(transform(array({disputed}), disp -> aggregate(disp, "
        f"named_struct('l', 0, 'r', size(disp) - 1, 't5', {t5}, 't3', {t3}, "
        f"'go', size(disp) > 0), (s, unused) -> {step})), 0)"
    )


def with_outcome(df: DataFrame, k: int) -> DataFrame:
    """`edits`, `trim5`, `trim3`: decisions carried out in order, each skipped
    if its place has been trimmed away."""
    a, b = "get(regions, d.i - 1)", "get(regions, d.i)"
    skip = (
        f"case d.kind when 'gap' then not ({a}.last + {k} < len - o.t3 and {b}.first > o.t5) "
        "when 'end5' then not (get(regions, 0).first > o.t5) "
        f"when 'end3' then not ({b}.last + {k} < len - o.t3) else false end"
    )
    t5, t3 = "coalesce(d.t5, o.t5)", "coalesce(d.t3, o.t3)"
    settled = trim_disputed(t5, t3, "d.disputed", "d.kind = 'whole'")
    settle = (
        f"get(transform(array({settled}), z -> named_struct('t5', z.t5, 't3', z.t3, 'edits', "
        "concat(o.edits, filter(d.common, e -> e.pos >= z.t5 and e.pos < len - z.t3)))), 0)"
    )
    carried = (
        f"case when {skip} then o when d.act = 2 then {settle} else named_struct("
        f"'t5', {t5}, 't3', {t3}, 'edits', "
        "if(d.act = 1, concat(o.edits, d.edits), o.edits)) end"
    )
    df = df.withColumn("_o", F.expr(
        "aggregate(decisions, named_struct('t5', 0, 't3', 0, 'edits', "
        f"{_NO_EDITS}), (o, d) -> {carried})"))
    # nothing repaired: trim to the regions, or past the first k-mer
    nothing = ("case when by_region then size(_o.edits) = 0 and _o.t5 = 0 and _o.t3 = 0 "
               "else not exists(decisions, d -> d.act > 0) end")
    f0 = "get(regions, 0).first"
    tail = f"len - {k} - x.last"
    to_regions5 = f0
    to_regions3 = (f"coalesce(get(transform(filter(regions, x -> {f0} + {tail} <= max_trim), "
                   f"x -> {tail}), 0), _o.t3)")
    return df.withColumn("trim5", F.expr(
        f"cast(case when not ({nothing}) then _o.t5 when size(regions) > 0 then {to_regions5} "
        f"when {k} < max_trim then {k} else _o.t5 end as int)")).withColumn("trim3", F.expr(
            f"cast(case when not ({nothing}) then _o.t3 when size(regions) > 0 then "
            f"{to_regions3} else _o.t3 end as int)")).withColumn(
        "edits", F.col("_o.edits")).drop("_o", "decisions")


def repaired(df: DataFrame, searcher: Searcher, k: int, extremely_low: int,
             max_extension: int, compat: str = "intended") -> DataFrame:
    """The whole repair of reads that have `regions` and `by_region`."""
    df = with_first_kmer_spots(df, k, compat)
    df = with_first_kmer_candidates(df, searcher, k)
    df = with_tasks(df, k, extremely_low)
    df = with_walks(df, searcher, k, max_extension)
    return with_outcome(with_decisions(df, k), k)
