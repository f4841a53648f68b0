"""The same results as `catalog`, in SQL over the same tables."""

from __future__ import annotations

from readmend.plans.catalog import K
from readmend.plans.repair_sql import CORRECTION, PROFILE, REGIONS
from readmend.sources.documents import (
    LETTER_BASES, LETTER_QUALITIES, LETTERS, PAIRS_PER_TEXT, READ_LETTERS, STRIDE)

_PAIRS = f"""
d as (select doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') t from documents),
dw as (select doc_id * {PAIRS_PER_TEXT} + j pair_id,
        substr(t, j * {READ_LETTERS} + 1, {READ_LETTERS}) w1,
        substr(t, j * {READ_LETTERS} + {STRIDE + 1}, {READ_LETTERS}) w2a
      from (select doc_id, t, unnest(generate_series(0, (length(t) - 1) // {READ_LETTERS})) j
            from d where length(t) > 0)),
dp as (select pair_id, w1, case when w2a = '' then w1 else w2a end w2 from dw),
pairs as (select pair_id,
        translate(w1, '{LETTERS}', '{LETTER_BASES}') seq1,
        translate(reverse(w1), '{LETTERS}', '{LETTER_QUALITIES}') qual1,
        reverse(translate(upper(translate(w2, '{LETTERS}', '{LETTER_BASES}')),
                          'ACGT', 'TGCA')) seq2,
        translate(w2, '{LETTERS}', '{LETTER_QUALITIES}') qual2 from dp),
reads as (select pair_id * 2 read_id, pair_id, 1 mate, seq1 seq, qual1 qual from pairs
          union all
          select pair_id * 2 + 1, pair_id, 2, seq2, qual2 from pairs)"""

_HIST = """
chars as (select unnest(string_split(qual, '')) c from reads),
qhist as (select cast(ascii(c) as int) code, count(*) n from chars where c <> '' group by 1),
qrange as (select min(code) min_code, max(code) max_code from qhist)"""


def _offsets(sure: int, top: int, unsure: int, unsure_top: int) -> str:
    return f"""
qoff as (select min_code, max_code,
    case when min_code < 33 then null
         when min_code <= {sure} then case when max_code <= {top} then 33 end
         when min_code <= {unsure} then case when max_code <= {unsure_top} then 33 else 64 end
         else 64 end as "offset" from qrange),
qnote as (select *, case when "offset" is null then 'error'
    when min_code > {sure} and min_code <= {unsure} and max_code <= {unsure_top}
    then 'hard to tell' else 'ok' end as note from qoff)"""


_PAIRED, _SINGLE = _offsets(58, 78, 75, 75), _offsets(58, 74, 74, 74)

_NORM = f"""
norm as (select read_id, pair_id, mate, qual, length(seq) len,
    regexp_replace(upper(seq), '[^ACGT]', 'A', 'g') seq,
    length(regexp_replace(upper(seq), '[ACGT]', '', 'g')) n_count from reads),
gated as (select *, n_count <= len * 10 // 100 and len >= {K} as gate,
    case when len <= 30 then 0 else least(len * 60 // 100, len - 30) end as max_trim,
    len * 7 // 100 as check_len from norm)"""


def _counts(k: int = K) -> str:
    return f"""
wins as (select mate, pos, substr(s, pos + 1, {k}) kmer from (
    select mate, upper(seq) s, unnest(generate_series(0, length(seq) - {k})) pos
    from reads where length(seq) >= {k})),
occ as (select least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) kmer from wins
        where not regexp_matches(kmer, '[^ACGT]')),
kc as (select kmer, count(*) n from occ group by 1 having count(*) >= 2)"""


_SPECTRUM = _counts() + """,
khist0 as (select cast(least(n, 255) as int) o, count(*) c from kc group by 1),
khist as (select cast(r.o as int) occ, coalesce(c, 0) n_kmers
          from (select unnest(generate_series(2, 255)) o) r left join khist0 using (o)),
kthr as (select cast(min(occ) - 1 as int) threshold from (
    select occ, n_kmers, lag(n_kmers) over (order by occ) prev from khist)
    where n_kmers > prev and occ < 255),
solid as materialized (select kmer from kc, kthr where n >= threshold),
nsolid as (select cast(coalesce(sum(n_kmers), 0) as bigint) n_solid
           from khist, kthr where occ >= threshold)"""

_KMERS_OF = f"""
rk as (select read_id, pos, least(km, reverse(translate(km, 'ACGT', 'TGCA'))) kmer from (
    select read_id, pos, substr(seq, pos + 1, {K}) km from (
        select read_id, seq, unnest(generate_series(0, len - {K})) pos from gated where gate)))"""

_FLAGS = _KMERS_OF + """,
rf as (select read_id, pos, case when s.kmer is null then 0 else 1 end f
       from rk left join solid s using (kmer)),
isl0 as (select read_id, pos, f, pos - row_number() over (partition by read_id, f order by pos) g
         from rf),
isl as (select read_id, cast(min(pos) as int) "first", cast(max(pos) as int) "last"
        from isl0 where f = 1 group by read_id, g)"""

_NEAR = """
long as (select * from isl where "last" - "first" + 1 >= 2),
brk as (select *, case when "first" - lag("last") over w < 3 then 0 else 1 end b
        from long window w as (partition by read_id order by "first")),
grp as (select *, sum(b) over (partition by read_id order by "first") g from brk)"""

_SETS = """
ed as (select pair_id, i - 1 pos,
        case when i <= least(length(s), length(x)) and substr(s, i, 1) <> substr(x, i, 1)
             then substr(x, i, 1) end a,
        case when i <= least(length(s), length(y)) and substr(s, i, 1) <> substr(y, i, 1)
             then substr(y, i, 1) end b
    from (select pair_id, upper(seq1) s, seq2 x, reverse(seq2) y,
                 unnest(generate_series(1, length(seq1))) i from pairs)),
pset as (select pair_id,
        cast(count(*) filter (where a = b) as int) n_common,
        cast(count(*) filter (where a is not null or b is not null) as int) n_union,
        coalesce(string_agg(cast(pos as varchar), ',' order by pos)
          filter (where (a is not null or b is not null) and a is distinct from b), '') disputed
    from ed group by 1)"""


_TRIMS = """
dt as (select pair_id, length(seq1) n,
        case when length(seq1) <= 30 then 0
             else least(length(seq1) * 60 // 100, length(seq1) - 30) end m,
        case when disputed = '' then cast([] as int[])
             else list_transform(string_split(disputed, ','), lambda x: cast(x as int)) end pos
    from pairs join pset using (pair_id)),
st(pair_id, n, m, pos, l, r, t5, t3, go, step) as (
    select pair_id, n, m, pos, 1, len(pos), 0, 0, len(pos) > 0, 0 from dt
    union all
    select pair_id, n, m, pos, case when a < b then l + 1 else l end,
        case when a < b then r else r - 1 end,
        case when a < b then greatest(a, t5) else t5 end,
        case when a < b then t3 else greatest(b, t3) end, l < r, step + 1
    from (select *, pos[l] + 1 a, n - pos[r] b from st where go)
    where case when a < b then a + t3 <= m else b <= m end)"""


def _q(select: str, *parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",".join((_PAIRS, *parts)) + "\n" + select


_CUTS = """
cum as (select code, "offset", note, sum(n) over (order by code) upto,
        sum(case when code between "offset" and "offset" + 41 then n else 0 end) over () total
        from qhist, qnote where code <= 126),
shr as (select *, upto / total share from cum)"""

_WALK = f"""
ends as (select g.read_id, len, seq, min(i."last") + {K} p from gated g
         join (select read_id, "last", row_number() over (partition by read_id order by "first") rn
               from isl) i on g.read_id = i.read_id and rn = 1
         where gate group by g.read_id, len, seq having min(i."last") + {K} < len),
base(b) as (values ('A'), ('C'), ('G'), ('T')),
walk(read_id, p, len, seq, t, tail, path) as (
    select read_id, p, len, seq, 0, substr(seq, p - {K - 2}, {K - 1}), '' from ends
    union all
    select read_id, p, len, seq, t + 1, substr(km, 2), path || b from (
        select w.*, b, tail || b km,
            max(case when b = substr(w.seq, p + t + 1, 1) then 1 else 0 end)
              over (partition by read_id, path) own_ok
        from walk w cross join base b
        join solid s on s.kmer = least(tail || b, reverse(translate(tail || b, 'ACGT', 'TGCA')))
        where p + t < len)
    where t = 0 or own_ok = 0 or b = substr(seq, p + t + 1, 1))"""

_OUTSIDE = f"""
base(b) as (values ('A'), ('C'), ('G'), ('T')),
ext(read_id, t, tail) as (
    select read_id, 0, right(seq, {K - 1}) from gated where gate
    union
    select read_id, t + 1, substr(tail || b, 2) from ext, base, solid s
    where t < 5 and s.kmer = least(tail || b, reverse(translate(tail || b, 'ACGT', 'TGCA'))))"""

# fixed values: the first numbers of the C library's rand() after srand(1), the seeds of
# the filter's hash functions
_RAND = (1804289383, 846930886, 1681692777, 1714636915, 1957747793, 424238335, 719885386,
         1649760492, 596516649, 1189641421, 1025202362, 1350490027, 783368690, 1102520059,
         2044897763, 1967513926)

_WIDTH = """
cand as (select n_solid, j, -j * n_solid / ln(1.0 - pow(0.001, 1.0 / j)) w
         from nsolid, (select unnest(generate_series(1, 999)) j)),
best as (select min(w) bw, arg_min(j, w) bj from cand),
fp as (select num_kmers, width_bits, width_bits // 8 width_bytes, num_hash from (
        select n_solid num_kmers, (w2 + 7) // 8 * 8 width_bits, cast(j + j % 2 as int) num_hash
        from (select n_solid, j, 2 * cast(floor(w) as bigint) w2 from cand, best
              where j < bj and w < bw * 1.2 or j = bj order by j limit 1)))"""


def _murmur(table: str, out: str) -> str:
    """CTEs: (kmer, seed number, position) of the k-mers of `table`, by the published 32-bit
    hash in 64-bit arithmetic."""
    m = "4294967295::ubigint"

    def rotl(x: str, r: int) -> str:
        return f"((({x} * {1 << r}) & {m}) | ({x} // {1 << (32 - r)}))"

    def word(at: int, n: int) -> str:
        return " + ".join(f"ascii(substr(kmer, {at + i + 1}, 1))::ubigint * {256 ** i}" for i in range(n))

    steps = [f"{out}0 as (select kmer, no, seed::ubigint h from {table}, fp, (values "
             + ", ".join(f"({i}, {v})" for i, v in enumerate(_RAND)) + ") x(no, seed) where no < num_hash)"]
    blocks = [(4 * i, 4) for i in range(K // 4)] + ([(K - K % 4, K % 4)] if K % 4 else [])
    for i, (at, n) in enumerate(blocks):
        mixed = (f"(select *, ({rotl('a', 15)} * 461845907) & {m} c from (select *, "
                 f"(({word(at, n)}) * 3432918353) & {m} a from {out}{i}))")
        if n == 4:
            steps.append(f"{out}{i + 1} as (select kmer, no, ({rotl('b', 13)} * 5 + 3864292196) & {m} h "
                         f"from (select kmer, no, xor(h, c) b from {mixed}))")
        else:
            steps.append(f"{out}{i + 1} as (select kmer, no, xor(h, c) h from {mixed})")
    last = f"(select kmer, no, xor(h, {K}::ubigint) h from {out}{len(blocks)})"
    for shift, factor in ((65536, 2246822507), (8192, 3266489909)):
        last = f"(select kmer, no, (xor(h, h // {shift}) * {factor}) & {m} h from {last})"
    return ",\n".join(steps) + (
        f",\n{out} as (select kmer, no, cast(xor(h, h // 65536) as bigint) % width_bits p from {last}, fp)")


ORACLES: dict[str, str] = {
    "read_pairs": _q("select * from pairs"),
    "reads_from_documents": _q("select read_id, pair_id, mate, seq, qual from reads"),
    "mate_count_check": _q("select mate, count(*) n_reads from reads group by 1"),
    "quality_histogram": _q("select code, n from qhist", _HIST),
    "quality_range": _q("select min_code, max_code from qrange", _HIST),
    "phred_offset": _q('select min_code, max_code, "offset", note from qnote', _HIST, _PAIRED),
    "phred_offset_single": _q('select min_code, max_code, "offset", note from qnote',
                              _HIST, _SINGLE),
    "quality_total_bases": _q(
        'select cast(sum(n) as bigint) total_bases from qhist, qnote '
        'where code between "offset" and "offset" + 41', _HIST, _PAIRED),
    "quality_cutoffs": _q(
        'select "offset", note, cast(total as bigint) total_bases, '
        'cast(min(code) filter (where share >= 0.05) - "offset" as int) quality_score_cutoff, '
        'cast(min(code) filter (where share >= 0.01) - "offset" as int) '
        'extremely_low_quality_score, '
        'min(share) filter (where share >= 0.01) >= 0.06 low_share_warning '
        'from shr group by "offset", note, total', _HIST, _PAIRED, _CUTS),
    "histogram_report_qs": _q(
        "select cast(q as int) as row, "
        "lpad(cast(q as varchar), 4, ' ') || ': ' || "
        "lpad(cast(coalesce(n, 0) as varchar), 14, ' ') line "
        "from (select unnest(generate_series(0, 41)) q) left join qhist on code = q + 33", _HIST),
    "normalize_reads": _q("select read_id, seq, cast(n_count as int) n_count from norm", _NORM),
    "read_gate": _q("select read_id, cast(len as int) len, cast(gate as int) gate from gated",
                    _NORM),
    "trim_limits": _q("select read_id, cast(max_trim as int) max_trim, "
                      "cast(check_len as int) check_len from gated", _NORM),
    "kmers": _q("select mate, kmer, count(*) n, cast(min(pos) as int) min_pos, "
                "cast(max(pos) as int) max_pos from wins group by 1, 2", _counts()),
    "canonical_kmers": _q("select kmer, count(*) n from occ group by 1", _counts()),
    "long_kmer_counts": _q("select kmer, n from kc", _counts(33)),
    "kmer_counts": _q("select kmer, n from kc", _counts()),
    "kmer_histogram": _q("select occ, n_kmers from khist", _SPECTRUM),
    "kmer_threshold": _q("select threshold from kthr", _SPECTRUM),
    "histogram_report_kmer": _q(
        "select occ as row, case when occ = 255 then '<=' || lpad(cast(occ as varchar), 5, ' ') "
        "else lpad(cast(occ as varchar), 7, ' ') end || ': ' || "
        "lpad(cast(n_kmers as varchar), 10, ' ') line from khist", _SPECTRUM),
    "unique_solid": _q("select n_solid from nsolid", _SPECTRUM),
    "solid_kmers": _q("select kmer from solid", _SPECTRUM),
    "solid_semi_join": _q(
        "select read_id, count(*) n_solid from rk semi join solid using (kmer) group by 1",
        _SPECTRUM, _NORM, _KMERS_OF),
    "weak_anti_join": _q(
        "select read_id, count(*) n_weak, cast(min(pos) as int) first_weak "
        "from rk anti join solid using (kmer) group by 1", _SPECTRUM, _NORM, _KMERS_OF),
    "bloom_params": _q("select * from fp", _SPECTRUM, _WIDTH),
    "filter_bit_positions": _q(
        "select kmer, string_agg(cast(p as varchar), ',' order by no) positions from fb group by 1",
        _SPECTRUM, _WIDTH, _murmur("solid", "fb")),
    "bloom_bit_count": _q(
        "select count(distinct p // 32768) n_buckets, count(distinct p) n_bits from fb",
        _SPECTRUM, _WIDTH, _murmur("solid", "fb")),
    "bloom_false_positives": _q(
        """select count(*) n_probed, cast(sum(cast(n_set = num_hash as int)) as bigint) n_false
        from (select kmer, count(b.p) n_set from ob left join (select distinct p from fb) b using (p)
              group by 1), fp""",
        _SPECTRUM, _WIDTH, _murmur("solid", "fb"),
        "others as (select distinct kmer from occ anti join solid using (kmer))",
        _murmur("others", "ob")),
    "bloom_membership_no_false_negative": _q(
        "select n_solid, cast(0 as bigint) n_missing from nsolid", _SPECTRUM),
    "solid_flags": _q(
        "select read_id, string_agg(cast(f as varchar), '' order by pos) flags "
        "from rf group by 1", _SPECTRUM, _NORM, _FLAGS),
    "fully_solid_reads": _q(
        "select read_id, cast(len as int) len from gated join "
        "(select read_id from rf group by 1 having min(f) = 1) using (read_id)",
        _SPECTRUM, _NORM, _FLAGS),
    "solid_islands": _q('select read_id, "first", "last" from isl', _SPECTRUM, _NORM, _FLAGS),
    "short_islands_dropped": _q('select read_id, "first", "last" from long',
                                _SPECTRUM, _NORM, _FLAGS, _NEAR),
    "near_islands_merged": _q(
        'select read_id, min("first") "first", max("last") "last" from grp group by read_id, g',
        _SPECTRUM, _NORM, _FLAGS, _NEAR),
    "single_substitution_candidates": _q(
        f"""select read_id, cast(pos as int) pos, b base from (
        select read_id, pos, b, substr(fk, 1, cast(pos as int)) || b ||
            substr(fk, cast(pos as int) + 2) c
        from (select read_id, substr(seq, 1, {K}) fk, unnest(generate_series(0, {K - 1})) pos
              from gated where gate
              and not exists (select 1 from solid where kmer = least(substr(seq, 1, {K}),
                reverse(translate(substr(seq, 1, {K}), 'ACGT', 'TGCA')))))
        cross join (values ('A'), ('C'), ('G'), ('T')) x(b)
        where substr(fk, cast(pos as int) + 1, 1) <> b) v
        join solid on kmer = least(c, reverse(translate(c, 'ACGT', 'TGCA')))""",
        _SPECTRUM, _NORM),
    "path_set_ops": _q("select pair_id, n_common, n_union, disputed from pset", _SETS),
    "disputed_trims": _q(
        "select pair_id, cast(arg_max(t5, step) as int) t5, cast(arg_max(t3, step) as int) t3 "
        "from st group by 1", _SETS, _TRIMS, recursive=True),
    "trim_reconcile": _q(
        """select read_id,
        cast(case when t5 + t3 <= m then t5 when t3 <= m then 0 when t5 <= m then t5
             else 0 end as int) trim5,
        cast(case when t5 + t3 <= m or t3 <= m then t3 when t5 <= m then 0 else m end as int) trim3
        from (select read_id, min("first") t5, any_value(len) - """ + str(K) + """ - max("last") t3,
              any_value(max_trim) m from isl join gated using (read_id) group by 1)""",
        _SPECTRUM, _NORM, _FLAGS),
    "right_walks": _q(
        "select read_id, case when n <= 74 then path end walk, cast(n > 74 as int) given_up from ("
        "select read_id, path, count(*) over (partition by read_id) n, "
        "row_number() over (partition by read_id) r from walk where p + t = len) "
        "where n <= 74 or r = 1",
        _SPECTRUM, _NORM, _FLAGS, _WALK, recursive=True),
    "outside_extension": _q(
        "select g.read_id, cast(max(case when t = 5 then 1 else 0 end) as int) extends "
        "from gated g join ext using (read_id) where gate group by 1",
        _SPECTRUM, _NORM, _OUTSIDE, recursive=True),
}

_PROFILED = (_HIST, _PAIRED, _CUTS, PROFILE, _SPECTRUM, _NORM, _FLAGS)


def correction_of(reads: str, solid: str, select: str) -> str:
    """The correction of any reads (read_id, pair_id, mate, seq, qual) by any solid k-mers."""
    parts = (f"reads as ({reads})", _HIST, _PAIRED, _CUTS, PROFILE, f"solid as materialized ({solid})", _NORM,
             _FLAGS, *CORRECTION)
    return "with recursive " + ",".join(parts) + "\n" + select


def _corrected(select: str) -> str:
    return _q(select, *_PROFILED, *CORRECTION, recursive=True)


ORACLES |= {
    "adjusted_regions": _q("select read_id, by_region::int by_region, regions from mode", *_PROFILED, REGIONS),
    "correct_reads": _corrected(
        "select read_id, seq, qual, n_edits, trim5, trim3, rejected::int rejected from cor"),
    "correction_stats": _corrected(
        """select coalesce(sum(n_edits) filter (not rejected), 0)::bigint corrected_errors,
        count(*) filter (not rejected and (n_edits > 0 or trim5 + trim3 > 0)) corrected_reads,
        coalesce(sum(trim5 + trim3), 0)::bigint trimmed_bases, count(*) n_reads from cor"""),
    "corrected_fastq": _corrected(
        """select mate, read_id, '@r' || pair_id || '/' || mate || chr(10) || seq || chr(10) || '+' || chr(10) || qual record
        from cor"""),
}
