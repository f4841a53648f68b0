"""Fill-in-middle: documents cut at two token ranks and put together in another order.

A token is a word with the white space before it; white space at the end of a text is a
token of its own. The tokens of a text stand in an indexable skip list: lane 0 has every
token, each lane above about a quarter of the one below, the first token always. An entry of
a lane knows how many tokens (unit width) and how many code points it leads over. The
descent to a rank goes along a lane as long as the unit widths it has added up stay within
the rank, then down; what the code-point widths add up to is the exact place of the cut. An
entry's lanes follow from a hash of its rank, so reruns agree.

Which documents are changed, their two cuts and their form follow from the SHA-256 of
`seed:doc_id`, a null doc_id counting as an empty one: rows that share a doc_id and a text
have equal results. A null text is an empty one; empty texts, and those that hold one of the
three marks, stay as they are (`plain`). Texts are cut whole at any length, one at a time.
Columns besides doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmend.llm.common import SPACE
from readmend.llm.text_hash import mixed

SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Share of the documents that are changed, and of the changed ones in suffix-first form.
CHANGED_PCT, SUFFIX_FIRST_PCT = 50, 80
#: A lane of at most so many entries has none above it.
TOP_LANE = 6
FORMS = "n long, form string, prefix_chars long, middle_chars long, output string"

_IS_SPACE = np.zeros(33, bool)
_IS_SPACE[[ord(c) for c in SPACE]] = True


def token_sizes(text: str) -> np.ndarray:
    """Code points of each token."""
    codes = (np.frombuffer(text.encode(), np.uint8) if text.isascii()
             else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
    if not len(codes):
        return np.zeros(0, np.int64)
    space = _IS_SPACE[np.minimum(codes, 32)] & (codes <= 32)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.diff(ends, prepend=0, append=len(codes))


class SkipList:
    """Token ranks and code points of one text."""

    def __init__(self, sizes: np.ndarray):
        self.n = len(sizes)
        units, points = np.ones(self.n, np.int64), np.asarray(sizes, np.int64)
        draws = mixed(np.arange(self.n, dtype=np.uint64) + np.uint64(1))
        #: (unit widths, code-point widths, entry of the lane below), the lowest lane first
        self.lanes = [(units, points, None)]
        while len(units) > TOP_LANE:
            up = draws & np.uint64(3) == 0
            up[0] = True
            kept = np.flatnonzero(up)
            if len(kept) == len(units):
                draws = mixed(draws)
                continue
            units, points = np.add.reduceat(units, kept), np.add.reduceat(points, kept)
            draws = draws[kept] >> np.uint64(2)
            draws[0] = 0
            self.lanes.append((units, points, kept))

    def code_points_before(self, rank: int) -> int:
        """Code points of the first `rank` tokens."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        passed = place = at = 0
        for units, points, below in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed += int(units[at])
                place += int(points[at])
                at += 1
            if passed == rank:
                return place
            if below is not None:
                at = below[at]
        raise AssertionError("the widths of the lowest lane are one")


def rearranged(text: str | None, draws: tuple[int, int, int, int],
               changed_pct: int = CHANGED_PCT, suffix_first_pct: int = SUFFIX_FIRST_PCT) -> tuple:
    """The columns of `FORMS`; `draws` are the two cuts' numbers, and those of change and form."""
    text = text or ""
    sizes = token_sizes(text)
    n = len(sizes)
    first, second, change, form = draws
    if not n or change % 100 >= changed_pct or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    tokens = SkipList(sizes)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = tokens.code_points_before(low), tokens.code_points_before(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form % 100 < suffix_first_pct:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def original(output: str, form: str) -> str:
    """The text that was rearranged. Parts hold no mark, and marks don't overlap, so the
    first place of a mark is its own."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, _, rest = output.removeprefix(first).partition(second)
    other, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (other, head) if form == "spm" else (head, other)
    return prefix + middle + suffix


_NAMES = [c.split()[0] for c in FORMS.split(", ")]


def fill_in_middle(docs: DataFrame, seed: int = SEED, changed_pct: int = CHANGED_PCT,
                   suffix_first_pct: int = SUFFIX_FIRST_PCT) -> DataFrame:
    """(doc_id, `FORMS`) of every row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]

    @F.pandas_udf(FORMS)
    def rearrange(texts: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = [rearranged(t, x, changed_pct, suffix_first_pct) for t, *x in zip(texts, a, b, c, d)]
        out = pd.DataFrame(rows, columns=_NAMES)
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.select("doc_id", rearrange("text", *draws).alias("f")).select("doc_id", "f.*")


def restored(output: Column, form: Column) -> Column:
    @F.pandas_udf("string")
    def restore(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([original(o, f) for o, f in zip(outputs, forms)], dtype="object")

    return restore(output, form)


def digests(docs: DataFrame) -> DataFrame:
    """Forms of every document, with digests of the output and of the text made of it again."""
    made = fill_in_middle(docs)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def oracle(table: str = "documents") -> str:
    token = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    h = [f"('0x' || substr(d, {8 * i + 1}, 8))::ubigint::bigint" for i in range(4)]
    return f"""
with t as (select doc_id, coalesce(text, '') x, regexp_extract_all(coalesce(text, ''), '{token}') w,
                  sha256('{SEED}:' || coalesce(doc_id::varchar, '')) d from {table}),
c as (select doc_id, x, w, len(w) n, {h[0]} % (len(w) + 1) a, {h[1]} % (len(w) + 1) b,
             case when x = '' or contains(x, '{PREFIX}') or contains(x, '{SUFFIX}') or contains(x, '{MIDDLE}')
                       or {h[2]} % 100 >= {CHANGED_PCT} then 'plain'
                  when {h[3]} % 100 < {SUFFIX_FIRST_PCT} then 'spm' else 'psm' end form from t),
p as (select *, array_to_string(w[1:least(a, b)], '') pre,
             array_to_string(w[least(a, b) + 1:greatest(a, b)], '') mid,
             array_to_string(w[greatest(a, b) + 1:], '') suf from c)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(pre) end::bigint prefix_chars,
       case when form <> 'plain' then length(mid) end::bigint middle_chars,
       sha256(case form when 'plain' then x when 'spm' then '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid
              else '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid end) output_sha256,
       sha256(x) restored_sha256
from p"""
