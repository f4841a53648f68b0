"""Line-first cleaning of documents.

Every line is judged by itself: symbols, navigation, shouting, word repetition,
missing punctuation, boilerplate phrases, and lines that repeat an earlier one.
Failing lines go; a document that loses too many of its words goes as a whole.

A null text has no words, and fails the base rules as any text under `MIN_WORDS` does.
Lines are split at \\n; a line without a word belongs to no rule and stays. Rows are
judged one by one, so repeated rows, null ids and further columns make no difference.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmend.llm.common import SPACE

# --- fixed values
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
BASE_SYMBOLS = "#*$%&|<>"
# --- rules of a line
SYMBOLS = "#*$%&|<>{}~^=_"
SYMBOL_PCT = 10
SEPARATORS = ("|", "•", "»", "·", ">", "/", "::")
TERMINAL = ".!?;:…。！？؟।"
UNPUNCTUATED_WORDS = 10
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use",
    "terms of service", "privacy policy", "cookie policy", "uses cookies", "use of cookies",
    "enable javascript", "sign in", "log in", "sign up", "subscribe to", "click here",
    "read more", "share this", "lorem ipsum", "skip to content", "back to top", "copyright ©")
#: A document may lose this share of its words.
MAX_LOST_PCT = 40

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_lines long, n_bad_lines long, lost_words long, "
          "clean_text string")
# sets of bytes to count by deleting them; code points are counted by their first byte
_SPACE, _LATER = SPACE.encode(), bytes(range(0x80, 0xC0))
_BASE, _SYMBOLS = BASE_SYMBOLS.encode(), SYMBOLS.encode()
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_TERMINAL = re.compile("|".join(re.escape(c) for c in TERMINAL).encode())
_BOILERPLATE = [b.encode() for b in BOILERPLATE]
_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)


def _count(data: bytes, which: bytes) -> int:
    return len(data) - len(data.translate(None, which))


def _solid(data: bytes) -> int:
    """Code points that are no white space."""
    return len(data.translate(None, _SPACE + _LATER))


def line_failures(line: bytes, words: list[bytes], phrases: list[bytes]) -> list[str]:
    """The rules that a line with at least one word fails, but for repetition of lines.
    `phrases`: the boilerplate that its text holds anywhere."""
    n, failed = len(words), []
    symbols = _count(line, _SYMBOLS)
    if symbols and 100 * symbols >= SYMBOL_PCT * _solid(line):
        failed.append("symbols")
    separators = sum(map(_SEPARATORS.__contains__, words))
    if separators >= 2 and 4 * separators >= n:
        failed.append("navigation")
    if n >= 3 and _count(line, _UPPER) > _count(line, _LOWER):
        failed.append("shouting")
    if n >= 4 and 2 * sum(map(bytes.__eq__, words, words[1:])) >= n:
        failed.append("repetition")
    if n >= UNPUNCTUATED_WORDS and not _TERMINAL.search(line):
        failed.append("punctuation")
    if phrases:
        low = line.lower()  # of bytes: A-Z only
        if any(p in low for p in phrases):
            failed.append("boilerplate")
    return failed


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(end, i)
            end = i + 3
    return total


def judge_text(text: str | None) -> tuple:
    """The columns of `SCHEMA` for one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words, low = data.split(), data.lower()
    n_words = len(words)
    phrases = [p for p in _BOILERPLATE if p in low]
    seen, clean, lines, bad, repeated, lost = set(), [], 0, 0, 0, 0
    for line in data.split(b"\n"):
        own = line.split()
        if own:
            lines += 1
            again = line in seen
            repeated += again
            seen.add(line)
            if again or line_failures(line, own, phrases):
                bad += 1
                lost += len(own)
                continue
        clean.append(line)
    repeat_words = repeated_words(words)
    base_failed = n_words < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_PCT * n_words
    return (n_words, _solid(data), _count(data, _BASE), repeated, repeat_words, base_failed,
            not base_failed and 100 * lost <= MAX_LOST_PCT * n_words,
            lines, bad, lost, b"\n".join(clean).decode("utf-8", "surrogatepass"))


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def judged(text: Column) -> Column:
    """A struct of the measures, the verdict and the cleaned text."""
    @F.pandas_udf(SCHEMA)
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge_text(t) for t in texts], columns=_NAMES)

    return judge(text)


def clean_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, verdict, cleaned text) of every row."""
    return docs.select("doc_id", judged(F.col("text")).alias("j")).select("doc_id", "j.*")


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def oracle(table: str = "documents") -> str:
    space = r"[^\x20\x09-\x0D]+"
    no_space = r"[\x20\x09-\x0D]"
    return rf"""
with t as (select row_number() over () r, doc_id, coalesce(text, '') x from {table}),
w as (select r, doc_id, x, regexp_extract_all(x, '{space}') ws,
             len(regexp_replace(x, '{no_space}', '', 'g')) word_chars,
             len(x) - len(translate(x, '{BASE_SYMBOLS}', '')) n_symbols from t),
g as (select r, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) gram
      from (select r, ws, unnest(range(1, len(ws) - 1)) i from w)),
gc as (select r, i, count(*) over (partition by r, gram) n from g),
rep as (select r, count(distinct p) n_repeat_words
        from (select r, unnest([i, i + 1, i + 2]) p from gc where n > 1) group by r),
l as (select r, unnest(string_split(x, chr(10))) line, unnest(range(len(string_split(x, chr(10))))) i from t),
lw as (select *, regexp_extract_all(line, '{space}') ws, len(regexp_replace(line, '{no_space}', '', 'g')) solid,
              row_number() over (partition by r, line order by i) > 1 again from l),
lf as (select r, len(ws) n, again,
   100 * (len(line) - len(translate(line, '{SYMBOLS}', ''))) >= {SYMBOL_PCT} * solid
   or (len(list_filter(ws, lambda v: v in ({_sql_list(SEPARATORS)}))) >= 2
       and 4 * len(list_filter(ws, lambda v: v in ({_sql_list(SEPARATORS)}))) >= len(ws))
   or (len(ws) >= 3 and len(regexp_replace(line, '[^A-Z]', '', 'g')) > len(regexp_replace(line, '[^a-z]', '', 'g')))
   or (len(ws) >= 4 and 2 * len(list_filter(range(1, len(ws)), lambda k: ws[k] = ws[k + 1])) >= len(ws))
   or (len(ws) >= {UNPUNCTUATED_WORDS} and not regexp_matches(line, '[{TERMINAL}]'))
   or regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '{"|".join(BOILERPLATE)}') failed
   from lw where len(ws) > 0),
ls as (select r, count(*) filter (again) n_dup_lines, count(*) n_lines,
              count(*) filter (again or failed) n_bad_lines,
              coalesce(sum(n) filter (again or failed), 0) lost_words from lf group by r),
m as (select doc_id, len(ws) n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) n_dup_lines,
             coalesce(n_repeat_words, 0) n_repeat_words,
             len(ws) < {MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PCT} * len(ws) base_failed,
             coalesce(n_lines, 0) n_lines, coalesce(n_bad_lines, 0) n_bad_lines,
             coalesce(lost_words, 0)::bigint lost_words
      from w left join rep using (r) left join ls using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and 100 * lost_words <= {MAX_LOST_PCT} * n_words kept,
       n_lines, n_bad_lines, lost_words from m"""
