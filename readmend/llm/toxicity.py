"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text, and each
window of a document is compressed with both. A window is a distinct word (a run of
letters, lower-cased, at most `LONGEST` of them) with its spaces. A toxic document is mostly
ordinary prose, and dictionaries trained on its whole text hardly tell it from other prose. So the
toxic dictionary learns from a choice of words: those that `LEAST_SHARE` of the toxic documents hold
(`LEAST_COUNT` at least), and `RATIO` times as often as ordinary documents. The ordinary one learns
from an even choice of about `MOST_SAMPLES` words; the same part of it stands before both.
Behind each window stands a tail that both dictionaries hold: the fixed costs of a
compressed block are then the same for both, and the coder, which looks for no match in the
last 8 bytes, sees the whole window.

Thresholds are calibrated, not set: for every (window length, length with the ordinary
dictionary, length with the toxic one) the log odds of toxic documents that have such a
window against ordinary ones are counted, on documents that the dictionaries of the count
did not learn from (two halves). A document's evidence is the sum of its `TOP` largest log
odds, and a logistic curve makes it a probability.

Learning takes at most `MOST_TOXIC` and `MOST_ORDINARY` labelled documents. Where that
leaves out labels, the two kinds are sampled at different rates; the level is moved by the
log of their quotient, so scores follow the share of toxic documents among all labels and
not the one in the sample. Every text is scored whole. A null text is an empty one; a text without a letter has no evidence. Without
labels of both kinds every score is the (smoothed) share of toxic labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmend.llm.common import held_out, learning_sample, sampling_rates

MOST_TOXIC, MOST_ORDINARY = 2000, 5000
SHARED_BYTES, OWN_BYTES = 2048, 32768
RATIO, LEAST_SHARE, LEAST_COUNT = 20, 0.005, 3
LONGEST = 40
TOP = 3
THRESHOLD = 0.7
CACHE_WORDS = 300_000
TAIL = b"<0123456789abcdef>"
_WORD = re.compile(r"[^\W\d_]+")
SMOOTHING = 0.3
MOST_SAMPLES = 60_000


def windows(text: str | None) -> list[bytes]:
    words = dict.fromkeys(_WORD.findall((text or "").lower()))
    return [f" {p} ".encode() for w in words
            for p in ((w,) if len(w) <= LONGEST else (w[i:i + LONGEST] for i in range(0, len(w), LONGEST)))]


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content of a trained dictionary; samples too few to train on stand for it."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=16, chain_log=16, search_log=8, min_match=5, target_length=64,
        strategy=zstandard.STRATEGY_BTLAZY2, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=0, write_checksum=0, write_dict_id=0)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=known)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    odds: dict = field(default_factory=dict)
    slope: float = 0.0
    level: float = 0.0

    def __post_init__(self):
        self._open()

    def _open(self):
        self.coders = compressor(self.ordinary), compressor(self.toxic)
        self.seen: dict[bytes, float] = {}

    def __getstate__(self):
        return self.ordinary, self.toxic, self.odds, self.slope, self.level

    def __setstate__(self, state):
        self.ordinary, self.toxic, self.odds, self.slope, self.level = state
        self._open()

    def lengths(self, window: bytes) -> tuple[int, int, int]:
        whole = window + TAIL
        ordinary, toxic = self.coders
        return min(len(window), 24), len(ordinary.compress(whole)), len(toxic.compress(whole))

    def evidence(self, text: str | None) -> float:
        seen, odds = self.seen, []
        for w in windows(text):
            got = seen.get(w)
            if got is None:
                if len(seen) > CACHE_WORDS:
                    seen.clear()
                got = seen[w] = self.odds.get(self.lengths(w), 0.0)
            if got > 0:
                odds.append(got)
        return sum(sorted(odds)[-TOP:])

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-(self.level + self.slope * self.evidence(text))))


def train_dictionaries(rows: list[tuple[list[bytes], int]]) -> Model:
    counts = [Counter(), Counter()]
    sizes = [0, 0]
    for found, label in rows:
        counts[label].update(found)
        sizes[label] += 1
    least = max(LEAST_COUNT, LEAST_SHARE * sizes[1])
    telling = sorted(w for w, n in counts[1].items() if n >= least
                     and n / sizes[1] >= RATIO * (counts[0][w] + 0.5) / max(sizes[0], 1))
    ordinary = [w for found, label in rows if not label for w in found]
    step = max(1, len(ordinary) // MOST_SAMPLES)
    shared = _trained(ordinary[::2 * step], SHARED_BYTES)
    own = _trained(ordinary[step::2 * step], OWN_BYTES)
    # each telling word counts the same; the trainer wants them often
    toxic = _trained(telling * 20, OWN_BYTES)
    return Model(TAIL + shared + own, TAIL + shared + toxic)


def _cells(model: Model, rows) -> list[set]:
    """The cells of each row's windows. A window is compressed once, and equal cells are one
    object: this is the most that learning holds on the driver."""
    cell_of: dict[bytes, tuple] = {}
    shared: dict[tuple, tuple] = {}
    for w in {w for found, _ in rows for w in found}:
        cell = model.lengths(w)
        cell_of[w] = shared.setdefault(cell, cell)
    return [set(map(cell_of.__getitem__, found)) for found, _ in rows]


def _with_windows(rows) -> list[tuple[list[bytes], int]]:
    """Distinct (text, label) with windows for the text; equal windows are one object."""
    shared: dict[bytes, bytes] = {}
    return [([shared.setdefault(w, w) for w in windows(t)], label) for t, label in dict.fromkeys(rows)]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level by Newton steps, with a weak pull of the slope to zero."""
    design = np.stack([x, np.ones(len(x))], 1)
    w = np.zeros(2)
    pull = np.array([0.01, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + np.diag(pull + 1e-9),
                               design.T @ (y - p) - pull * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(rows: list[tuple[str, int]], rates: dict[int, float] | None = None) -> Model:
    """`rows`: (text, label); `rates`: the share of all rows of a label that they hold, one
    if not given."""
    rates = rates or {0: 1.0, 1: 1.0}
    rows = _with_windows(rows)
    labels = np.array([label for _, label in rows])
    if not 0 < labels.sum() < len(rows):
        toxic, ordinary = labels.sum() / rates[1], (len(rows) - labels.sum()) / rates[0]
        return Model(TAIL, TAIL, level=math.log((toxic + 0.5) / (ordinary + 0.5)))
    halves = [[r for r in rows if r[1]][i::2] + [r for r in rows if not r[1]][i::2] for i in (0, 1)]
    counts, sizes, cells = [Counter(), Counter()], [0, 0], []
    for learn, test in (halves, halves[::-1]):
        for (_, label), found in zip(test, _cells(train_dictionaries(learn), test)):
            counts[label].update(found)
            sizes[label] += 1
            cells.append((label, found))
    even = SMOOTHING * sizes[0] / sizes[1]
    odds = {c: math.log((counts[1][c] + SMOOTHING) / (sizes[1] + 1))
            - math.log((counts[0][c] + even) / (sizes[0] + 1)) for c in counts[0] | counts[1]}
    odds = {c: v for c, v in odds.items() if v > 0}
    model = train_dictionaries(rows)
    model.odds = odds
    # a cell stands for all windows of its lengths: the sum over cells, as each half saw them
    x = np.array([sum(sorted(odds.get(c, 0.0) for c in found)[-TOP:]) for _, found in cells])
    model.slope, model.level = _logistic(x, np.array([label for label, _ in cells], float))
    model.level += math.log(rates[0] / rates[1])
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    most = {1: MOST_TOXIC, 0: MOST_ORDINARY}
    sample = learning_sample(docs, labels, "toxic", most)
    return fit([(r["text"], r["label"]) for r in sorted(
        sample.select("doc_id", "text", "label").collect())], sampling_rates(labels, "toxic", most))


def toxicity(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = learn(docs, labels)
    return docs.select("doc_id", held_out().alias("held_out"), toxicity(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.where(toxicity(docs["text"], learn(docs, labels)) < THRESHOLD)
