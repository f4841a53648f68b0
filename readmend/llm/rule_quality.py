"""Quality by a sparse ensemble of rules.

Statistics of a text are Spark expressions: shares of symbols, separators, capitals, digits,
punctuation, repeated words and so on. Small trees, boosted on samples of the learning
rows, propose rules: each path from a root is a conjunction of comparisons of statistics. A
logistic regression on the rules' indicators with an L1 penalty keeps few of them; the
penalty is the one that does best on a fifth of the rows. The rules left are compiled into
one column expression, so every text is scored inside the executors' JVM.

Learning takes at most `MOST_ROWS` labelled documents of each kind and only their statistics
come to the driver. Where that leaves out labels, the two kinds are sampled at different
rates; the level is moved by the log of their quotient, so scores follow the share of good
documents among all labels and not the one in the sample. A null text is an empty one, with all statistics 0, and is scored as
any other. Without labels of both kinds every score is the (smoothed) share of label 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmend.llm.common import held_out, learning_sample, sampling_rates

MOST_ROWS = {0: 4000, 1: 6000}
THRESHOLD = 0.5
TREES, DEPTH, LEAST_ROWS, CUTS = 40, 3, 10, 40
SHARE_OF_ROWS, RATE = 0.5, 0.2
PENALTIES = (0.02, 0.01, 0.005, 0.0025, 0.001, 0.0005)

#: Occurrences of a pattern for each word. Texts get a line end at their end.
_A_WORD = {
    "symbols": r"[#*$%&<>{}\[\]~^=_\\@]",
    "separators": r"[|•»·]",
    "exclamations": r"!",
    "stops": r"[.?…。]",
    "commas": r"[,;:]",
    "lines": r"\n",
    "numbers": r"[0-9]+",
    "repeats": r"(?<!\S)(\S++)[ \t\n]++(?=\1(?!\S))",
    "bare_lines": r"[^.!?…:;\s][ \t\r\f\x0B]*+\n",
    "links": r"https?://|www\.",
    "long_words": r"(?<!\S)\S{15,}",
}
STATISTICS = ("log_words", "word_length", *_A_WORD, "capitals", "letters")


def statistics(text: Column) -> Column:
    """A struct of `STATISTICS`. Counts are bound by a lambda, each is made once."""
    text = F.coalesce(text, F.lit(""))

    ended = F.concat(text, F.lit("\n"))

    def count(pattern):  # possessive quantifiers: nothing is tried twice
        return F.regexp_count(ended, F.lit(pattern)).cast("double")

    def without(pattern):
        return F.length(F.regexp_replace(text, pattern, "")).cast("double")

    counts = F.struct(
        count(r"[^\x20\x09-\x0D]++").alias("words"), without(r"[\x20\x09-\x0D]+").alias("solid"),
        without(r"\P{L}+").alias("letters"), count(r"\p{Lu}").alias("capitals"),
        *[count(p).alias(n) for n, p in _A_WORD.items()])

    def shares(c):
        a_word = F.greatest(c.words, F.lit(1.0))
        a_character = F.greatest(c.solid, F.lit(1.0))
        return F.struct(
            F.log1p(c.words).alias("log_words"), (c.solid / a_word).alias("word_length"),
            *[(c[n] / a_word).alias(n) for n in _A_WORD],
            *[(c[n] / a_character).alias(n) for n in ("capitals", "letters")])

    return F.element_at(F.transform(F.array(counts), shares), 1)


# --- rules -------------------------------------------------------------------------

#: (statistic, above, cut): statistic > cut, or <= cut
Condition = tuple[int, bool, float]


@dataclass
class RuleModel:
    level: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self, s) -> Column:
        """The score for a struct of statistics."""
        total = F.lit(self.level)
        for rule, weight in self.rules:
            holds = reduce(Column.__and__, [
                s[STATISTICS[i]] > cut if above else s[STATISTICS[i]] <= cut
                for i, above, cut in rule])
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.level)
        for rule, weight in self.rules:
            total += weight * _holds(x, rule)
        return 1 / (1 + np.exp(-total))


def _holds(x: np.ndarray, rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, cut in rule:
        out &= (x[:, i] > cut) == above
    return out


def _best_split(x, bins, cuts, slope, curve, rows):
    """The split of most gain in the second-order approximation of the loss."""
    total_s, total_c = slope[rows].sum(), curve[rows].sum()
    best = (1e-6, None, None)
    for i in range(x.shape[1]):
        if not len(cuts[i]):
            continue
        size = len(cuts[i]) + 1
        b = bins[rows, i]
        n = np.cumsum(np.bincount(b, minlength=size))[:-1]
        s = np.cumsum(np.bincount(b, slope[rows], size))[:-1]
        c = np.cumsum(np.bincount(b, curve[rows], size))[:-1]
        gain = s ** 2 / (c + 1) + (total_s - s) ** 2 / (total_c - c + 1) - total_s ** 2 / (total_c + 1)
        gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), i, k)
    return best


def propose_rules(x: np.ndarray, y: np.ndarray) -> list[tuple[Condition, ...]]:
    """The paths of boosted trees, each once."""
    cuts = []
    for i in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, i], np.linspace(0, 1, CUTS + 1)))
        cuts.append((q[1:] + q[:-1]) / 2)
    bins = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], 1)
    random = np.random.default_rng(1)
    margin, rules = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, p * (1 - p)
        sample = np.flatnonzero(random.random(len(y)) < SHARE_OF_ROWS)
        nodes, change = [((), sample, np.arange(len(y)))], np.zeros(len(y))
        while nodes:
            path, rows, all_rows = nodes.pop()
            gain, i, k = _best_split(x, bins, cuts, slope, curve, rows) if len(path) < DEPTH \
                and len(rows) >= 2 * LEAST_ROWS else (0, None, None)
            if i is None:
                change[all_rows] = slope[rows].sum() / (curve[rows].sum() + 1)
                continue
            for above in (False, True):
                child = (*path, (i, above, float(cuts[i][k])))
                rules[tuple(sorted(child))] = None
                nodes.append((child, rows[(bins[rows, i] > k) == above],
                              all_rows[(bins[all_rows, i] > k) == above]))
        margin += RATE * change
    return list(rules)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, start=None,
                   steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and level by accelerated proximal gradient steps; `r` has 0 and 1."""
    n, k = r.shape
    w, level = (np.zeros(k), math.log(y.mean() / (1 - y.mean()))) if start is None else start
    # the largest curvature, by a few power iterations
    v = np.ones(k) / math.sqrt(max(k, 1))
    for _ in range(15):
        u = r.T @ (r @ v)
        v = u / max(np.linalg.norm(u), 1e-12)
    size = 1 / (0.25 * (v @ (r.T @ (r @ v))) / n + 0.25 + 1e-9)
    z, z_level, t = w.copy(), level, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(r @ z + z_level))) - y
        new = z - size * (r.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)
        new_level = z_level - size * error.mean()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        z_level = new_level + (t - 1) / t_new * (new_level - level)
        moved = np.abs(new - w).max(initial=0) + abs(new_level - level)
        w, level, t = new, new_level, t_new
        if moved < 1e-6:
            break
    return w, float(level)


def fit(x: np.ndarray, y: np.ndarray, rates: dict[int, float] | None = None) -> RuleModel:
    """`rates`: the share of all rows of a label that `x` and `y` hold, one if not given."""
    y = np.asarray(y, float)
    rates = rates or {0: 1.0, 1: 1.0}
    good = y.sum() / rates[1]
    bad = (len(y) - y.sum()) / rates[0]
    constant = RuleModel(math.log((good + 0.5) / (bad + 0.5)))
    if not 0 < y.sum() < len(y):
        return constant
    rules = propose_rules(x, y)
    if not rules:
        return constant
    r = np.stack([_holds(x, rule) for rule in rules], 1).astype(float)
    test = np.arange(len(y)) % 5 == 4
    best, start = (math.inf, PENALTIES[-1]), None
    if 0 < y[~test].sum() < (~test).sum() and test.any():
        for penalty in PENALTIES:
            start = lasso_logistic(r[~test], y[~test], penalty, start)
            p = np.clip(1 / (1 + np.exp(-(r[test] @ start[0] + start[1]))), 1e-6, 1 - 1e-6)
            loss = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))
            if loss < best[0]:
                best = (loss, penalty)
    w, level = lasso_logistic(r, y, best[1])
    level += math.log(rates[0] / rates[1])
    return RuleModel(level, [(rule, float(v)) for rule, v in zip(rules, w) if abs(v) > 1e-4])


# --- documents ---------------------------------------------------------------------

def learn(docs: DataFrame, labels: DataFrame) -> RuleModel:
    sample = learning_sample(docs, labels, "quality", MOST_ROWS)
    rows = sorted(map(tuple, sample.select("doc_id", "label", statistics(F.col("text")).alias("s"))
                      .select("doc_id", "label", "s.*").collect()))
    x = np.array([r[2:] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r[1] for r in rows]), sampling_rates(labels, "quality", MOST_ROWS))


def quality(text: Column, model: RuleModel) -> Column:
    """The compiled score. The lambda binds the statistics, so that each is computed once
    wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(statistics(text)), model.column), 1)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = learn(docs, labels)
    return docs.select("doc_id", held_out().alias("held_out"), quality(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.where(quality(docs["text"], learn(docs, labels)) >= THRESHOLD)
