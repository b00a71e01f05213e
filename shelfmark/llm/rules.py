"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on a labelled sample. Every path from a root to a node is a rule, a
conjunction of thresholds on statistics. A logistic model with an L1 penalty weighs the rules and
the clipped statistics; most weights end at zero. What is left is compiled into one Spark column
expression, so scoring is a projection.

The sample is bounded at about `SAMPLE` rows: labelled ids, and of these documents, are chosen by
a hash threshold that follows from their number; all else covers every row. Very long texts are
scored whole. Null and empty texts have all statistics zero and get a score like any other.
Rows with equal text get equal scores. Without labels of both classes the score is the smoothed
share of label 1 for every row. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, words_of
from shelfmark.llm.outliers import HAS_WORD, SYMBOLS, let, repeated_words

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, LEAST, RATE = 40, 3, 20, 0.3
#: L1 penalty per sample row, and steps of the solver.
PENALTY, SOLVER_STEPS = 0.002, 400
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÉÈÊËÎÏÔÙÛÇÑÁÍÓÚ"
DIGITS = "0123456789"
MARKS = "!?.,;:()[]{}\"'-_/\\~^=+@"


def statistics(text: Column) -> Column:
    """Struct of the statistics of a text; shares are per character or per word."""
    body = F.coalesce(text, F.lit(""))

    def kept(drop: str) -> Column:
        return F.length(body) - F.length(F.translate(body, drop, ""))

    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(HAS_WORD))
    return let(words_of(text), lambda w: let(F.greatest(F.size(w), F.lit(1)), lambda n: F.struct(
        F.log1p(F.size(w)).alias("log_words"),
        (F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / n).alias("word_length"),
        F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0))
        .cast("double").alias("longest_word"),
        (kept(SYMBOLS) / n).alias("symbols"), (kept(UPPER) / n).alias("upper"),
        (kept(DIGITS) / n).alias("digits"), (kept(MARKS) / n).alias("marks"),
        (repeated_words(w) / n).alias("repeats"),
        (F.size(F.array_distinct(w)) / n).alias("distinct_words"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x)))
            / F.greatest(F.size(x), F.lit(1))).alias("dup_lines"),
        (F.size(lines) / n).alias("lines"))))


FEATURES = ["log_words", "word_length", "longest_word", "symbols", "upper", "digits", "marks",
            "repeats", "distinct_words", "dup_lines", "lines"]

#: One condition of a rule: statistic, threshold, and whether values above it are meant.
Condition = tuple[int, float, bool]


@dataclass
class Model:
    """Rules and linear terms with their weights; `parts` are (weight, conditions)."""
    base: float
    parts: list[tuple[float, tuple[Condition, ...]]]
    linear: list[tuple[float, int, float, float]]  # weight, statistic, low, high

    def score(self, values: dict[str, Column]) -> Column:
        """The probability of label 1 as a column expression."""
        total = F.lit(self.base)
        for weight, f, low, high in self.linear:
            clipped = F.least(F.greatest(values[FEATURES[f]], F.lit(low)), F.lit(high))
            total = total + F.lit(weight) * clipped
        for weight, conditions in self.parts:
            hit = None
            for f, cut, above in conditions:
                value = values[FEATURES[f]]
                test = value > F.lit(cut) if above else value <= F.lit(cut)
                hit = test if hit is None else hit & test
            total = total + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _best_split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray):
    """Feature and threshold of the largest gain, thresholds among 32 quantiles."""
    best = (1e-9, None, None)
    total_g, total_h = grad.sum(), hess.sum()
    for f in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 32)))
        place = np.searchsorted(cuts, x[:, f], side="left")  # cuts[place-1] < x <= cuts[place]
        size = len(cuts) + 1
        g = np.cumsum(np.bincount(place, grad, size))[:-1]
        h = np.cumsum(np.bincount(place, hess, size))[:-1]
        n = np.cumsum(np.bincount(place, minlength=size))[:-1]
        gain = g ** 2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g ** 2 / (total_h + 1)
        gain[(n < LEAST) | (len(x) - n < LEAST)] = 0
        at = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[at] > best[0]:
            best = (gain[at], f, float(cuts[at]))
    return best[1:]


def _grow(x, grad, hess, rows, path, depth, out: np.ndarray, rules: dict) -> None:
    """Split `rows` and note the path to every node; leaves add their step to `out`."""
    f, cut = _best_split(x[rows], grad[rows], hess[rows]) if depth < DEPTH else (None, None)
    if path:
        rules.setdefault(tuple(sorted(path)), None)
    if f is None:
        out[rows] -= RATE * grad[rows].sum() / (hess[rows].sum() + 1)
        return
    above = x[rows, f] > cut
    _grow(x, grad, hess, rows[above], path + [(f, cut, True)], depth + 1, out, rules)
    _grow(x, grad, hess, rows[~above], path + [(f, cut, False)], depth + 1, out, rules)


def _rules(x: np.ndarray, y: np.ndarray) -> list[tuple[Condition, ...]]:
    rng = np.random.default_rng(11)
    margin = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        step = np.zeros(len(y))
        if len(rows) >= 2 * LEAST:
            _grow(x, p - y, np.maximum(p * (1 - p), 1e-6), rows, [], 0, step, rules)
        margin += step
    return list(rules)


def holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, cut, above in rule:
        hit &= x[:, f] > cut if above else x[:, f] <= cut
    return hit


def _lasso(a: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient."""
    n, p = a.shape
    step = 4.0 / max(np.linalg.eigvalsh(a.T @ a / n)[-1] + 1.0, 1e-9)
    w, b = np.zeros(p), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(SOLVER_STEPS):
        r = (1 / (1 + np.exp(-(a @ vw + vb))) - y) / n
        nw = vw - step * (a.T @ r)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * PENALTY, 0)
        nb = vb - step * r.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))), [], [])
    low, high = np.quantile(x, [0.025, 0.975], axis=0)
    rules = _rules(x, y)
    clipped = np.clip(x, low, high)
    spread = clipped.std(axis=0)
    scale = np.where(spread > 1e-9, 0.4 / np.maximum(spread, 1e-9), 0.0)
    centre = clipped.mean(axis=0)
    a = np.hstack([(clipped - centre) * scale,
                   np.array([holds(x, r) for r in rules], float).T.reshape(len(y), len(rules))])
    base, w = _lasso(a, y.astype(float))
    k = x.shape[1]
    linear = [(float(w[f] * scale[f]), f, float(low[f]), float(high[f]))
              for f in range(k) if w[f] * scale[f] != 0]
    base -= sum(weight * centre[f] for weight, f, _, _ in linear)
    return Model(float(base), [(float(v), r) for v, r in zip(w[k:], rules) if v != 0], linear)


def in_training(doc_id: Column) -> Column:
    """Whether labels of this id may be learned from: crc32 of the id's text is not 0 mod 5."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 != 0, F.lit(False))


def _learn(docs: DataFrame, labels: DataFrame, label: str, text: str) -> Model:
    """Fit on the documents of at most about SAMPLE labelled ids, chosen by a hash.

    The ids are chosen among the labels first: the chosen ones are few enough to be broadcast, and
    only their documents are read for statistics. Equal rows count once.
    """
    known = materialise(
        labels.select(F.col("doc_id").alias("_lid"), F.col(label).cast("int").alias("_y"))
        .filter(F.col("_y").isin(0, 1) & in_training(F.col("_lid"))).distinct(), "rule-labels")
    share = min(1.0, SAMPLE / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("_lid"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col("doc_id").alias("_id"), F.col(text).alias("_text"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"))
    rows = rows.join(F.broadcast(chosen), rows["_id"] == F.col("_lid")).dropDuplicates(
        ["_id", "_th", "_y"])
    rows = materialise(rows.select("_id", "_th", "_y", statistics(F.col("_text")).alias("_s"))
                       .select("_id", "_th", "_y", "_s.*"), "rule-sample")
    # An id may have very many texts.
    share = min(1.0, SAMPLE / max(1, rows.count()))
    sample = rows.filter(F.pmod(F.xxhash64("_id", "_th"), F.lit(1 << 30)) < int(
        share * (1 << 30))).toPandas().sort_values(["_id", "_th", "_y"])
    return fit(sample[FEATURES].to_numpy(float), sample["_y"].to_numpy(int))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text",
             threshold: float = 0.3) -> DataFrame:
    """One row per document: `doc_id, _id, _th, held_out, score, predicted`."""
    model = _learn(docs, labels, label, text)
    score = let(statistics(F.col(text)), lambda s: model.score({f: s[f] for f in FEATURES}))
    return docs.select(
        "doc_id", F.col("doc_id").alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"),
        (~in_training(F.col("doc_id"))).alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text",
             threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, scored where they are read."""
    model = _learn(docs, labels, label, text)
    score = let(statistics(F.col(text)), lambda s: model.score({f: s[f] for f in FEATURES}))
    return docs.filter(score >= threshold)
