"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(grade > k) = sigmoid(w . x - t_k): all thresholds share the weights w.  The labels only say toxic or
not, so the training grades refine them: among toxic documents, those with more words that the
labels themselves single out are graded higher.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import add_columns, unit

#: Grades: 0 clean, 1 mild, 2 severe.
GRADES = 3
#: The model is fitted on at most this many labelled documents, picked by a hash of their id.
TRAIN = 20_000
#: Words kept as features, those that tell the labels apart best, seen in at least so many sampled documents.
FEATURES, LEAST_DOCS = 400, 8
#: A word is telling if toxic documents hold it this many times as often (natural logarithm).
TELLING = 1.5
#: Words whose ratio is less than this either way are no features, so long texts don't gather their weights.
PLAIN = 1.0
STEPS, RATE, PENALTY = 400, 0.3, 1e-4

WORD = re.compile(r"[^\W\d_]+")


#: Lengths of the word beginnings that are features beside whole words: compounds share them.
BEGINNINGS = (4, 5, 6, 7)
#: A word and its beginnings share so many first letters.
HEAD = min(BEGINNINGS)


def features(text: str | None, heads: frozenset[str] | None = None) -> dict[str, float]:
    """Words and, marked by a star, the beginnings of longer words, with the logarithm of their counts.

    With ``heads``, only of words that begin (or are, if short) like one of them.
    """
    counts: Counter = Counter()
    for w, n in Counter(WORD.findall(text.lower())).items() if text else ():
        if heads is not None and w[:HEAD] not in heads:
            continue
        counts[w] += n
        for k in BEGINNINGS:
            if len(w) > k:
                counts[w[:k] + "*"] += n
    return {f: math.log2(1 + n) for f, n in counts.items()}


def training_labels(labels: DataFrame, most: int = TRAIN, fold: Column | None = None) -> DataFrame:
    """At most ``most`` (doc_id, toxic) rows; several labels of one document give the worse one."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if fold is not None:
        chosen = chosen.where(fold)
    one = chosen.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return one.orderBy(unit(F.col("doc_id"), "toxic:"), "doc_id").limit(most)


class Model:
    """Weights by feature, ordered thresholds, and the least P(grade > 0) that counts as toxic."""

    def __init__(self, weights: dict[str, float], cuts: np.ndarray, least: float):
        self.weights, self.cuts, self.least = weights, cuts, least
        self.heads = frozenset(f[:HEAD] for f in weights)

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        found = features(text, self.heads)
        score = sum(self.weights[f] * found[f] for f in sorted(self.weights.keys() & found.keys()))
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -50, 50)))


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated gradient steps on the mean negative log-likelihood.

    Document rows[i] has feature cols[i] with values[i].  Thresholds are a first one plus exponentials, so they
    stay in order.
    """
    n, k = len(grades), n_grades - 1
    y = grades
    share = [np.clip(np.mean(y > j), 1e-3, 1 - 1e-3) for j in range(k)]
    cuts = np.log((1 - np.array(share)) / np.array(share))
    gaps = np.log(np.maximum(np.diff(cuts), 0.1))
    w, first = np.zeros(n_features), cuts[0]
    params = np.concatenate((w, [first], gaps))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, first, gaps = params[:n_features], params[n_features], params[n_features + 1:]
        cuts = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        s = np.bincount(rows, weights=w[cols] * values, minlength=n)
        up = 1 / (1 + np.exp(np.clip(cuts[None, :] - s[:, None], -40, 40)))  # P(grade > j)
        edge = np.hstack((np.ones((n, 1)), up, np.zeros((n, 1))))
        p = np.maximum(edge[np.arange(n), y] - edge[np.arange(n), y + 1], 1e-12)
        slope = np.hstack((np.zeros((n, 1)), up * (1 - up), np.zeros((n, 1))))
        lower, upper = slope[np.arange(n), y] / p, slope[np.arange(n), y + 1] / p
        ds = -(lower - upper) / n
        gw = np.bincount(cols, weights=ds[rows] * values, minlength=n_features) + PENALTY * w
        gc = np.zeros(k)
        np.add.at(gc, y[y > 0] - 1, lower[y > 0] / n)
        np.add.at(gc, y[y < k], -upper[y < k] / n)
        tail = np.cumsum(gc[::-1])[::-1]
        grad = np.concatenate((gw, [tail[0]], tail[1:] * np.exp(gaps)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - RATE * (1 - step / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, first, gaps = params[:n_features], params[n_features], params[n_features + 1:]
    return w, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def decision(p: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap in P(grade > 0) that gives the training sample the best balance of precision and recall."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + toxic.sum())
    p = np.append(p[order], 0.0)
    f1[p[:-1] == p[1:]] = 0  # equal values can't be told apart
    best = int(np.argmax(f1))
    return float(p[best] + p[best + 1]) / 2


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN, fold: Column | None = None) -> Model | None:
    """Fit on a bounded sample of labelled documents; None if it holds only one kind."""
    chosen = training_labels(labels, most, fold).select(F.col("doc_id").alias("labelled"), "toxic")
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    sample = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))  # at most ``most`` rows
    listed = add_columns(sample.select("doc_id", "toxic", "text"), "text", lambda t: (features(t),), "found map<string, double>")
    listed = stage(listed.dropDuplicates(["doc_id"]), "toxic-sample")
    size = {r["toxic"]: r["n"] for r in listed.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sum(n for t, n in size.items() if t), size.get(0, 0)
    if not bad or not good:
        return None
    seen = listed.select("toxic", F.explode(F.map_keys("found")).alias("word")).groupBy("word").agg(
        F.sum((F.col("toxic") > 0).cast("int")).alias("a"), F.sum((F.col("toxic") == 0).cast("int")).alias("b"))
    ratio = F.ln((F.col("a") + 0.5) / (bad + 1.0)) - F.ln((F.col("b") + 0.5) / (good + 1.0))
    gain = F.abs(F.col("a") / bad - F.col("b") / good) * F.abs(ratio)
    top = seen.where(F.col("a") + F.col("b") >= LEAST_DOCS).select("word", ratio.alias("ratio"), gain.alias("gain"))
    top = top.where(F.abs("ratio") >= PLAIN).orderBy(F.desc("gain"), "word").limit(FEATURES).collect()
    number = {r["word"]: i for i, r in enumerate(top)}
    if not number:
        return None
    telling = np.array([r["ratio"] >= TELLING for r in top])
    known = F.map_filter("found", lambda w, _: w.isin(*number))  # a set to look up; an array would be read from end to end
    rows, cols, values, grades, counts = [], [], [], [], []
    for r in listed.select("doc_id", "toxic", known.alias("found")).orderBy("doc_id").toLocalIterator():
        mine = {number[w]: x for w, x in r["found"].items()}
        rows += [len(grades)] * len(mine)
        cols += mine.keys()
        values += mine.values()
        grades.append(int(r["toxic"] > 0))
        counts.append(sum(x for i, x in mine.items() if telling[i]))
    grades, counts = np.array(grades), np.array(counts)
    middle = np.median(counts[grades > 0])
    grades = np.where((grades > 0) & (counts > middle), 2, grades)
    w, cuts = fit(np.array(rows, int), np.array(cols, int), np.array(values), grades, len(number))
    scores = np.bincount(np.array(rows, int), weights=w[np.array(cols, int)] * np.array(values), minlength=len(grades))
    return Model({r["word"]: float(x) for r, x in zip(top, w) if abs(x) > 1e-6}, cuts, decision(1 / (1 + np.exp(cuts[0] - scores)), grades > 0))


def grade(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, severity (expected grade), grade (most likely), p_toxic, toxic of every document (doc_id, text).

    Reads whole texts.  Null and empty texts have no features and get the grade that the thresholds
    alone give, which is 0 where most labels are clean; without a model all is 0.  Repeated rows stay;
    an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def row(text: str | None) -> tuple:
        if shared.value is None:
            return 0.0, 0, 0.0, False
        up = shared.value.above(text)
        edge = np.concatenate(([1.0], up, [0.0]))
        return float(up.sum()), int(np.argmax(edge[:-1] - edge[1:])), float(up[0]), bool(up[0] >= shared.value.least)

    return add_columns(docs.select("doc_id", "text"), "text", row, "severity double, grade int, p_toxic double, toxic boolean")
