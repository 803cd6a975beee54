"""Ordinal regression against a direct likelihood, and held-out accuracy on the given labels."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_fit_follows_the_likelihood():
    rng = np.random.default_rng(0)
    x = (rng.random((600, 4)) < 0.4).astype(float)
    s = x @ np.array([3.0, -2.0, 0.0, 1.0]) + rng.logistic(size=600)
    y = (s > 0).astype(int) + (s > 2.5)
    rows, cols = np.nonzero(x)
    w, cuts = toxicity.fit(rows, cols, np.ones(len(rows)), y, 4)

    def loss(w, cuts):
        up = 1 / (1 + np.exp(cuts[None, :] - (x @ w)[:, None]))
        edge = np.hstack((np.ones((600, 1)), up, np.zeros((600, 1))))
        return -np.mean(np.log(edge[np.arange(600), y] - edge[np.arange(600), y + 1])) + toxicity.PENALTY / 2 * w @ w

    best = loss(w, cuts)
    assert cuts[0] < cuts[1]
    for _ in range(300):
        assert best <= loss(w + rng.normal(0, 0.05, 4), cuts + rng.normal(0, 0.05, 2)) + 1e-6
    assert w == pytest.approx([3, -2, 0, 1], abs=0.6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    truth = labels.where(~fold).select("doc_id", F.col("toxic").alias("truth"))
    got = toxicity.grade(docs, toxicity.train(docs, labels, fold=fold)).join(truth, "doc_id").toPandas()
    bad = got[got.truth == 1]

    assert len(bad) > 100 and bad.toxic.mean() >= 0.9
    assert got[got.truth == 0].toxic.mean() <= 0.005


def test_odd_rows(spark):
    rows = [(i, ["plain words here", "plain scum idiot words", "scum words here plain"][i % 3], int(i % 3 > 0)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows] + [(None, None, "z"), (90, "", "z"), (1, "plain scum", "z"), (91, "SCUM! " + "plain " * 30_000, "z")], "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(None, 1, 1), (5, None, 0), (500, 1, 0), (3, 0, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.grade(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 64
    assert all(r["toxic"] == (r["doc_id"] is not None and r["doc_id"] != 90 and (r["doc_id"] == 91 or r["doc_id"] % 3 > 0)) for r in got)
    assert all(0 <= r["severity"] <= 2 for r in got)
    assert toxicity.grade(docs.limit(0), None).count() == 0
    assert toxicity.train(docs, labels.limit(0)) is None
    assert [r["toxic"] for r in toxicity.grade(docs.limit(2), None).collect()] == [False, False]


def test_grades_are_those_of_a_plain_loop(spark):
    import math

    cuts, least = [1.0, 2.5], 0.4
    texts = ["you total idiot", "a calm and pleasant day", "idiot idiot idiot, you IDIOT", "", None, "pleasant\n" * 5000 + "idiot"]
    weights = {f: x for f, x in zip(sorted(toxicity.features(texts[0]).keys() | toxicity.features(texts[1]).keys()), np.linspace(-2, 3, 40))}
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(0, texts[0], 9)], "doc_id long, text string, grade int")
    got = toxicity.grade(docs, toxicity.Model(weights, np.array(cuts), least)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        score = sum(weights.get(f, 0.0) * x for f, x in toxicity.features(texts[r.doc_id]).items())
        up = [1 / (1 + math.exp(min(max(c - score, -50), 50))) for c in cuts]
        chance = [1 - up[0], up[0] - up[1], up[1]]
        assert r.severity == pytest.approx(sum(k * p for k, p in enumerate(chance)), abs=1e-12)
        assert r.grade == chance.index(max(chance)) and r.p_toxic == pytest.approx(up[0], abs=1e-12) and r.toxic == (up[0] >= least)


def test_features_of_known_heads_are_all_that_a_model_needs():
    rng = np.random.default_rng(1)
    letters = list("abcdé")
    words = ["".join(rng.choice(letters, rng.integers(1, 10))) for _ in range(4000)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(20)] + ["", None, "AB ab\nAB, abc_abc 1ab2"]
    every = sorted(set().union(*(toxicity.features(t) for t in texts)))
    weights = {f: float(x) for f, x in zip(rng.choice(every, 60, replace=False), rng.normal(size=60))} | {"ab": 1.0}
    model = toxicity.Model(weights, np.array([0.0, 1.0]), 0.5)
    for t in texts:
        some, full = toxicity.features(t, model.heads), toxicity.features(t)
        assert len(some) < max(len(full), 1) / 2 + 3 and {f: x for f, x in full.items() if f in weights} == {f: x for f, x in some.items() if f in weights}
