"""Licence families of made-up documents, and the relational score against the plain one."""

import re

import numpy as np
import pytest

from quantloom.llm import licences

PROSE = ["the quick brown fox jumps over the lazy dog and runs into the public library of the town", "this is free time, and the use of words without any restriction is fine", "version 2.0 of the plan was drawn by the people of the town"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [f"{PROSE[i % 3]} {i}\n{PROSE[(i + 1) % 3]}" for i in range(30)]
    texts += [f"{PROSE[0]}\n{t}\n{PROSE[1]}" for family in licences.FAMILIES for t in licences.NOTICES[family][:1]]
    texts += [None, "", "\n\n", "All rights reserved.", "Licensed under the MIT licence." + "\nword" * 20_000, "Permission is hereby granted, free of charge, to any person obtaining a copy"]
    rows = [(i, t, "n", 0) for i, t in enumerate(texts)] + [(None, "Released under the MIT License.", "n", 0), (3, "Released under the MIT License.", "n", 0), (30, texts[30], "n", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, licence string, par int"), rows


def test_families(docs):
    df, rows = docs
    got = licences.scan(df).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert all(r["licence"] == "none" and r["n_notices"] == 0 for i in range(30) if i != 3 for r in by_id[i])
    assert sorted(r["licence"] for r in by_id[3]) == ["mit", "none"]
    for k, family in enumerate(licences.FAMILIES):
        assert {r["licence"] for r in by_id[30 + k]} == {family} and by_id[30 + k][0]["confirmed"]
    assert len(by_id[30]) == 2 and by_id[None][0]["licence"] == "mit"
    k = 30 + len(licences.FAMILIES)
    assert [by_id[k + j][0]["licence"] for j in range(5)] == ["none", "none", "none", "unknown", "mit"]
    assert licences.scan(df.limit(0)).count() == 0


def test_score_is_the_plain_softmax(docs):
    df, rows = docs
    weights, intercepts, temperature = model = licences.train(df)
    kept = {g: v for g, v in weights.items() if np.abs(v - v[0]).max() >= licences.LEAST_WEIGHT}
    for r in licences.scan(df, model).where("confirmed").collect():
        best = 0.0
        for _, text, _, _ in [x for x in rows if x[0] == r["doc_id"]]:
            for line in text.split("\n"):
                w = re.findall(licences.WORD, line.lower())
                s = intercepts + sum((kept.get(g, 0 * intercepts) for g in w + [f"{a} {b}" for a, b in zip(w, w[1:])]), 0 * intercepts)
                p = np.exp((s - s.max()) / temperature)
                best = max(best, (p / p.sum())[licences.CLASSES.index(r["licence"])])
        assert r["probability"] == pytest.approx(best, abs=1e-9)
