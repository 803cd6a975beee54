"""N-gram Jaccard links against all pairs in Python; the tree search by itself; large clusters in blocks."""

import random
from itertools import permutations

import numpy as np
import pytest

from quantloom.llm import jaccard


def grams(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, k, percent):
    sets = [grams(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None] if sets[i] else [d]
        out.append((d, len(sets[i]), min(ids, default=None) if ids else None))
    return out


def made_up(n):
    rng = random.Random(11)
    words = ["Aa", "b", "É", "é", "c\x1c", "d", "eee", "f\xa0g", "h"] + [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(words, k=20))
    base = [" ".join(rng.choices(words, k=rng.choice([2, 3, 5, 30, 60, 90]))) for _ in range(n // 4)]
    docs = []
    for i in range(n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w) + (" " + passage if rng.random() < 0.3 else "")))
    return docs + [(None, docs[3][1]), (None, None), (n, None), (n + 1, ""), (n + 2, " \n"), docs[5], (n + 3, docs[5][1].upper()), (n + 4, "one"), (n + 5, "ONE")]


@pytest.mark.parametrize("block", [None, 8])
def test_components_match_all_pairs(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
        monkeypatch.setattr(jaccard, "GROUP", 5)
    docs = made_up(160)
    if block:  # one chain of near copies, so that a cluster has several blocks
        w = [f"z{i}" for i in range(120)]
        docs += [(1000 + i, " ".join(w[:i] + [f"y{i}"] + w[i + 1:])) for i in range(60)]
        docs += [(2000 + i, " ".join(w[3 * i:] + [f"x{i}_{k}" for k in range(3 * i)])) for i in range(12)]
    df = spark.createDataFrame([(*x, "n", 5) for x in docs], "doc_id long, text string, component string, node int")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(got, key=key) == sorted(brute(docs, 4, 85), key=key)
    if not block:
        assert jaccard.link(df.limit(0)).count() == 0
        kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in jaccard.distinct_documents(df, 4, 85).collect())
        want = brute(docs, 4, 85)
        firsts = {r for r in want if r[1] and r[0] == r[2]} | {(r[0], 0, i) for i, r in enumerate(want) if not r[1]}
        assert kept == sorted((r[0] is None, r[0] or 0) for r in firsts)


def test_tree_search_alone():
    rng = np.random.default_rng(4)
    base = [rng.choice(400, 60, replace=False) for _ in range(6)]
    sets = [np.unique(np.concatenate([rng.permutation(base[i % 6])[:rng.integers(52, 60)], rng.choice(2000, rng.integers(0, 6))])).astype(np.uint64) for i in range(120)]
    link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    for split in (None, 70):
        parent = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if link(sets[i], sets[j]) and (split is None or j < split <= i):
                    parent = [parent[j] if p == parent[i] else p for p in parent] if parent[i] != parent[j] else parent
        got = jaccard.joined(sets, list(range(len(sets))), 80, split)
        assert len({(a, b) for a, b in zip(got, parent)}) == len(set(got)) == len(set(parent))


@pytest.mark.parametrize("split", [None, 3])
def test_lengthened_copies_link_in_every_order(split):
    a = np.arange(400, dtype=np.uint64)
    d = np.concatenate([a[4:], np.arange(9000, 9004, dtype=np.uint64)])  # one word changed
    b, c = np.arange(500, dtype=np.uint64), np.arange(450, dtype=np.uint64)
    for order in permutations([a, d, b, c]):
        known = list(range(4)) if split is None else [0, 0, 0, 3]
        assert jaccard.joined(list(order), known, 85, split) == [0] * 4


def test_long_sets_that_share_one_ngram_are_not_linked(spark):
    rng = random.Random(5)
    one, other = ([f"{c}{rng.randrange(10**9)}" for _ in range(5000)] for c in "ab")
    texts = [one, other[:4900], one[:4020], one[:200], other[:180]]  # bitmaps of three widths
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    sig = jaccard.signatures(docs, 5, 80, np.zeros(1 << jaccard.SLOT_BITS, np.uint8)).persist()
    nodes = [r["node"] for r in sig.orderBy("doc_id").collect()]
    links = jaccard.near_pairs(sig.selectExpr("1L AS gram", "node", "n", "parity"), 80).collect()
    assert sorted(tuple(sorted(nodes.index(x) for x in r)) for r in links) == [(0, 2)]


def test_folded_bitmaps_are_those_of_the_narrower_width(monkeypatch):
    grams = np.unique(np.random.default_rng(6).integers(0, 2**63, 9000).astype(np.uint64))
    wide = jaccard.parity_bits(grams).view(np.uint64)
    monkeypatch.setattr(jaccard, "PARITY_MOST", 2048)
    assert len(wide) == 8192 // 64 and (jaccard.folded(wide, 32) == jaccard.parity_bits(grams).view(np.uint64)).all()


def test_texts_meet_the_kept_documents_in_one_exchange(spark):
    docs = spark.createDataFrame([(i % 7, f"some words of text {i % 9}", None) for i in range(40)] + [(None, "no id here", 1), (None, "no id here", 2), (0, "no id here at all", 3), (8, None, 4)], "doc_id long, text string, n_chars long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jaccard.distinct_documents(docs, 5, 80)
        todo, found = [out._jdf.queryExecution().executedPlan().initialPlan()], 0
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            found += node.nodeName() == "Exchange" and "STRING" in node.schema().toDDL()  # only texts are strings
        assert found == 1
        rows = sorted((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == [("", 8), ("no id here", -1), ("no id here at all", 0)] + [(f"some words of text {k}", min(i % 7 for i in range(40) if i % 9 == k)) for k in range(9)]
