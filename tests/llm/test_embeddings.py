"""Graph search against brute force: recall, odd vectors, dense groups, several shards."""

import numpy as np
import pytest

from quantloom.llm import embeddings


def brute(rows, cosine=0.95):
    def fine(e):
        return e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)
    n = len(rows)
    unit = [np.array(e, float) / np.linalg.norm(np.array(e, float)) if fine(e) else None for _, e in rows]
    parent, links = list(range(n)), [0] * n

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], links[i], min(ids, default=None), rows[i][0] == min(ids, default=None)))
    return out


def made_up():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + rng.normal(size=16) * rng.choice([0.0, 0.15, 0.3, 2.0])).tolist()) for i in range(240)]
    rows += [(1000 + i, (base[0] + 0.02 * rng.normal(size=16)).tolist()) for i in range(80)]  # more links than a beam holds
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [nan] + [1.0] * 15), (2004, [inf] + [1.0] * 15), (2005, [None] + [1.0] * 15), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, rows[3][1]), rows[5], (None, [-1.0, 0.0]), (2008, [-0.0, 1.0]), (2009, [0.0, 1.0])]
    return rows


@pytest.mark.parametrize("largest", [embeddings.LARGEST, 50])
def test_links_match_brute_force(spark, largest):
    rows = made_up()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, embedding array<float>, node int, n_links string")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]  # as single precision
    got = [tuple(r) for r in embeddings.near_duplicates(df, largest=largest).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    if largest == 50:
        assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_a_large_shard():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 64)).astype(np.float32)
    v[1500:] = v[:1500] + 0.2 * rng.normal(size=(1500, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = embeddings.Graph(v)
    beam, recall = graph.audited_beam(v, 0.95, True)
    a, b = graph.near(v, 0.95, beam)
    truth = v @ v.T >= 0.95
    assert truth[a, b].all() and len(a) >= 0.98 * truth.sum() and truth.sum() > 4000
    assert beam < len(v) / 4 and recall >= 0.98


def test_audit_counts_no_self_hits_and_plants_links(monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(2000, 32)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = embeddings.Graph(v)
    near = graph.near(graph._turned(np.arange(0, 2000, 10), 0.95, rng), 0.95, 40)
    assert len(np.unique(near[0])) >= 196  # every planted query has a link

    def blind(self, queries, least, beam):
        hit = queries @ self.vectors.T >= (least if beam > embeddings.BEAM else 0.9999)
        return np.nonzero(hit)

    monkeypatch.setattr(embeddings.Graph, "near", blind)
    for queries, own in ((v, True), (rng.normal(size=(50, 32)).astype(np.float32), False)):  # no real links at all
        beam, recall = graph.audited_beam(queries, 0.95, own)
        assert beam == 2 * embeddings.BEAM and recall == 1.0


def test_few_links_near_the_threshold_over_six_shards(spark):
    """20,000 vectors, 300 pairs with cosines around the threshold: pairs apart from it by rounding, every shard with every other."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(20_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    away = rng.normal(size=(300, 64))
    away -= (away * v[:300]).sum(axis=1, keepdims=True) * v[:300]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    c = rng.choice([0.94, 0.9499, 0.9501, 0.96, 0.99], size=(300, 1))
    v[19_700:] = c * v[:300] + np.sqrt(1 - c * c) * away
    v = v.astype(np.float32)
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    truth = {(i, j + at) for at in range(0, 20_000, 4000) for i, j in zip(*np.nonzero(unit @ unit[at:at + 4000].T >= 0.95)) if i < j + at}
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, largest=6700).collect()}
    linked = {r for r in got if got[r]["n_links"]}
    found = {(i, j) for i, j in truth if i in linked and j in linked}
    assert len(truth) > 150 and linked <= {k for p in truth for k in p}
    assert len(found) >= 0.98 * len(truth) and all(got[i]["component_id"] == got[j]["component_id"] for i, j in found)
    shown = embeddings.search(df, largest=6700)[2].where("beam IS NOT NULL").collect()
    assert len(shown) == 21 and all(r["recall"] >= embeddings.RECALL for r in shown)


def test_dense_groups_keep_no_pairs():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(9)
    v = rng.normal(size=(3000, 16))
    v[:1500] = v[0] + 0.01 * rng.normal(size=(1500, 16))  # 1.1 million links
    shard = pa.table({"dim": [16] * 3000, "shard": [0] * 3000, "node": np.arange(3000), "copies": np.ones(3000, np.int64), "embedding": v.tolist()})
    graph = embeddings.build(shard).append_column("side", pa.array([0]))
    tracemalloc.start()
    out = embeddings.search_pair(graph, 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = {r["node"]: r["n"] for r in out.to_pylist() if r["n"] is not None}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    truth = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert counts == {i: n for i, n in enumerate(truth.tolist()) if n}
    assert peak < 100e6 and [r["recall"] for r in out.to_pylist() if r["beam"] is not None][0] >= 0.98
