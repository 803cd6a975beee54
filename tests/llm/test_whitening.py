"""Whitening against dense computations in whole numbers and double precision."""

import math
from fractions import Fraction

import numpy as np
import pytest

from quantloom.llm import whitening
from quantloom.llm.catalog import QUERIES

SCHEMA = "vec_id long, embedding array<float>, n string, deviation int, whitened int"


def brute(rows, most=8):
    """Rows of the contract by dense matrices: {vec_id: (n, deviation, whitened, explained)}."""
    fine = [(i, [float(c) for c in e]) for i, e in rows if e and all(c is not None and np.isfinite(c) for c in e)]
    out = {}
    for dim in {len(e) for _, e in fine}:
        ids = [i for i, e in fine if len(e) == dim]
        x = [[math.floor(1024 * c) + 100000 for c in e] for _, e in fine if len(e) == dim]
        n, s = len(x), [sum(c) for c in zip(*x)]
        y = np.array([[n * a - b for a, b in zip(r, s)] for r in x], object)
        v = np.array([[float(Fraction(int((y[:, i] * y[:, j]).sum()), n**3)) for j in range(dim)] for i in range(dim)])
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
        w = (y / n).astype(float) @ axes / np.sqrt(np.maximum(values, 1e-300))
        for k, i in enumerate(ids):
            out[i] = (n, int((y[k] ** 2).sum()), w[k], values / np.trace(v), v)
    return out


def check(got, want, live=8):
    assert {r["vec_id"] for r in got} == set(want) and len(got) == len(want)
    ids = sorted(want)
    w = np.array([[np.nan if c is None else c for c in r["whitened"]] for r in sorted(got, key=lambda r: r["vec_id"])])
    b = np.array([want[i][2] for i in ids])
    for k in range(live):
        assert min(np.abs(w[:, k] - b[:, k]).max(), np.abs(w[:, k] + b[:, k]).max()) < 1e-6 * max(1, np.abs(b[:, k]).max())
    for r in got:
        assert (r["n"], r["deviation"]) == want[r["vec_id"]][:2]
        assert np.allclose(r["explained"][:live], want[r["vec_id"]][3][:live], rtol=1e-9)
        assert r["identity_error"] < 1e-8


def test_matches_dense(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) @ np.diag(np.arange(12, 0, -1) / 8) + 3
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(900, rows[0][1]), (901, rows[0][1])]
    odd = [(1000, None), (1001, []), (1002, [None] + [1.0] * 11), (1003, [float("nan")] * 12), (1004, [float("inf")] + [0.0] * 11)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows + odd], SCHEMA)
    check(whitening.whiten(df.repartition(5)).collect(), brute(rows + odd))
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.where("vec_id >= 1000")).collect() == []


def test_few_vectors_flat_dimensions_and_lengths(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 1.0]), (3, [0.5, 2.0, 3.0]), (10, [7.0]), (11, [7.0]), (20, [0.0] * 9)]
    got = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want = brute(rows)
    check([got[i] for i in (1, 2, 3)], {i: want[i] for i in (1, 2, 3)}, live=2)
    assert [got[1]["whitened"][2] is None, len(got[1]["whitened"]), got[1]["n"]] == [True, 3, 3]
    for i in (10, 20):
        assert got[i]["deviation"] == 0 and set(got[i]["whitened"]) == {None} and set(got[i]["explained"]) == {None} and got[i]["identity_error"] is None


def test_huge_entries_stay_exact(spark):
    rng = np.random.default_rng(4)
    big = (rng.normal(size=(40, 2)) * 2.0**40).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(big)] + [(99, [3e38, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in whitening.whiten(df).collect()}
    assert len(got) == 41 and got[0]["deviation"] is None and all(r["identity_error"] < 1e-8 for r in got.values())
    z = (big.astype(np.float64) * 64).astype(np.int64)
    q = whitening.exact_squares(z)
    whole = [[int(c) for c in r] for r in z]
    assert q.tolist() == [sum(a * a for a, _ in whole), sum((a + b) ** 2 for a, b in whole), sum(b * b for _, b in whole)]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_on_given_tables(spark, folder):
    sf = f"/root/testdata/{folder}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows)
    got = QUERIES["op13_whitening"](spark, sf).collect()
    assert len(got) == 8 * len(want) and len({(r["vec_id"], r["component"]) for r in got}) == len(got)
    w = {k: np.array([r["whitened"] for r in sorted(got, key=lambda r: r["vec_id"]) if r["component"] == k]) for k in range(1, 9)}
    b = np.array([want[i][2] for i in sorted(want)])
    for k in w:
        sign = np.sign(w[k] @ b[:, k - 1])
        assert np.abs(sign * w[k] - b[:, k - 1]).max() < 1e-6
    for r in got:
        n, deviation, _, explained, _ = want[r["vec_id"]]
        assert (r["n"], r["deviation"]) == (n, deviation) and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-8


def test_lengths_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=5 + i % 3).astype(np.float32).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, whitening.whiten(df).drop("identity_error").collect()))
    monkeypatch.setattr(whitening, "MODEL_CELLS", 1)
    assert len(whole) == 60 and sorted(map(tuple, whitening.whiten(df).drop("identity_error").collect())) == whole


def test_projections_add_up_in_order():
    rng = np.random.default_rng(10)
    z = rng.integers(-5000, 5000, (50, 9))
    axes = np.linalg.qr(rng.normal(size=(9, 9)))[0][:3]
    model = {"fitted": 50, "rest": z.sum(axis=0).tolist(), "axes": axes.tolist(), "variances": [4.0, 2.0, 1e-14], "trace": 9.0}
    n, deviation, whitened, explained = (a.to_pylist() for a in whitening.projections(z, model))
    for row, d, w in zip(z.tolist(), deviation, whitened):
        assert d == sum((50 * a - b) ** 2 for a, b in zip(row, model["rest"]))
        dots = [0.0, 0.0]
        for k in range(2):
            for a, b, c in zip(row, model["rest"], model["axes"][k]):
                dots[k] += (a - b / 50) * c
        assert w == [dots[0] / math.sqrt(4.0), dots[1] / math.sqrt(2.0), None]
    assert set(n) == {50} and explained[0] == [4.0 / 9, 2.0 / 9, 1e-14 / 9]


def test_vectors_are_not_exchanged(spark):
    df = spark.createDataFrame([(i, [float(i % 7), i * 0.5, 1.0 / (i + 1)]) for i in range(50)], "vec_id long, embedding array<float>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        todo = [whitening.whiten(df)._jdf.queryExecution().executedPlan().initialPlan()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        assert node.nodeName() != "Exchange" or "vec_id" not in node.schema().toDDL()
