"""Optimal books against random feasible books, dense systems, and what limits must do."""

import datetime as dt

import numpy as np
import pytest

from quantloom.operators import allocation, interior, optimise

DAYS = [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 29)]


def row(rng, p=8, window=63, cap=0.5, **more):
    tickers = [f"T{i}" for i in range(p)]
    half = p // 2
    base = {
        "date": DAYS[0], "window": window, "max_position": cap, "ticker": tickers, "er": rng.normal(0.05, 0.05, p).tolist(), "cap": [cap] * p, "adtv": [0.5] * p,
        "asset_class": ["equity"] * half + ["fibra"] * (p - half), "class_min": [0.1] * half + [0.05] * (p - half), "class_max": [0.95] * half + [0.9] * (p - half),
        "issuer": [None] * p, "anchor": [None] * p, "anchor_min": [None] * p, "anchor_max": [None] * p,
        "n": [window] * p, "ages": list(range(window)) * p, "rets": rng.normal(0, 0.01, window * p).tolist()}
    return base | more


def value(r, s, w, held):
    """Objective from plain definitions."""
    grid = optimise._paths(r)
    w, er = np.asarray(w), np.asarray(r["er"])
    scale = max(np.abs(er).mean(), 1e-4)
    if s.kind == "cvar":
        book = grid @ w * 252
        risk = -book[book <= np.percentile(book, 100 * (1 - s.alpha)) + 1e-12].mean()
        vol = (grid * 252).std(axis=0, ddof=1)
    else:
        z = grid - grid.mean(axis=0)
        shrink, mu = optimise._intensity(z)
        cov = ((1 - shrink) * z.T @ z / len(z) + shrink * mu * np.eye(len(w))) * 252 + 1e-8 * np.eye(len(w))
        risk, vol = w @ cov @ w, np.sqrt(np.diag(cov))
    moved = np.abs(w - held)
    return -w @ er + s.risk_aversion * risk + s.turnover_penalty * scale * moved.sum() + s.impact_eta * (vol / 0.5 * moved).sum()


@pytest.mark.parametrize("kind, window", [("mv", 63), ("cvar", 252)])
def test_no_random_book_is_better(kind, window):
    rng = np.random.default_rng(1)
    r = row(rng, window=window)
    s = optimise.Strategy(kind, target=1.0, risk_aversion=4.0 if kind == "mv" else 2.0)
    held = dict(zip(r["ticker"], np.full(8, 0.125)))
    out = optimise._book(r, s, held)
    assert out["status"] == "full" and sum(out["weight"]) == pytest.approx(1.0) and max(out["weight"]) <= 0.5 + 1e-9
    best = value(r, s, out["weight"], 0.125)
    for k in range(400):
        w = rng.dirichlet(np.full(8, 0.3 + k % 5)) if k % 2 else np.maximum(np.asarray(out["weight"]) + rng.normal(0, 0.01, 8), 0)
        w = w / w.sum()
        if w.max() <= 0.5 and 0.1 <= w[:4].sum() <= 0.95:
            assert value(r, s, w, 0.125) >= best - 1e-6


def test_small_system_equals_dense():
    rng = np.random.default_rng(2)
    n, f = 40, 5
    args = dict(q=np.full(n, 0.1), factor=rng.normal(size=(f, n)), c=rng.normal(size=(3, n)), equal=np.ones((1, n)), total=np.array([1.0]), low=np.zeros(n), high=np.full(n, 0.2),
                rows=np.zeros((0, n)), limit=np.zeros(0), weight=np.full(n, 0.01), place=np.full(n, 1 / n), kinks=np.zeros((0, n)), level=np.zeros(0), kink_weight=np.zeros(0))
    small = interior.solve(**args)
    dense = interior.solve(**(args | {"factor": np.vstack((args["factor"], np.zeros((n, n))))}))
    assert small.solved.all() and dense.solved.all() and np.abs(small.x - dense.x).max() < 1e-6


def test_bands_wide_and_narrow():
    rng = np.random.default_rng(3)
    r = row(rng, p=4, cap=0.5, er=[0.08, 0.05, 0.06, 0.07], class_min=[0.1, 0.1, 0.05, 0.05], class_max=[0.95, 0.95, 0.9, 0.9])
    s = optimise.Strategy("mv", target=1.0)
    bands = lambda a, b: {"anchor": ["Industrial"] * 2 + ["FIBRA"] * 2, "anchor_min": [a[0]] * 2 + [b[0]] * 2, "anchor_max": [a[1]] * 2 + [b[1]] * 2}
    free, wide = optimise._book(r, s, {}), optimise._book(r | bands((0, 1), (0, 1)), s, {})
    assert np.abs(np.subtract(free["weight"], wide["weight"])).sum() < 1e-3
    w = optimise._book(r | bands((0.30, 0.34), (0.66, 0.70)), s, {})["weight"]
    assert 0.30 - 1e-6 <= w[0] + w[1] <= 0.34 + 1e-6 and 0.66 - 1e-6 <= w[2] + w[3] <= 0.70 + 1e-6


def test_limits_that_exclude_each_other_and_short_inputs():
    rng = np.random.default_rng(4)
    r = row(rng, p=4)
    s = optimise.Strategy("mv", target=1.0)
    clash = r | {"issuer": ["x"] * 4}  # a tenth for all, and the budget is one
    out = optimise._book(clash, s, {})
    assert out["status"] == "budget" and sum(out["weight"]) == pytest.approx(1.0)
    assert optimise._book(r | {"cap": [0.2] * 4}, s, {})["status"] == "even"
    few = row(rng, p=4, window=10)
    assert optimise._book(few, optimise.Strategy("cvar", target=1.0), {})["weight"] == [0.25] * 4
    none = r | {"n": [0] * 4, "ages": [], "rets": []}
    assert optimise._book(none, s, {})["status"] == "full"
    over = r | {"class_min": [0.9] * 2 + [0.9] * 2, "class_max": [1.0] * 4}  # minima above the budget are scaled
    assert optimise._book(over, s, {})["status"] == "full"


def test_costs_refer_to_the_held_book():
    rng = np.random.default_rng(5)
    r, held = row(rng), dict(zip([f"T{i}" for i in range(8)], np.r_[np.full(4, 0.2), np.full(4, 0.05)]))
    stay = optimise._book(r, optimise.Strategy("mv", target=1.0, turnover_penalty=1e4), held)
    assert np.abs(np.subtract(stay["weight"], list(held.values()))).max() < 1e-5


def test_resampled_is_the_mean_of_single_books():
    rng = np.random.default_rng(6)
    r = row(rng)
    s = optimise.Strategy("robust", target=1.0, n_sims=6)
    out = optimise._book(r, s, {})
    z = optimise._paths(r)
    z = z - z.mean(axis=0)
    shrink, mu = optimise._intensity(z)
    day, sims = (r["date"] - dt.date(1970, 1, 1)).days, np.arange(6)
    drawn = np.asarray(r["er"]) + np.sqrt((1 - shrink) / 63 / 252) * optimise._noise(42, 41, sims, day, 63) @ z + np.sqrt(shrink * mu / 252) * optimise._noise(42, 43, sims, day, 8)
    each = [optimise._book(r | {"er": e.tolist()}, optimise.Strategy("mv", target=1.0), {})["weight"] for e in drawn]
    assert np.abs(np.mean(each, axis=0) - out["weight"]).max() < 1e-5


def test_many_names_are_solved_to_the_end_in_few_steps(monkeypatch):
    rng = np.random.default_rng(0)
    p = 100
    second = [i % 5 == 0 for i in range(p)]
    r = row(rng, p=p, cap=0.15, er=rng.normal(0, 1, p).tolist(), asset_class=["fibra" if f else "equity" for f in second], class_min=[0.045 if f else 0.45 for f in second],
            class_max=[0.27 if f else 0.81 for f in second], issuer=[f"I{i % 12}" for i in range(p)], rets=rng.normal(0, 0.002, 63 * p).tolist())
    steps, longest = [0], interior._longest

    def counted(value, change):
        steps[0] += len(value)
        return longest(value, change)

    monkeypatch.setattr(interior, "_longest", counted)
    out = optimise._book(r, optimise.Strategy("robust"), {})
    assert out["status"] == "full" and out["gap"] < 1e-6
    assert steps[0] / 12 < 40 * 100  # twelve looks a step; as many problems as simulations


def test_books_walk_dates_in_order(spark):
    rng = np.random.default_rng(7)
    tickers = [f"T{i}" for i in range(6)]
    names = spark.createDataFrame([(d, t, float(rng.normal(0.05, 0.05))) for d in DAYS for t in tickers], "as_of date, ticker string, expected_return double")
    universe = spark.createDataFrame([(t, "equity" if i < 4 else "fibra", f"I{i // 5}", None, 0.5) for i, t in enumerate(tickers)],
                                     "ticker string, asset_class string, issuer_id string, max_position_override double, liquidity_score double")
    bounds = spark.createDataFrame([("equity", 0.2, 0.9), ("fibra", 0.05, 0.5)], "asset_class string, min_weight double, max_weight double")
    days = np.arange("2023-10-02", "2024-04-01", dtype="datetime64[D]")
    returns = spark.createDataFrame([(d.astype(object), t, float(rng.normal(0, 0.01))) for d in days if np.is_busday(d) for t in tickers], "date date, ticker string, ret double")
    settings = {"a": optimise.Strategy("mv", target=0.5, turnover_penalty=5.0), "b": optimise.Strategy("mv", target=0.6)}
    whole = optimise.problems(names, universe, bounds, returns, max_position=0.3)
    out = {(r["strategy_id"], r["date"]): r for r in optimise.books(whole, settings).collect()}
    assert len(out) == 6 and {r["status"] for r in out.values()} == {"budget"}  # five names of one issuer: a tenth
    apart = universe.withColumn("issuer_id", universe["ticker"])
    packed = optimise.problems(names, apart, bounds, returns, max_position=0.3)
    solved = optimise.books(packed, settings)
    out = {(r["strategy_id"], r["date"]): r for r in solved.collect()}
    for s in "ab":
        assert [v for v in out["a", DAYS[0]]["held"]] == [0.0] * 6
        for before, after in zip(DAYS, DAYS[1:]):
            assert out[s, after]["held"] == pytest.approx(out[s, before]["weight"])
    early = optimise.books(packed.where(f"date <= '{DAYS[1]}'"), settings).collect()
    assert all(r["weight"] == pytest.approx(out[r["strategy_id"], r["date"]]["weight"]) for r in early) and len(early) == 4
    for s, setting in settings.items():
        proof = optimise.certificate(solved.where(f"strategy_id = '{s}'"), packed, setting).collect()
        assert len(proof) == 3 and all(abs(r["gap"]) < 1e-5 and r["violation"] < 1e-6 for r in proof)
    w = optimise.weights(solved).withColumnRenamed("date", "as_of")
    assert allocation.violations(w.where("strategy_id = 'a'"), apart, bounds, 0.5, 0.3).count() == 0
    assert optimise.books(packed.limit(0), settings).count() == 0


def test_weighted_window_is_the_exponential_covariance():
    raw, decay = np.random.default_rng(5).normal(size=(80, 4)), 0.94
    weight = np.array([decay**a * (1.0 if a == 79 else 1.0 - decay) for a in range(80)])  # youngest row first
    assert weight.sum() == pytest.approx(1.0)
    mean = weight @ raw
    want = sum(w * np.outer(x - mean, x - mean) for w, x in zip(weight, raw)) / (1.0 - (weight**2).sum())
    z = optimise._weighted(raw, decay)
    assert np.allclose(z.T @ z / 80, want, atol=1e-12)


def test_decay_changes_a_book_only_with_enough_rows():
    from datetime import date

    rng = np.random.default_rng(6)

    def weight(rows, decay):
        p = 6
        paths = rng_paths[rows]
        row = {"window": rows, "max_position": 0.5, "date": date(2020, 1, 31), "ticker": list("abcdef"), "er": [0.1, 0.05, 0.0, 0.02, 0.07, 0.03], "cap": [0.5] * p, "adtv": [0.5] * p,
               "asset_class": ["equity"] * p, "class_min": [0.0] * p, "class_max": [1.0] * p, "issuer": [None] * p, "anchor": [None] * p, "anchor_min": [None] * p, "anchor_max": [None] * p,
               "n": [rows] * p, "ages": list(range(rows)) * p, "rets": list(paths.T.ravel())}
        return np.array(optimise._book(row, optimise.Strategy("mv", decay=decay), {})["weight"])

    rng_paths = {rows: rng.normal(0, 0.02, (rows, 6)) * np.linspace(0.5, 2, rows)[:, None] for rows in (40, 120)}
    assert np.array_equal(weight(40, None), weight(40, 0.9))
    assert np.abs(weight(120, None) - weight(120, 0.9)).max() > 1e-4
