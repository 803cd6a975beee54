"""Operators on small fixtures against direct computations and invariants."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import allocation, backtest, covariance, forecast, joins, overfitting, overlay, posterior, regimes, resampling, search, tails, volatility
from quantloom.settings import DEFAULTS, resolve
from quantloom.sources import panel

DAYS = pd.bdate_range("2020-01-01", periods=320)


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(5)
    pdf = pd.concat([pd.DataFrame({"date": DAYS.date, "ticker": t, "ret": rng.normal(0.0003, 0.01 + 0.002 * i, len(DAYS))}) for i, t in enumerate("ABCDEFGH")])
    return spark.createDataFrame(pdf), pdf


def test_asof_join_never_sees_the_future(spark):
    left = spark.createDataFrame([(dt.date(2024, 1, d), "A") for d in (1, 10, 11, 31)], "date date, ticker string")
    right = spark.createDataFrame([(dt.date(2024, 1, 10), "A", 1.0), (dt.date(2024, 1, 20), "A", None), (dt.date(2024, 1, 10), "B", 9.0)], "date date, ticker string, v double")
    for join in (joins.asof_join, joins.asof_by_window):
        rows = {r.date.day: r.v for r in join(left, right, ["ticker"], ["v"]).collect()}
        assert rows == {1: None, 10: 1.0, 11: 1.0, 31: None}  # the NULL of the later report stays


def test_limited_fill_stops_after_five_rows(spark):
    cells = spark.createDataFrame([(dt.date(2024, 1, 1), "A", 1.0), (dt.date(2024, 1, 12), "A", 2.0)], "date date, ticker string, price double")
    got = panel.dense_prices(cells).orderBy("date").toPandas()
    assert len(got) == 10 and got.price.isna().sum() == 3 and got.price.iloc[5] == 1.0


def test_backtest_applies_weights_the_next_day(spark, returns):
    df, pdf = returns
    first, second = DAYS[20].date(), DAYS[60].date()
    w = spark.createDataFrame([("s", first, "A", 1.0), ("s", second, "B", 0.6), ("s", second, "A", 0.4)], "strategy_id string, date date, ticker string, weight double")
    got = backtest.strategy_returns(w, df, cost=0.001).orderBy("date").toPandas().set_index("date")
    wide = pdf.pivot(index="date", columns="ticker", values="ret")
    assert got.ret[first] == pytest.approx(-0.001)
    assert got.ret[DAYS[21].date()] == pytest.approx(wide.A[DAYS[21].date()])
    assert got.ret[second] == pytest.approx(wide.A[second] - 0.001 * 1.2)
    after = DAYS[61].date()
    assert got.ret[after] == pytest.approx(0.4 * wide.A[after] + 0.6 * wide.B[after])
    assert len(got) == len(DAYS)


def test_ledoit_wolf_matches_closed_form(spark, returns):
    df, pdf = returns
    end = DAYS[-1].date()
    asof = spark.createDataFrame([(end,)], "date date")
    got = covariance.ledoit_wolf(df, asof, 63).toPandas()
    x = pdf.pivot(index="date", columns="ticker", values="ret").to_numpy()[-63:]
    z = x - x.mean(0)
    n, p = z.shape
    s = z.T @ z / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min((((z ** 2).T @ (z ** 2)).sum() / n - (s ** 2).sum()) / (p * n), delta)
    want = (1 - beta / delta) * s + beta / delta * mu * np.eye(p)
    names = sorted("ABCDEFGH")
    for r in got.itertuples():
        assert r.cov == pytest.approx(want[names.index(r.ticker_i), names.index(r.ticker_j)], abs=1e-15)
    cells = covariance.centred(covariance.window_returns(df, asof, 63))
    k = allocation.factored_shrinkage(cells).collect()[0]
    assert k.shrinkage == pytest.approx(beta / delta, abs=1e-12) and k.mu == pytest.approx(mu)


def test_black_litterman_matches_matrix_formula(spark, returns):
    df, _ = returns
    asof = spark.createDataFrame([(DAYS[-1].date(),)], "date date")
    cov = covariance.ledoit_wolf(df, asof, 63)
    market = spark.createDataFrame([(t, 1 / 8) for t in "ABCDEFGH"], "ticker string, market_weight double")
    views = spark.createDataFrame([(DAYS[-1].date(), "B", 0.02, 0.6), (DAYS[-1].date(), "F", -0.01, 0.3)], "as_of date, ticker string, view double, confidence double")
    got = posterior.black_litterman(df, asof, market, views).orderBy("ticker").toPandas()
    m = np.zeros((8, 8))
    for r in cov.toPandas().itertuples():
        i, j = "ABCDEFGH".index(r.ticker_i), "ABCDEFGH".index(r.ticker_j)
        m[i, j] = m[j, i] = r.cov
    pi = 2.5 * m @ np.full(8, 1 / 8)
    pick = np.zeros((2, 8))
    pick[0, 1] = pick[1, 5] = 1
    omega = np.diag([0.05 / 0.6, 0.05 / 0.3]) + 1e-6 * np.eye(2)
    post = pi + 0.05 * m @ pick.T @ np.linalg.solve(pick @ (0.05 * m) @ pick.T + omega, np.array([0.02, -0.01]) - pick @ pi)
    np.testing.assert_allclose(got.posterior, post, atol=1e-12)


def test_elastic_net_from_grams_solves_the_problem():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    y = x @ [0.5, 0.0, -0.3, 0.0] + rng.normal(0, 0.2, 400)
    z = np.column_stack([np.ones(400), x, y])
    folds = np.stack([z[i::5].T @ z[i::5] for i in range(5)])
    coef, intercept, penalty, ratio = forecast.solve_elastic_net(folds, [0.1, 0.5, 0.9], 10000)
    sd, zx, yc = x.std(0), (x - x.mean(0)) / x.std(0), y - y.mean()
    w = coef * sd
    grad = zx.T @ (zx @ w - yc) / 400 + penalty * (1 - ratio) * w  # stationarity of the penalised loss
    for g, v in zip(grad, w):
        assert abs(g + penalty * ratio * np.sign(v)) < 1e-6 if abs(v) > 1e-9 else abs(g) <= penalty * ratio + 1e-6
    assert intercept == pytest.approx(y.mean() - coef @ x.mean(0))


def test_many_elastic_nets_follow_their_penalties_together(monkeypatch):
    rng = np.random.default_rng(3)
    sets, models = [[0.1, 0.5, 0.9], [0.9]], []
    for m in range(6):
        x = rng.normal(size=(300, 5))
        x[:, 4] = x[:, 3] + 0.01 * rng.normal(size=300) if m % 2 else 0.0
        z = np.column_stack([np.ones(300), x, x @ [0.5, 0.0, -0.3, 0.2, 0.0] + rng.normal(size=300)])
        models.append(np.stack([z[i::5].T @ z[i::5] for i in range(5)]))
    n, _, _, xx, xy = forecast._centre(models[1].sum(0))
    top = np.abs(xy).max() / n * np.geomspace(1.0, 1e-3, 30)[None]
    one = (xx[None], xy[None], np.asarray([n]), 0.5 * top, 0.5 * top, 10000)
    assert np.allclose(forecast.follow(*one), forecast.descend(*one), atol=1e-9)
    systems, solve = [0], np.linalg.solve

    def counted(a, b):
        systems[0] += len(a)
        return solve(a, b)

    monkeypatch.setattr(forecast, "descend", lambda *_: pytest.fail("swept"))
    monkeypatch.setattr(np.linalg, "solve", counted)
    together = forecast.solve_many(np.stack(models), sets, 10000)
    assert systems[0] < 1.5 * 6 * 5 * 3 * forecast.N_PENALTIES  # little more than one small system per fold, ratio and penalty
    for folds, found in zip(models, together):
        for alone, m in zip(forecast.solve_elastic_nets(folds, sets, 10000), found):
            assert alone[2:] == m[2:] and np.allclose(alone[0], m[0], atol=1e-9) and alone[1] == pytest.approx(m[1])


def test_elastic_net_takes_no_more_steps_when_copied_columns_hardly_vary(monkeypatch):
    """Averages of more facts vary less about the same mean, so copies of a column agree only to rounding."""
    rng = np.random.default_rng(6)
    d, noise = rng.normal(size=(400, 4)), rng.normal(size=400)
    systems, solve = [0], np.linalg.solve

    def counted(a, b):
        systems[0] += len(a)
        return solve(a, b)

    def net(width, signal):
        x = 1.0 + width * d
        z = np.column_stack([np.ones(400), x, 1.0 + 10.0 * x[:, 0], 0.5 * x[:, 0], 3.0 * x[:, 1], signal * d @ [0.5, 0.2, -0.3, 0.0] + noise])
        systems[0] = 0
        coef, _, penalty, ratio = forecast.solve_elastic_net(np.stack([z[i::5].T @ z[i::5] for i in range(5)]), [0.1, 0.5, 0.9], 10000)
        return systems[0], coef * width, penalty, ratio

    monkeypatch.setattr(np.linalg, "solve", counted)
    for signal in (0.1, 1.0):
        steps, coef, penalty, ratio = net(1.0, signal)
        assert coef.any() == (signal == 1.0)
        for width in (1e-2, 1e-4):
            narrow = net(width, signal)
            assert narrow[0] < 1.1 * steps
            assert np.allclose(narrow[1], coef, atol=1e-5) and narrow[2] == pytest.approx(penalty, rel=1e-6) and narrow[3] == ratio


def test_garch_grid_picks_the_best_likelihood(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.01, 300)
    points = volatility.grid()
    e = x - x.mean()
    var = (e * e).mean()

    def nll(a, g, b):
        h, total = var, 0.0
        for v in e:
            total += math.log(h) + v * v / h
            h = var * (1 - a - g / 2 - b) + (a + g * (v < 0)) * v * v + b * h
        return 0.5 * total + 0.5 * len(e) * math.log(2 * math.pi)

    series = spark.createDataFrame(pd.DataFrame({"strategy_id": "s", "date": DAYS.date[:300], "ret": x}))
    got = volatility.fit_series(series).collect()[0]
    assert got.nll == pytest.approx(min(nll(*p) for p in points), rel=1e-9)


def test_egarch_grid_and_fallback(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.01, 200)
    e = x - x.mean()
    var = (e * e).mean()

    def path(a, b, omega):
        h, out = var, []
        for v in e:
            out.append(h)
            h = math.exp(omega + a * (abs(v) / math.sqrt(h) - math.sqrt(2 / math.pi)) + b * math.log(h))
        return out, h

    def nll(a, b):
        return 0.5 * sum(math.log(h) + v * v / h for v, h in zip(e, path(a, b, (1 - b) * math.log(var))[0])) + 0.5 * len(e) * math.log(2 * math.pi)

    series = spark.createDataFrame(pd.DataFrame({"strategy_id": "s", "date": DAYS.date[:200], "ret": x}))
    got = volatility.fit_series(series, "EGARCH").collect()[0]
    assert got.nll == pytest.approx(min(nll(a, b) for a, _, b in volatility.model_grid("EGARCH")), rel=1e-9) and (got.model, got.fallback) == ("EGARCH", False)
    sigma = [r.sigma for r in volatility.conditional_sigma(series, "EGARCH").orderBy("date").collect()]
    hs, nxt = path(got.alpha, got.beta, got.omega)
    assert sigma == pytest.approx([math.sqrt(h) for h in hs]) and got.next_var == pytest.approx(nxt)
    level = got.omega / (1 - got.beta)
    want = np.mean([math.exp(level + (math.log(nxt) - level) * got.beta**k) for k in range(21)])
    assert volatility.forecast(volatility.fit_series(series, "EGARCH")).collect()[0].annual_vol == pytest.approx(math.sqrt(252 * want))
    monkeypatch.setattr(volatility, "model_grid", lambda m: np.array([[1e4, 0.0, 0.99]]) if m == "EGARCH" else volatility.grid([0.0]))  # a variance that explodes
    fits = volatility.fit_series(series, "EGARCH").collect()[0]
    assert (fits.model, fits.fallback) == ("GARCH", True) and math.isfinite(fits.nll)


def test_dynamic_var_of_short_series(spark):
    rng = np.random.default_rng(6)
    frames = [pd.DataFrame({"strategy_id": s, "date": DAYS.date[:n], "ret": rng.normal(0, 0.01, n)}) for s, n in (("short", 59), ("long", 60))]
    got = volatility.dynamic_var(spark.createDataFrame(pd.concat(frames))).toPandas()
    short = got[got.strategy_id == "short"].sort_values("date")
    assert short.sigma.isna().all() and short.dynamic_var.notna().sum() == 40 and len(got) == 119
    np.testing.assert_allclose(short.dynamic_var.iloc[-1], np.percentile(frames[0].ret, 5))
    long = got[got.strategy_id == "long"]
    assert long.sigma.notna().all() and (long.dynamic_var < 0).all()


def test_gev_recovers_known_parameters(spark):
    u = np.random.default_rng(7).uniform(size=4000)
    losses = 0.01 - 0.004 * np.log(-np.log(u))  # Gumbel, shape 0
    losses = losses[losses > 0]
    days = pd.date_range("1980-01-01", periods=len(losses)).date
    fit = tails.gev_fit(spark.createDataFrame(pd.DataFrame({"strategy_id": "s", "date": days, "ret": -losses}))).collect()[0]
    assert abs(fit["shape"]) < 0.05 and fit["loc"] == pytest.approx(0.01, abs=5e-4) and fit["scale"] == pytest.approx(0.004, abs=4e-4)


def test_regime_hysteresis_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(9)
    macro = pd.DataFrame({"date": pd.date_range("2005-01-31", periods=150, freq="ME").date, "banxico_rate": rng.normal(0.05, 0.01, 150),
                          "usd_mxn": 18 + rng.normal(0, 1, 150).cumsum() * 0.2, "industrial_production_yoy": rng.normal(0.01, 0.03, 150)})
    got = regimes.composite_regimes(spark.createDataFrame(macro)).orderBy("date").toPandas()
    held, last = [], "expansion"
    for raw, conf in zip(got.raw_regime, got.regime_confidence):
        keep = held and raw != last and conf == conf and conf < 0.3
        last = last if keep else raw
        held.append(last)
    assert held == list(got.regime)


def test_bootstrap_keeps_blocks_and_pairs(spark):
    idx = resampling.block_indices(42, np.arange(50), 500, 20)
    steps = (np.diff(idx, axis=1) - 1) % 500
    assert 0.92 < (steps == 0).mean() < 0.98  # about one new block in twenty rows
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"strategy_id": "s", "benchmark": "b", "date": DAYS.date, "ret": rng.normal(0, 0.01, len(DAYS))})
    pdf["bench"] = pdf.ret
    draws = resampling.bootstrap_pairs(spark.createDataFrame(pdf), ["strategy_id", "benchmark"], n_reps=60).toPandas()
    assert draws.value.abs().max() < 1e-6 + 1e-9 or draws[draws.metric != "alpha_annualized"].value.abs().max() < 1e-9
    assert len(draws) == 180


def test_long_short_budgets(spark):
    rows = [(dt.date(2024, 1, 31), f"T{i}", "X" if i % 2 else "Y", float(i - 5)) for i in range(12)]
    sig = spark.createDataFrame(rows, "date date, ticker string, sector string, expected_return double")
    book = overlay.long_short(sig, 3, 2, True, 0.2, 1.0).toPandas()
    assert book.net_weight.abs().sum() == pytest.approx(1.0) and book.net_weight.sum() == pytest.approx(0.2)
    assert (book[book.side == "long"].net_weight >= 0).all()


def test_scenario_books_equal_single_books(spark):
    rng = np.random.default_rng(8)
    rows = [(d.date(), f"T{i}", "XYZ"[i % 3], float(rng.normal())) for d in DAYS[:3] for i in range(18)]
    sig = spark.createDataFrame(rows, "date date, ticker string, sector string, expected_return double")
    got = overlay.scenario_books(sig).where("strategy_id = '130_30'").orderBy("date", "ticker").toPandas()
    want = overlay.long_short(sig, 8, 5, False, 1.0, 1.6).groupBy("date", "ticker").agg(F.sum("net_weight").alias("w")).orderBy("date", "ticker").toPandas()
    np.testing.assert_allclose(got.weight, want.w, atol=1e-12)


def test_no_trade_band_is_path_dependent(spark):
    w = spark.createDataFrame([("s", DAYS[i].date(), "A", x) for i, x in enumerate([0.10, 0.11, 0.125, 0.13])], "strategy_id string, date date, ticker string, weight double")
    got = backtest.drop_small_trades(w, 0.02).orderBy("date").toPandas().weight.tolist()
    assert got == [0.10, 0.10, 0.125, 0.125]


def test_hedge_ratio_bounds(spark):
    rng = np.random.default_rng(1)
    macro = spark.createDataFrame(pd.DataFrame({"date": DAYS.date[:200], "banxico_rate": rng.normal(0.08, 0.01, 200), "us_fed_rate": 0.04, "usd_mxn": 18 + rng.normal(0, 0.1, 200).cumsum()}))
    got = overlay.hedge_ratio(macro, macro.select("date"), currency_vol=0.3).toPandas().hedge_ratio.dropna()
    assert len(got) > 100 and got.between(0.10, 0.95).all()


def test_overfitting_probability_equals_direct_loop(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(8, 7))
    rows = [(dt.date(2024, 1, 1 + i), int(j), float(m[i, j])) for i in range(8) for j in range(7)]
    got = overfitting.overfitting_probability(spark.createDataFrame(rows, "row_id date, trial_id long, metric double"), 8).collect()[0]
    lam = []
    for c in itertools.combinations(range(8), 4):
        rest = [i for i in range(8) if i not in c]
        best = int(np.argmax(m[list(c)].mean(0)))
        rank = pd.Series(m[rest].mean(0)).rank().iloc[best] / 8
        lam.append(math.log(rank / (1 - rank)))
    assert got.n_splits == 70 and got.pbo == pytest.approx(np.mean(np.array(lam) < 0)) and got.median_logit == pytest.approx(np.median(lam))


def test_candidate_books_respect_every_rule(spark):
    names = [f"N{i:02d}" for i in range(20)]
    uni = spark.createDataFrame([(t, "fibra" if i % 4 == 0 else "equity", f"I{i % 13}", 0.04 if i == 5 else None) for i, t in enumerate(names)],
                                "ticker string, asset_class string, issuer_id string, max_position_override double")
    rng = np.random.default_rng(3)
    sig = spark.createDataFrame([(DAYS[0].date(), t, float(rng.normal()), 0.01) for t in names], "as_of date, ticker string, expected_return double, vol double")
    bounds = spark.createDataFrame([("equity", 0.45, 0.81), ("fibra", 0.045, 0.27)], "asset_class string, min_weight double, max_weight double")
    books = allocation.candidate_books(sig, uni, bounds, 0.9, 6)
    assert allocation.violations(books, uni, bounds, 0.9, keys=("as_of", "cand")).count() == 0
    assert books.select("cand").distinct().count() == 10


def test_folds_are_purged_and_ordered(spark):
    dates = spark.createDataFrame([(d.date(),) for d in pd.bdate_range("2018-01-01", periods=700)], "date date")
    rows = search.walk_forward_folds(dates).orderBy("fold_idx").collect()
    assert len(rows) == 3
    for r in rows:
        assert np.busday_count(r.train_end, r.test_start) == 22 and r.test_end > r.test_start
    assert rows[0].train_start == rows[2].train_start and rows[0].train_end < rows[1].train_end


def test_regulated_keys_are_never_sampled(spark):
    space = {"bl_tau": ("float", 0.01, 0.15, True), "max_position": ("float", 0.1, 0.9, False)}
    for r in search.sample_trials(spark, 20, space).collect():
        assert set(r.params) == {"bl_tau"} and 0.01 <= r.params["bl_tau"] <= 0.15


def test_settings_overlay():
    assert resolve({"bl_tau": None, "michaud_n_simulations": 7}) == {**DEFAULTS, "michaud_n_simulations": 7}


def test_each_strategy_holds_its_own_last_book(spark):
    days = [d.date() for d in pd.bdate_range("2024-01-01", "2024-04-30")]
    returns = spark.createDataFrame([(d, "A", 0.01) for d in days], "date date, ticker string, ret double")
    ends = {"Jan": days[22], "Feb": days[43], "Mar": days[64]}
    books = [("a", ends[m], "A", 1.0) for m in ends] + [("b", ends[m], "A", 1.0) for m in ("Jan", "Mar")]
    weights = spark.createDataFrame(books, "strategy_id string, date date, ticker string, weight double")
    got = {r["strategy_id"]: r["s"] for r in backtest.gross_returns(weights, returns).groupBy("strategy_id").agg(F.sum("gross_ret").alias("s")).collect()}
    held = 0.01 * sum(d > ends["Jan"] for d in days)
    assert got == {"a": pytest.approx(held), "b": pytest.approx(held)}


def test_overfitting_refuses_gaps_and_few_trials(spark):
    full = [(r, t, float((r * 7 + t * 3) % 11)) for r in range(8) for t in range(5)]
    frame = lambda rows: spark.createDataFrame(rows, "row_id long, trial_id long, metric double")
    got = overfitting.overfitting_probability(frame(full), 14).first()
    assert got["n_splits"] == 70 and got["n_trials"] == 5
    assert overfitting.overfitting_probability(frame([x for x in full if x[1] < 3]), 14).first()["pbo"] is None
    with pytest.raises(Exception, match="without a value"):
        overfitting.overfitting_probability(frame([x for x in full if x[:2] != (2, 1)]), 8).collect()


def test_volatility_model_without_a_grid_is_refused(spark):
    with pytest.raises(ValueError):
        volatility.fit_series(spark.createDataFrame([("s", dt.date(2024, 1, 1), 0.1)], "strategy_id string, date date, ret double"), "FIGARCH")


def test_even_book_holds_every_name(spark):
    scores = spark.range(1500).selectExpr("DATE'2024-01-31' AS date", "CAST(id AS STRING) AS ticker", "1.0D AS price")
    got = backtest.even_book(scores, "price", "equal").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).first()
    assert got["n"] == 1500 and got["w"] == pytest.approx(1)
