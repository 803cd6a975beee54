"""A whole run from raw tables."""

import os

import pytest

from pyspark.sql import functions as F

from quantloom.constants import SEARCH_SPACE
from quantloom.operators import features, search
from quantloom.plans import research
from quantloom.session import stage
from quantloom.settings import resolve

SF = os.environ.get("QUANTLOOM_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_research_run(spark):
    out = research.run_research(research.load_bundle(spark, SF), {"bootstrap_n_reps": 20})
    metrics = out["metrics"].toPandas()
    assert list(metrics.strategy_id) == ["mv"] and metrics.max_drawdown.iloc[0] < 0
    books = out["weights"].groupBy("date").sum("weight").toPandas()
    assert (books["sum(weight)"] - 0.9).abs().max() < 1e-4
    assert out["stress"].count() == 4 and out["metric_draws"].count() == 100


def test_earlier_books_do_not_see_later_data(spark):
    bundle = research.load_bundle(spark, SF)
    cut = "1997-06-30"
    quick = {"bootstrap_enabled": False}
    whole = research.run_research(bundle, quick)
    known = {k: v.where(f"date <= '{cut}'") if "date" in v.columns else v for k, v in bundle.items()}
    early = research.run_research(known, quick)
    for name, date in (("expected_returns", "as_of"), ("bounds", "as_of"), ("weights", "date")):
        value = {"expected_returns": "expected_return", "bounds": "max_weight", "weights": "weight"}[name]
        item = "asset_class" if name == "bounds" else "ticker"
        a, b = ({(r[date], r[item]): r[value] for r in t[name].where(f"{date} < '1997-05-01'").collect()} for t in (whole, early))
        assert len(a) > 0 and a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6, name


def test_unknown_optimizer_is_refused(spark):
    with pytest.raises(ValueError):
        research.run_research(research.load_bundle(spark, SF), optimizer="none")


def test_every_key_of_the_search_acts(spark):
    bundle = research.load_bundle(spark, SF)
    members, panel, macro = bundle["universe"], bundle["panel"], bundle["macro"]
    matrix = stage(features.signal_matrix(panel, bundle["fundamentals"], bundle["fibra_fundamentals"], None, macro, members), "features")
    moved = {"bl_risk_aversion": 5.0, "bl_tau": 0.15, "mv_risk_aversion": 10.0, "mv_turnover_penalty": 0.5, "mv_market_impact_eta": 0.01, "cvar_risk_aversion": 5.0, "ewma_lambda_cov": 0.99,
             "elasticnet_l1_ratios": 2.0, "regime_ewma_span": 12.0, "forecast_forward_days": 10.0, "adtv_ewma_lambda": 0.90}
    assert moved.keys() == SEARCH_SPACE.keys()
    rows = [(0, {"bl_tau": 0.05})] + [(i + 1, {k: v}) for i, (k, v) in enumerate(moved.items())]
    rows.append((len(rows), {}))  # the settings' own values once more
    trials = spark.createDataFrame(rows, "trial_id long, params map<string,double>")
    books = search.trial_weights(trials, matrix, panel, features.add_returns(panel), macro, members, resolve({})).toPandas()
    wide = books.pivot_table(index=["date", "ticker"], columns="strategy_id", values="weight")
    for i, key in enumerate(moved):
        # the prior is on the scale of a day's variance, and tau cancels but for the ridge of 1e-6: these two act, but little
        assert (wide[str(i + 1)] - wide["0"]).abs().max() > (1e-8 if key.startswith("bl_") else 1e-5), key
    assert (wide[str(len(moved) + 1)] - wide["0"]).abs().max() < 1e-12
    totals = books.groupby(["strategy_id", "date"]).weight.sum()
    assert (totals - (0.9 + 0.75) / 2).abs().max() < 1e-4


def test_the_best_trial_is_run_again(spark):
    space = {k: SEARCH_SPACE[k] for k in ("mv_risk_aversion", "mv_market_impact_eta")}
    out = research.run_search(research.load_bundle(spark, SF), n_trials=3, space=space)
    best = out["best"].collect()[0]
    metrics = {r.fold_idx: r for r in out["fold_metrics"].where(F.col("strategy_id") == best.strategy_id).collect()}
    again = out["validation"].collect()
    assert len(again) == len(metrics) == 3 and out["best_books"].count() > 0
    for r in again:
        assert r.sharpe == pytest.approx(metrics[r.fold_idx].sharpe, rel=1e-9) and r.turnover == pytest.approx(metrics[r.fold_idx].turnover, rel=1e-9)
    assert best.value == max(r.value for r in out["history"].collect())
