"""Research runs as dictionaries of lazy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import INDUSTRIAL_EXPOSURE_SECTORS, PUBLICATION_LAG_DAYS, SCENARIO_SHOCKS
from ..operators import (
    backtest, features, forecast, optimise, posterior, quality, regimes, resampling, risk, search, significance, views, volatility,
)
from ..session import ship, stage
from ..settings import resolve
from ..sources import panel as panels
from ..sources import warehouse


def load_bundle(spark: SparkSession, sf_dir: str, lag_days: int = PUBLICATION_LAG_DAYS) -> dict[str, DataFrame]:
    """Every input table, usable tickers only, with a record of what was dropped."""
    ship(spark)
    full = warehouse.price_panel(spark, sf_dir)
    history = quality.price_history(full)
    usable = history.where("usable").select("ticker")
    members = warehouse.universe(spark, sf_dir).join(usable, "ticker", "left_semi")
    tickers = full.select("ticker").distinct()
    dropped = tickers.join(usable, "ticker", "left_anti").select(F.lit("dropped_ticker").alias("item"), F.col("ticker").alias("value"))
    kept = usable.agg(F.lit("kept_tickers").alias("item"), F.count(F.lit(1)).cast("string").alias("value"))
    facts = spark.createDataFrame([("source", sf_dir), ("fundamentals_lag_days", str(lag_days))], "item string, value string")
    return {
        "universe": members,
        "panel": full.join(usable, "ticker", "left_semi"),
        "fundamentals": quality.publication_lag(warehouse.fundamentals(spark, sf_dir), lag_days),
        "fibra_fundamentals": quality.publication_lag(warehouse.fibra_fundamentals(spark, sf_dir), lag_days),
        "bonds": warehouse.bonds(spark, sf_dir),
        "macro": warehouse.macro(spark, sf_dir),
        "data_integrity": facts.unionByName(dropped).unionByName(kept),
    }


def load_etf_bundle(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Fund sleeves plus priced bonds as one long panel (no wide pivot in between)."""
    full = warehouse.price_panel(spark, sf_dir)
    members = warehouse.universe(spark, sf_dir).where(F.col("asset_class") == "fibra")
    funds = full.join(members.select("ticker"), "ticker", "left_semi").select("date", "ticker", "price")
    bonds = warehouse.bonds(spark, sf_dir)
    low, high = panels.date_bounds(full)
    grid = panels.business_days(bonds.select("ticker").distinct(), low, high)
    priced = panels.limited_fill(grid.join(bonds.select("date", "ticker", "price"), ["date", "ticker"], "left"), "price", 5)
    government = bonds.select("ticker").distinct().withColumns({
        "asset_class": F.lit("fixed_income"), "sector": F.lit("Government"), "investable": F.lit(True), "liquidity_score": F.lit(1.0)})
    return {
        "universe": members.unionByName(government, allowMissingColumns=True),
        "panel": funds.unionByName(priced.select("date", "ticker", "price")),
        "bonds": bonds,
        "macro": warehouse.macro(spark, sf_dir),
    }


def run_research(inputs: dict[str, DataFrame], settings: dict | None = None, optimizer: str = "mv", anchor: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """From loaded tables to metrics: forecasts and macro views -> posterior -> currency term -> bounds of each date's regime -> books -> back-test -> risk.

    Every date reads only what was known then.  ``anchor``: sector bands (of ``allocation.sector_bands``) that the books keep.
    Tables are lazy except the staged ones (features, forecasts, expected returns, bounds, problems, weights).
    """
    cfg = resolve(settings)
    members = quality.drop_illiquid(inputs["universe"])
    panel = inputs["panel"].join(members.select("ticker"), "ticker", "left_semi")
    returns = features.add_returns(panel)
    matrix = stage(features.signal_matrix(panel, inputs["fundamentals"], inputs["fibra_fundamentals"], inputs.get("bonds"), inputs["macro"], members), "features")
    predicted = stage(forecast.forecast_returns(matrix, cfg), "forecasts")
    history = regimes.regime_history(inputs["macro"], cfg)
    sleeve = regimes.liquidity_sleeve(regimes.latest_regime(history))
    invested = F.lit(1.0) - sleeve.select("total_sleeve").scalar()
    spark = matrix.sparkSession
    shares = spark.createDataFrame([("equity", 0.50, 0.90), ("fibra", 0.05, 0.30)], "asset_class string, lo double, hi double")
    bounds = shares.select("asset_class", (F.col("lo") * invested).alias("min_weight"), (F.col("hi") * invested).alias("max_weight"))
    dates = predicted.select("date").distinct()
    sources = {"forecast": views.forecast_views(predicted, ["date"]).select("date", "ticker", "view", "confidence")}
    if cfg["bl_views"]["use_macro"]:
        dated = views.macro_views(inputs["macro"], members, cfg["bl_views"]["macro_view_confidence"], cfg["bl_views"]["macro_view_max_magnitude"], latest_only=False)
        sources["macro"] = views.views_in_force(dated, inputs["macro"], dates).select("date", "ticker", "view", "confidence")
    every = None
    for source, part in sources.items():
        part = part.withColumn("source", F.lit(source))
        every = part if every is None else every.unionByName(part)
    combined = views.combine_views(every, ["date"]).withColumnRenamed("date", "as_of")
    blended = posterior.black_litterman(returns, dates, views.market_weights(members), combined, cfg["bl_risk_aversion"], cfg["bl_tau"], cfg["rolling_cov_window"])
    adjusted = posterior.adjusted(blended, members, posterior.currency_return(inputs["macro"], dates), cfg["fx_hedge_ratio_default"])
    own = predicted.select(F.col("date").alias("as_of"), "ticker", F.col("expected_return").alias("forecast"))
    names = stage(own.join(adjusted, ["as_of", "ticker"], "left").select("as_of", "ticker", F.coalesce("expected_return", "forecast").alias("expected_return")), "expected-returns")
    in_force = stage(regimes.bounds_in_force(history, dates, bounds, cfg["regime_min_confidence_for_switch"]), "bounds-in-force")
    chosen = {k: v for k, v in optimise.strategies(cfg).items() if k in {"mv": ("mv",), "cvar": ("cvar",), "both": ("mv", "cvar"), "robust": ("robust",)}.get(optimizer, ())}
    if not chosen:
        raise ValueError(f"unknown optimizer {optimizer!r}")
    weights = None
    for kind, strategy in chosen.items():
        packed = stage(optimise.problems(names, members, in_force, returns, cfg["rolling_cov_window"] if kind != "cvar" else optimise.WINDOWS[kind], anchor), "problems")
        part = optimise.weights(optimise.books(packed, {kind: strategy}))
        weights = part if weights is None else weights.unionByName(part)
    weights = stage(weights, "weights")
    series = stage(backtest.strategy_returns(weights, returns), "series")
    exposures = risk.scenario_exposures(backtest.final_weights(weights), members, SCENARIO_SHOCKS, INDUSTRIAL_EXPOSURE_SECTORS)
    out = {
        "universe": members, "features": matrix, "scored": features.score_cross_section(matrix), "forecasts": predicted,
        "regimes": history, "sleeve": sleeve, "views": views.views_breakdown(sources), "expected_returns": names, "bounds": in_force, "weights": weights, "returns": series,
        "metrics": backtest.metric_pack(series), "turnover": backtest.turnover(weights),
        "stress": risk.stress_test(series, exposures, shock_days=21),
        "signal_ic": significance.signal_ic(matrix),
        "volatility": volatility.rolling_forecast(series, cfg["garch_forecast_horizon"], cfg["garch_lookback"], cfg["garch_refit_every"]),
    }
    if cfg["bootstrap_enabled"]:
        out["metric_draws"] = resampling.bootstrap_metrics(series, n_reps=cfg["bootstrap_n_reps"], block=cfg["bootstrap_block_size"], seed=cfg["bootstrap_seed"])
    return out


def run_search(inputs: dict[str, DataFrame], n_trials: int = 50, n_folds: int = 3, settings: dict | None = None, kind: str = "sharpe_adj", turnover_penalty: float = 0.5, seed: int = 42,
               optimizer: str = "mv", space: dict | None = None) -> dict[str, DataFrame]:
    """Walk-forward search over the whole space: trials, fold metrics, history, best row, its validation (fold metrics and books of a run of its own), importance."""
    cfg = resolve(settings)
    members, panel, macro = inputs["universe"], inputs["panel"], inputs["macro"]
    returns = features.add_returns(panel)
    matrix = stage(features.signal_matrix(panel, inputs["fundamentals"], inputs["fibra_fundamentals"], None, macro, members), "features")
    folds = stage(search.walk_forward_folds(panel, n_folds), "folds")

    def scored(chosen):
        books = stage(search.trial_weights(chosen, matrix, panel, returns, macro, members, cfg, optimizer), "trial-books")
        return books, stage(search.fold_metrics(backtest.strategy_returns(books, returns), folds), "fold-metrics")

    trials = search.sample_trials(matrix.sparkSession, n_trials, space, seed)
    metrics = scored(trials)[1]
    history = search.objective(metrics, kind, turnover_penalty)
    best = stage(search.best_trial(history), "best")
    again = trials.join(best.select(F.col("strategy_id").cast("long").alias("trial_id")), "trial_id", "left_semi")
    books, validation = scored(again)
    return {"trials": trials, "fold_metrics": metrics, "history": history, "best": best, "best_books": books, "validation": validation,
            "importance": search.parameter_importance(trials, history)}
