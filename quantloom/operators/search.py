"""Walk-forward parameter search: folds, sampled trials and their scores as rows of one job."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import REGULATED_KEYS, SEARCH_SPACE
from ..functions import scalars as S
from ..session import stage
from . import backtest, forecast, optimise, posterior, regimes, views
from .joins import label_intervals


#: The sets of ratios a trial may choose from.
RATIO_SETS = SEARCH_SPACE["elasticnet_l1_ratios"][1]
#: Class bounds under which trials are compared.
TRIAL_BOUNDS = [("equity", 0.30, 0.95), ("fibra", 0.00, 0.30)]
WINDOW = 252


def walk_forward_folds(dates: DataFrame, n_folds: int = 3, purge_rows: int = 21, min_train_rows: int = 252) -> DataFrame:
    """(fold_idx, train_start, train_end, test_start, test_end) from distinct trading dates.

    Positions are arithmetic on the row number of the (calendar bounded) date list.
    """
    w = Window.orderBy("date")
    numbered = dates.select("date").distinct().withColumn("pos", F.row_number().over(w) - 1)
    size = numbered.agg(F.count(F.lit(1)).alias("n"))
    usable = F.col("n") - min_train_rows - purge_rows
    block = F.greatest(F.floor(usable / n_folds), F.lit(30))
    folds = size.where(F.col("n") >= min_train_rows + purge_rows + 30).withColumn("block", block).withColumn("fold_idx", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    train_end = F.lit(min_train_rows) + F.col("fold_idx") * F.col("block")
    folds = folds.withColumns({"train_end_pos": train_end - 1, "test_start_pos": train_end + purge_rows})
    folds = folds.withColumn("test_end_pos", F.least(F.col("test_start_pos") + F.col("block"), F.col("n") - 1))
    folds = folds.where(F.col("test_end_pos") > F.col("test_start_pos"))
    ends = folds.select("fold_idx", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), p.cast("long").alias("pos")) for k, p in (
        ("train_start", F.lit(0)), ("train_end", F.col("train_end_pos")), ("test_start", F.col("test_start_pos")), ("test_end", F.col("test_end_pos")))])).alias("e"))
    dated = ends.select("fold_idx", F.col("e.k").alias("k"), F.col("e.pos").alias("pos")).join(numbered, "pos")
    return dated.groupBy("fold_idx").pivot("k", ["train_start", "train_end", "test_start", "test_end"]).agg(F.first("date"))


def sample_trials(spark: SparkSession, n_trials: int, space: Mapping[str, tuple] | None = None, seed: int = 42) -> DataFrame:
    """(trial_id, params map): seeded draws; regulated keys are never sampled.

    Floats are uniform or log-uniform, integers uniform inclusive, categories by index.
    """
    chosen = {k: v for k, v in (space or SEARCH_SPACE).items() if k not in set(REGULATED_KEYS)}
    trials = spark.range(n_trials).select(F.col("id").alias("trial_id"))
    entries = []
    for stream, (key, (kind, low, high, log)) in enumerate(chosen.items()):
        u = S.hash_uniform(seed, 100 + stream, F.col("trial_id"), F.lit(0))
        if kind == "float":
            value = F.exp(F.ln(F.lit(float(low))) + u * (F.ln(F.lit(float(high))) - F.ln(F.lit(float(low))))) if log else F.lit(float(low)) + u * F.lit(float(high) - float(low))
        elif kind == "int":
            value = F.least(F.lit(int(low)) + F.floor(u * F.lit(int(high) - int(low) + 1)), F.lit(int(high))).cast("double")
        elif kind == "categorical":
            value = F.least(F.floor(u * F.lit(len(low))), F.lit(len(low) - 1)).cast("double")
        else:
            raise ValueError(f"unknown distribution {kind!r} for {key!r}")
        entries += [F.lit(key), value]
    return trials.withColumn("params", F.create_map(*entries))


def trial_settings(trials: DataFrame, cfg: Mapping) -> DataFrame:
    """One typed row per trial; keys that a trial does not set have the value of ``cfg``."""
    value = lambda key, kind="double", default=None: F.coalesce(F.try_element_at("params", F.lit(key)), F.lit(float(cfg[key] if default is None else default))).cast(kind)
    plain = ("bl_risk_aversion", "bl_tau", "mv_risk_aversion", "mv_turnover_penalty", "mv_market_impact_eta", "cvar_risk_aversion", "ewma_lambda_cov", "adtv_ewma_lambda")
    return trials.select("trial_id", value("forecast_forward_days", "int").alias("horizon"), value("elasticnet_l1_ratios", "int", len(RATIO_SETS)).alias("ratio_set"),
                         value("regime_ewma_span", "int").alias("span"), *[value(k).alias(k) for k in plain])


def _for_each(rows: DataFrame, settings: DataFrame, *columns: str) -> DataFrame:
    """``rows`` once per trial: the few settings ride along as an array."""
    return rows.withColumn("_t", F.explode(settings.agg(F.collect_list(F.struct("trial_id", *columns))).scalar())).select(*rows.columns, "_t.*")


def trial_liquidity(panel: DataFrame, settings: DataFrame, window: int = WINDOW, min_periods: int = 60) -> DataFrame:
    """(trial_id, ticker, adtv): liquidity score of every name under each trial's decay of traded value; null with too few values."""
    age = S.business_day_index(panel.agg(F.max("date")).scalar()) - S.business_day_index("date")
    traded = S.finite(F.col("price") * F.col("volume"))
    recent = panel.select("ticker", age.alias("age"), traded.alias("v")).where((F.col("age") < window) & F.col("v").isNotNull())
    path = recent.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("age", "v"))).alias("p")).where(F.size("p") >= min_periods)  # at most ``window`` values
    each = _for_each(path, settings, "adtv_ewma_lambda")
    lam, newest, oldest = F.col("adtv_ewma_lambda"), F.col("p")[0]["age"], F.element_at("p", -1)["age"]
    term = lambda x: F.pow(lam, x["age"] - newest) * F.when(x["age"] == oldest, F.lit(1.0)).otherwise(1.0 - lam) * x["v"]
    value = each.select("trial_id", "ticker", F.aggregate("p", F.lit(0.0), lambda s, x: s + term(x)).alias("v"))
    w = Window.partitionBy("trial_id")
    low, high = F.min("v").over(w), F.max("v").over(w)
    return value.select("trial_id", "ticker", F.when(high - low < 1e-9, 1.0).otherwise((F.col("v") - low) / F.nullif(high - low, F.lit(0.0))).alias("adtv"))


def trial_expected_returns(settings: DataFrame, features: DataFrame, returns: DataFrame, macro: DataFrame, members: DataFrame, cfg: Mapping) -> DataFrame:
    """(trial_id, as_of, ticker, expected_return): forecast -> views -> posterior -> currency term, each under the trial's keys.

    Models are fitted once per distinct horizon and set of ratios, however many trials share it.
    """
    horizons = sorted(r[0] for r in settings.select("horizon").distinct().collect())  # at most one per trial
    predicted = stage(forecast.forecast_variants(features, horizons, [*RATIO_SETS, cfg["elasticnet_l1_ratios"]], dict(cfg)), "trial-forecasts")
    own = predicted.join(settings.select("trial_id", "horizon", "ratio_set"), ["horizon", "ratio_set"]).select("trial_id", "date", "ticker", "expected_return")
    columns = ("trial_id", "date", "ticker", "view", "confidence")
    every = views.forecast_views(own, ["trial_id", "date"]).select(*columns)
    dates = predicted.select("date").distinct()
    if cfg["bl_views"]["use_macro"]:
        dated = views.macro_views(macro, members, cfg["bl_views"]["macro_view_confidence"], cfg["bl_views"]["macro_view_max_magnitude"], latest_only=False)
        every = every.unionByName(_for_each(views.views_in_force(dated, macro, dates), settings).select(*columns))
    combined = views.combine_views(every, ["trial_id", "date"]).withColumnRenamed("date", "as_of")
    blended = posterior.black_litterman_trials(returns, views.market_weights(members), combined, settings.select("trial_id", "bl_risk_aversion", "bl_tau"), cfg["rolling_cov_window"])
    adjusted = posterior.adjusted(blended, members, posterior.currency_return(macro, dates), cfg["fx_hedge_ratio_default"], ["trial_id"])
    named = own.withColumnsRenamed({"date": "as_of", "expected_return": "forecast"}).join(adjusted, ["trial_id", "as_of", "ticker"], "left")
    return named.select("trial_id", "as_of", "ticker", F.coalesce("expected_return", "forecast").alias("expected_return"))


def trial_problems(settings: DataFrame, expected: DataFrame, panel: DataFrame, returns: DataFrame, macro: DataFrame, members: DataFrame, cfg: Mapping, kinds: Sequence[str]) -> DataFrame:
    """Packed problems of every trial and date, with the trial's bounds, liquidity and penalties; one strategy (trial/kind) for each of ``kinds``."""
    spark = settings.sparkSession
    base = spark.createDataFrame(TRIAL_BOUNDS, "asset_class string, min_weight double, max_weight double")
    dates = expected.select(F.col("as_of").alias("date")).distinct()
    spans = sorted(r[0] for r in settings.select("span").distinct().collect())
    held = [regimes.bounds_in_force(regimes.regime_history(macro, {**cfg, "regime_ewma_span": s}), dates, base, cfg["regime_min_confidence_for_switch"]).withColumn("span", F.lit(s)) for s in spans]
    bounds = stage(functools.reduce(DataFrame.unionByName, held), "trial-bounds").join(settings.select("trial_id", "span"), "span").drop("span")
    names = expected.join(trial_liquidity(panel, settings), ["trial_id", "ticker"], "left")
    packed = optimise.problems(names, members, bounds, returns, WINDOW, keys=["trial_id"]).join(settings, "trial_id")
    number = lambda c: (F.lit(c) if isinstance(c, float) else F.col(c)).cast("double")

    def setting(kind, target, aversion, penalty, decay):
        return F.struct(F.lit(kind).alias("kind"), number(float(target)).alias("target"), number(aversion).alias("risk_aversion"), number(penalty).alias("turnover_penalty"),
                        number("mv_market_impact_eta").alias("impact_eta"), number(float(cfg["cvar_alpha"])).alias("alpha"), (F.lit(None) if decay is None else F.col(decay)).cast("double").alias("decay"))

    every = {"mv": setting("mv", cfg["target_net_exposure_mv"], "mv_risk_aversion", "mv_turnover_penalty", "ewma_lambda_cov"),
             "cvar": setting("cvar", cfg["target_net_exposure_cvar"], "cvar_risk_aversion", float(cfg["cvar_turnover_penalty"]), None)}
    packed = packed.drop(*[c for c in settings.columns if c != "trial_id"], "setting").join(
        settings.select("trial_id", F.explode(F.array(*[every[k] for k in kinds])).alias("setting")), "trial_id")
    return packed.withColumn("strategy_id", F.format_string("%d/%s", "trial_id", "setting.kind")).drop("trial_id")


def trial_weights(trials: DataFrame, features: DataFrame, panel: DataFrame, returns: DataFrame, macro: DataFrame, members: DataFrame, cfg: Mapping, optimizer: str = "both") -> DataFrame:
    """(strategy_id, date, ticker, weight): every trial's books over all dates, under all of its keys.

    ``optimizer``: mv, cvar, or both (the mean of the two books).  A trial without forecasts on any date has no rows.
    """
    kinds = {"mv": ("mv",), "cvar": ("cvar",), "both": ("mv", "cvar")}.get(optimizer)
    if kinds is None:
        raise ValueError(f"unknown optimizer {optimizer!r}")
    settings = stage(trial_settings(trials, cfg), "trial-settings")
    expected = stage(trial_expected_returns(settings, features, returns, macro, members, cfg), "trial-returns")
    solved = optimise.books(trial_problems(settings, expected, panel, returns, macro, members, cfg, kinds))
    books = optimise.weights(solved).withColumn("strategy_id", F.substring_index("strategy_id", "/", 1))
    return books.groupBy("strategy_id", "date", "ticker").agg((F.sum("weight") / len(kinds)).alias("weight"))


def fold_metrics(series: DataFrame, folds: DataFrame, risk_free: float = 0.02) -> DataFrame:
    """Out-of-sample metric pack per (trial, fold)."""
    labelled = label_intervals(series, folds, "test_start", "test_end", ["fold_idx"])
    return backtest.metric_pack(labelled, risk_free, ["strategy_id", "fold_idx"])


def objective(metrics: DataFrame, kind: str = "sharpe_adj", turnover_penalty: float = 0.5) -> DataFrame:
    """(strategy_id, value, fold_sharpes, means)."""
    means = metrics.groupBy("strategy_id").agg(
        F.avg("sharpe").alias("sharpe_mean"), F.avg("sortino").alias("sortino_mean"), F.avg(F.abs("max_drawdown")).alias("drawdown_mean"),
        F.avg("turnover").alias("turnover_mean"), F.avg("cvar_95").alias("cvar_95_mean"),
        F.transform(F.sort_array(F.collect_list(F.struct("fold_idx", "sharpe"))), lambda x: x["sharpe"]).alias("fold_sharpes"))
    values = {
        "sharpe_adj": F.col("sharpe_mean") - F.lit(float(turnover_penalty)) * F.col("turnover_mean"),
        "sortino": F.col("sortino_mean"),
        "calmar": F.col("sharpe_mean") / (F.col("drawdown_mean") + F.lit(1e-9)),
    }
    if kind not in values:
        raise ValueError(f"unknown objective {kind!r}")
    return means.withColumn("value", values[kind])


def best_trial(history: DataFrame) -> DataFrame:
    """The single best row; ties go to the smaller id."""
    return history.orderBy(F.col("value").desc(), "strategy_id").limit(1)


def parameter_importance(trials: DataFrame, history: DataFrame, bins: int = 4) -> DataFrame:
    """(param, importance): share of the value's variance explained by quartile means of each parameter."""
    long = trials.select("trial_id", F.explode("params").alias("param", "x"))
    values = history.select(F.col("strategy_id").cast("long").alias("trial_id"), "value")
    joined = long.join(values, "trial_id")
    binned = joined.withColumn("bin", F.ntile(bins).over(Window.partitionBy("param").orderBy("x", "trial_id")))
    means = binned.groupBy("param", "bin").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    total = means.groupBy("param").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("between"))
    mean2 = F.col("s") * F.col("s") / F.col("n")
    share = (F.col("between") - mean2) / F.nullif(F.col("ss") - mean2, F.lit(0.0))
    raw = total.select("param", F.coalesce(share, F.lit(0.0)).alias("raw"))
    return raw.withColumn("importance", F.col("raw") / F.nullif(F.sum("raw").over(Window.partitionBy()), F.lit(0.0)))
