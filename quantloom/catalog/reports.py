"""Report tables (inventory group Q) and the end-to-end slice."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows as W
from ..operators import backtest, overlay, reporting, risk, significance
from ..sources import warehouse
from . import base, bootstraps, construction, estimation, overlays, risks
from .core import query

BY = "PARTITION BY strategy_id ORDER BY date"


@query("q00_momentum_slice", "n sharpe:6 max_drawdown:6", """
SELECT COUNT(*) AS n, sqrt(252) * (AVG(ret) - 0.02::DOUBLE / 252) / (stddev_pop(ret) + 1e-9) AS sharpe, MIN(drawdown) AS max_drawdown FROM ddown WHERE strategy_id = 'momentum'""")
def momentum_slice(spark, d):
    """Flagship: raw tables -> panel -> momentum ranks -> monthly top five -> back-test -> metrics."""
    books = base.rule_weights(spark, d).where("strategy_id = 'momentum'")
    series = backtest.strategy_returns(books, base.returns_table(spark, d))
    return backtest.metric_pack(series).withColumnRenamed("n_obs", "n")


@query("q01_curves_and_metrics", "strategy_id date wealth:6 rolling_sharpe:5", f"""
SELECT strategy_id, date, wealth, CASE WHEN COUNT(ret) OVER w >= 63 AND stddev_samp(ret) OVER w > 1e-9 THEN AVG(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252) END AS rolling_sharpe
FROM ddown WINDOW w AS ({BY} ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""")
def curves_and_metrics(spark, d):
    w = Window.partitionBy("strategy_id").orderBy("date")
    curve = risk.drawdowns(base.strategy_series(spark, d)).withColumn("_sd", W.rolling_stddev("ret", w, 63))
    return curve.withColumn("rolling_sharpe", F.when(F.col("_sd") > 1e-9, W.rolling_sharpe("ret", w, 63)))


@query("q01b_metric_table", "strategy_id metric point:5 ci_low:5 ci_high:5", f"""
SELECT l.strategy_id, l.metric, MAX(point) AS point, quantile_cont(value, 0.025) AS ci_low, quantile_cont(value, 0.975) AS ci_high
FROM ({bootstraps._LONG}) l JOIN ({bootstraps._POINTS}) p ON p.strategy_id = l.strategy_id AND p.metric = l.metric GROUP BY 1, 2""")
def metric_table(spark, d):
    return bootstraps.metric_intervals(spark, d)


@query("q02_benchmark_table", "strategy_id benchmark total_return:6 annualized_return:6 annualized_vol:6 beta:5 alpha_annualized:6", """
WITH t AS (SELECT benchmark, exp(SUM(ret)) - 1 AS total_return, exp(AVG(ret) * 252) - 1 AS annualized_return, stddev_samp(ret) * sqrt(252) AS annualized_vol FROM bench GROUP BY 1)
SELECT s.strategy_id, b.benchmark, MAX(total_return) AS total_return, MAX(annualized_return) AS annualized_return, MAX(annualized_vol) AS annualized_vol, covar_samp(s.ret, b.ret) / (var_samp(b.ret) + 1e-12) AS beta,
  exp(AVG(s.ret) * 252) - 1 - (0.04 + covar_samp(s.ret, b.ret) / (var_samp(b.ret) + 1e-12) * (exp(AVG(b.ret) * 252) - 1 - 0.04)) AS alpha_annualized
FROM bench b JOIN ser s ON s.date = b.date JOIN t ON t.benchmark = b.benchmark GROUP BY 1, 2""")
def benchmark_table(spark, d):
    bench = base.benchmark_series(spark, d)
    stats = risk.annualised(bench, ["benchmark"]).join(bench.groupBy("benchmark").agg((F.exp(F.sum("ret")) - 1).alias("total_return")), "benchmark")
    own = base.strategy_series(spark, d)
    return stats.join(significance.pair_points(significance.align(own, bench)), "benchmark")


@query("q03_risk_table", "strategy_id max_drawdown:6 var_95:7 cvar_95:7 ewma_vol:6 annualized_vol:6", """
WITH RECURSIVE s AS (SELECT strategy_id, date, ret, row_number() OVER (PARTITION BY strategy_id ORDER BY date) AS i FROM ser),
r AS (SELECT strategy_id, i, ret AS mean, 0.0::DOUBLE AS m2, 1.0::DOUBLE AS w2 FROM s WHERE i = 1
  UNION ALL SELECT s.strategy_id, s.i, r.mean + (1::DOUBLE / 11) * (s.ret - r.mean), (10::DOUBLE / 11) * (r.m2 + (1::DOUBLE / 11) * (s.ret - r.mean) * (s.ret - r.mean)),
    (10::DOUBLE / 11) * (10::DOUBLE / 11) * r.w2 + (1::DOUBLE / 11) * (1::DOUBLE / 11) FROM r JOIN s ON s.strategy_id = r.strategy_id AND s.i = r.i + 1),
v AS (SELECT strategy_id, sqrt(m2 / (1 - w2)) * sqrt(252) AS ewma_vol FROM r WHERE i = (SELECT MAX(i) FROM s)), q AS (SELECT strategy_id, quantile_cont(ret, 0.05) AS var_95 FROM ser GROUP BY 1)
SELECT p.strategy_id, max_drawdown, var_95, cvar_95, ewma_vol, annualized_vol FROM pack p JOIN v ON v.strategy_id = p.strategy_id JOIN q ON q.strategy_id = p.strategy_id""")
def risk_table(spark, d):
    s = base.strategy_series(spark, d)
    vol = risk.realised_volatility(s).groupBy("strategy_id").agg(F.max_by("realized_vol", "date").alias("ewma_vol"))
    var = risk.value_at_risk(s).select("strategy_id", F.col("var").alias("var_95"))
    return backtest.metric_pack(s).join(vol, "strategy_id").join(var, "strategy_id")


@query("q04_significance", "table_name strategy_id item point:5 ci_low:5 ci_high:5")
def significance_tables(spark, d):
    metrics = bootstraps.metric_intervals(spark, d).select(F.lit("metric").alias("table_name"), "strategy_id", F.col("metric").alias("item"), "point", "ci_low", "ci_high")
    alpha = bootstraps.alpha_significance(spark, d).select(F.lit("alpha").alias("table_name"), "strategy_id", F.concat_ws("/", "benchmark", "metric").alias("item"), "point", "ci_low", "ci_high")
    ic = bootstraps.ic_diagnostics(spark, d).select(F.lit("ic").alias("table_name"), F.lit(None).cast("string").alias("strategy_id"), F.col("signal").alias("item"), F.col("ic_mean").alias("point"), "ci_low", "ci_high")
    return metrics.unionByName(alpha).unionByName(ic)


@query("q05_feature_vs_forecast", "feature corr:6", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, composite_score) AS corr FROM scored" for c in ("momentum_63", "volatility_63", "value_score", "quality_score", "liquidity_score")))
def feature_vs_forecast(spark, d):
    return reporting.feature_vs_forecast(base.scored_table(spark, d), ["momentum_63", "volatility_63", "value_score", "quality_score", "liquidity_score"], "composite_score")


@query("q05b_active_views", "date source target view_pct:7 confidence:6",
       "SELECT date, 'forecast' AS source, ticker AS target, view AS view_pct, confidence FROM fviews WHERE ABS(view) > 1e-9 UNION ALL SELECT date, 'macro', ticker, view, confidence FROM mviews WHERE ABS(view) > 1e-9")
def active_views(spark, d):
    return estimation.views_breakdown(spark, d).where(F.abs("view_pct") > 1e-9)


@query("q06_universe_composition", "sector n share:6", "SELECT sector, COUNT(*) AS n, COUNT(*) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM univ) AS share FROM univ GROUP BY 1")
def universe_composition(spark, d):
    return reporting.composition(warehouse.universe(spark, d), ["sector"])


@query("q07_allocation_report", "strategy_id month turnover:6 mean_turnover:6", """
SELECT *, AVG(turnover) OVER (PARTITION BY strategy_id) AS mean_turnover FROM (SELECT strategy_id, CAST(date_trunc('month', date) AS DATE) AS month, SUM(turnover) AS turnover FROM ser GROUP BY 1, 2)""")
def allocation_report(spark, d):
    return reporting.monthly_turnover(base.strategy_series(spark, d))


@query("q07b_sector_exposure", "strategy_id sector weight:6", """
SELECT strategy_id, sector, SUM(weight) AS weight FROM wts w JOIN univ u ON u.ticker = w.ticker WHERE date = (SELECT MAX(date) FROM wts) GROUP BY 1, 2""")
def sector_exposure(spark, d):
    return reporting.weights_by(backtest.final_weights(base.rule_weights(spark, d)), warehouse.universe(spark, d), "sector")


@query("q08_long_short_sectors", "date sector long_weight:6 short_weight:6", f"""
SELECT date, sector, SUM(GREATEST(net_weight, 0)) AS long_weight, SUM(LEAST(net_weight, 0)) AS short_weight FROM ({overlays._book(8, 5, False, 1.0, 1.6)}) GROUP BY 1, 2""")
def long_short_sectors(spark, d):
    book = overlay.long_short(overlays.signals(spark, d), 8, 5, False, 1.0, 1.6)
    return book.groupBy("date", "sector").agg(F.sum(F.greatest("net_weight", F.lit(0.0))).alias("long_weight"), F.sum(F.least("net_weight", F.lit(0.0))).alias("short_weight"))


_SCEN = {"annualized_return": True, "annualized_vol": False, "sharpe": True, "sortino": True, "max_drawdown": False, "cvar_95": False, "turnover": False}
_PACK_OV = """SELECT strategy_id, exp(m * 252) - 1 AS annualized_return, sd1 * sqrt(252) AS annualized_vol, sqrt(252) * (m - 0.02::DOUBLE / 252) / (sd + 1e-9) AS sharpe,
  (m - 0.02::DOUBLE / 252) / (CASE WHEN k > 1 THEN sqrt(dn) ELSE 0 END + 1e-9) * sqrt(252) AS sortino, max_drawdown, cvar_95, turnover FROM (
  SELECT p.strategy_id, AVG(ret) AS m, stddev_pop(ret) AS sd, stddev_samp(ret) AS sd1, COUNT(*) FILTER (WHERE ret < 0.02::DOUBLE / 252) AS k, AVG(pow(ret - 0.02::DOUBLE / 252, 2)) FILTER (WHERE ret < 0.02::DOUBLE / 252) AS dn,
    MIN(dd) AS max_drawdown, AVG(ret) FILTER (WHERE ret <= q + 1e-12) AS cvar_95, AVG(turnover) AS turnover
  FROM (SELECT *, wealth / MAX(wealth) OVER (PARTITION BY strategy_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (SELECT *, exp(SUM(ret) OVER (PARTITION BY strategy_id ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM ovnet)) p
  JOIN (SELECT strategy_id, quantile_cont(ret, 0.05) AS q FROM ovnet GROUP BY 1) v ON v.strategy_id = p.strategy_id GROUP BY 1)"""


@query("q09_scenario_comparison", "strategy_id metric value:5 is_best", f"""
SELECT strategy_id, metric, value, ABS(value - CASE WHEN metric IN ('annualized_return', 'sharpe', 'sortino') THEN MAX(value) OVER (PARTITION BY metric) ELSE MIN(value) OVER (PARTITION BY metric) END) < 1e-9 AS is_best
FROM (UNPIVOT ({_PACK_OV}) ON {', '.join(_SCEN)} INTO NAME metric VALUE value)""")
def scenario_comparison(spark, d):
    return reporting.best_flags(backtest.metric_pack(overlays.overlay_series(spark, d)), "strategy_id", _SCEN)


@query("q10_anchor_table", "strategy_id bucket target_weight:6 first_weight:6 last_weight:6 gap:6 drift:6 binding", """
WITH u AS (SELECT ticker, CASE WHEN sector = 'FIBRA' THEN 'FIBRA' ELSE 'Industrial' END AS bucket, market_cap FROM univ),
g AS (SELECT bucket, SUM(market_cap) / (SELECT SUM(market_cap) FROM univ) AS t FROM u GROUP BY 1),
f AS (SELECT strategy_id, bucket, SUM(CASE WHEN date = (SELECT MIN(date) FROM wts) THEN weight ELSE 0 END) AS a, SUM(CASE WHEN date = (SELECT MAX(date) FROM wts) THEN weight ELSE 0 END) AS z
  FROM wts w JOIN u ON u.ticker = w.ticker WHERE date IN ((SELECT MIN(date) FROM wts), (SELECT MAX(date) FROM wts)) GROUP BY 1, 2)
SELECT strategy_id, f.bucket, t AS target_weight, a AS first_weight, z AS last_weight, z - t AS gap, z - a AS drift,
  CASE WHEN ABS(z - GREATEST(t - 0.15, 0)) <= 1e-3 THEN 'lower' WHEN ABS(z - LEAST(t + 0.15, 1)) <= 1e-3 THEN 'upper' ELSE 'free' END AS binding FROM f JOIN g ON g.bucket = f.bucket""")
def anchor_table(spark, d):
    from ..operators import allocation
    bands, _ = allocation.sector_bands(construction._targets(spark, d), warehouse.universe(spark, d))
    goal = bands.select(F.col("anchor").alias("sector"), F.col("target").alias("weight"))
    return reporting.anchor_table(base.rule_weights(spark, d), warehouse.universe(spark, d), goal)


@query("q11_stress_tables", "strategy_id scenario volatility:7 p5:7 cvar_95:7 worst_window")
def stress_tables(spark, d):
    a = risks.stress_test(spark, d).select("strategy_id", "scenario", "volatility")
    b = risks.stress_distribution(spark, d).select("strategy_id", "scenario", "p5", "cvar_95", "worst_window")
    return a.join(b, ["strategy_id", "scenario"], "left")


@query("q12_weekly_leverage", "strategy_id week_end leverage:6", """
SELECT strategy_id, CAST(date + CAST((7 - isodow(date)) AS INT) AS DATE) AS week_end, AVG(leverage) AS leverage FROM ovs GROUP BY 1, 2""")
def weekly_leverage(spark, d):
    from ..functions import scalars as S
    return overlays.overlay_series(spark, d).groupBy("strategy_id", S.week_end_sunday("date").alias("week_end")).agg(F.avg("leverage").alias("leverage"))


@query("q13_strategy_deltas", "metric base_value:5 other_value:5 delta:5", """
SELECT metric, MAX(CASE WHEN strategy_id = 'equal' THEN value END) AS base_value, MAX(CASE WHEN strategy_id = 'momentum' THEN value END) AS other_value,
  MAX(CASE WHEN strategy_id = 'momentum' THEN value END) - MAX(CASE WHEN strategy_id = 'equal' THEN value END) AS delta
FROM (UNPIVOT pack ON sharpe, sortino, max_drawdown, cvar_95, annualized_return INTO NAME metric VALUE value) GROUP BY metric""")
def strategy_deltas(spark, d):
    return reporting.pairwise_delta(backtest.metric_pack(base.strategy_series(spark, d)), "strategy_id", "equal", "momentum",
                                    ["sharpe", "sortino", "max_drawdown", "cvar_95", "annualized_return"])


@query("q14_stage_attribution", "strategy_id date base_wealth:6 leveraged_wealth:6 with_fx_wealth:6 final_wealth:6", f"""
SELECT strategy_id, date, exp(SUM(base_ret) OVER w) AS base_wealth, exp(SUM(leveraged_ret) OVER w) AS leveraged_wealth, exp(SUM(leveraged_ret + fx_pnl) OVER w) AS with_fx_wealth, exp(SUM(ret) OVER w) AS final_wealth
FROM ovnet WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)""")
def stage_attribution(spark, d):
    w = Window.partitionBy("strategy_id").orderBy("date")
    s = overlays.overlay_series(spark, d).withColumn("with_fx", F.col("leveraged_ret") + F.col("fx_pnl"))
    return s.withColumns({"base_wealth": W.wealth("base_ret", w), "leveraged_wealth": W.wealth("leveraged_ret", w),
                          "with_fx_wealth": W.wealth("with_fx", w), "final_wealth": W.wealth("ret", w)})


@query("q15_trial_tables", "source trial_id value:6 best_so_far:6", """
SELECT source, trial_id, value, MAX(value) OVER (PARTITION BY source ORDER BY trial_id ROWS UNBOUNDED PRECEDING) AS best_so_far FROM (
  SELECT user_id % 20 AS trial_id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, AVG(value) AS value FROM events GROUP BY 1, 2)""")
def trial_tables(spark, d):
    from .panels import _trial_params
    trials = _trial_params(spark, d).select("source", "trial_id", "value").distinct()
    return reporting.trial_convergence(trials)


@query("q15b_parallel_coordinates", "user_id event_type filled:6", """
SELECT user_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS event_type, COALESCE(x, median(x) OVER ()) AS filled FROM (
  SELECT user_id % 20 AS user_id, event_type, CASE WHEN COUNT(*) % 3 > 0 THEN AVG(value) END AS x FROM events GROUP BY 1, 2)""")
def parallel_coordinates(spark, d):
    t = warehouse.read(spark, d, "events").groupBy((F.col("user_id") % 20).alias("user_id"), "event_type").agg(
        F.when(F.count(F.lit(1)) % 3 > 0, F.avg("value")).alias("filled"))
    return reporting.parallel_coordinates(t, ["event_type"], ["filled"])


@query("q16_period_growth", "strategy_id first_date last_date total_return:6 cagr:6", """
SELECT strategy_id, MIN(date) AS first_date, MAX(date) AS last_date, arg_max(wealth, date) / arg_min(wealth, date) - 1 AS total_return,
  pow(arg_max(wealth, date) / arg_min(wealth, date), 1 / (date_diff('day', MIN(date), MAX(date)) / 365.25::DOUBLE)) - 1 AS cagr FROM ddown WHERE date BETWEEN DATE '1996-06-01' AND DATE '1999-05-31' GROUP BY 1""")
def period_growth(spark, d):
    return reporting.period_growth(base.strategy_series(spark, d), "1996-06-01", "1999-05-31")


@query("q17_layer_summary", "metric base_value:5 overlay_value:5", f"""
SELECT a.metric, a.value AS base_value, b.value AS overlay_value FROM (UNPIVOT (SELECT * FROM pack WHERE strategy_id = 'momentum') ON sharpe, max_drawdown, annualized_return INTO NAME metric VALUE value) a
JOIN (UNPIVOT (SELECT * FROM ({_PACK_OV}) WHERE strategy_id = '130_30') ON sharpe, max_drawdown, annualized_return INTO NAME metric VALUE value) b ON a.metric = b.metric""")
def layer_summary(spark, d):
    names = ["sharpe", "max_drawdown", "annualized_return"]
    one = backtest.metric_pack(base.strategy_series(spark, d)).where("strategy_id = 'momentum'")
    two = backtest.metric_pack(overlays.overlay_series(spark, d)).where("strategy_id = '130_30'")
    out = reporting.pairwise_delta(one.unionByName(two), "strategy_id", "momentum", "130_30", names)
    return out.withColumnRenamed("other_value", "overlay_value")
