"""Window operators (inventory group W)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions import windows as W
from ..operators import backtest, risk
from ..sources import panel, warehouse
from . import base
from .core import query

BY_TICKER = "PARTITION BY ticker ORDER BY date"
BY_STRATEGY = "PARTITION BY strategy_id ORDER BY date"


def _w(*keys):
    return Window.partitionBy(*keys).orderBy("date")


@query("w01_forward_fill", "date ticker filled_5:5 filled_all:5", f"""
SELECT g.date, g.ticker, last_value(p.price IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS filled_5,
  last_value(p.price IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS filled_all
FROM grid g LEFT JOIN px p ON p.date = g.date AND p.ticker = g.ticker""")
def forward_fill(spark, d):
    df = panel.on_calendar(warehouse.prices(spark, d).select("date", "ticker", "price"))
    w = _w("ticker")
    return df.select("date", "ticker", W.forward_fill("price", w, 5).alias("filled_5"), W.forward_fill("price", w).alias("filled_all"))


@query("w02_log_return", "date ticker ret:7", "SELECT date, ticker, ret FROM rets")
def log_return(spark, d):
    p = warehouse.price_panel(spark, d)
    return p.withColumn("ret", W.log_return("price", _w("ticker")))


@query("w03_skip_momentum", "date ticker momentum_63:6 momentum_126:6", "SELECT date, ticker, momentum_63, momentum_126 FROM sig")
def skip_momentum(spark, d):
    w = _w("ticker")
    return warehouse.price_panel(spark, d).select(
        "date", "ticker", W.skip_momentum("price", w, 63, 1).alias("momentum_63"), W.skip_momentum("price", w, 126, 21).alias("momentum_126"))


@query("w04_lagged_volatility", "date ticker volatility_63:7", "SELECT date, ticker, volatility_63 FROM sig")
def lagged_volatility(spark, d):
    r = base.returns_table(spark, d)
    return r.withColumn("volatility_63", W.lagged_volatility("ret", _w("ticker"), 63))


@query("w05_percent_rank", "date ticker momentum_63_rank:6 value_score_rank:6", "SELECT date, ticker, r1 AS momentum_63_rank, r2 AS value_score_rank FROM scored")
def percent_rank(spark, d):
    f = base.feature_table(spark, d)
    return f.withColumns({f"{c}_rank": W.percent_rank_average(c, "date") for c in ("momentum_63", "value_score")})


@query("w06_cross_zscore", "date ticker z:6", """
SELECT date, ticker, (quality_score - AVG(quality_score) OVER (PARTITION BY date)) / (stddev_pop(quality_score) OVER (PARTITION BY date) + 1e-9) AS z
FROM fm WHERE date IN (SELECT date FROM fm GROUP BY date HAVING MAX(quality_score) - MIN(quality_score) > 1e-6)""")
def cross_zscore(spark, d):
    f = base.feature_table(spark, d)
    spread = F.max("quality_score").over(Window.partitionBy("date")) - F.min("quality_score").over(Window.partitionBy("date"))
    return f.withColumn("_s", spread).withColumn("z", W.cross_zscore("quality_score", "date")).where(F.col("_s") > 1e-6)


@query("w07_expanding_zscore", "date z_ip:6 z_fx_floor:6", """
SELECT date, CASE WHEN COUNT(industrial_production_yoy) OVER w >= 3 THEN (industrial_production_yoy - AVG(industrial_production_yoy) OVER w) / (NULLIF(stddev_pop(industrial_production_yoy) OVER w, 0) + 1e-9) END AS z_ip,
  (usd_mxn - AVG(usd_mxn) OVER w) / GREATEST(stddev_pop(usd_mxn) OVER w, 1e-9) AS z_fx_floor
FROM mac WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def expanding_zscore(spark, d):
    w = Window.partitionBy(F.lit(1)).orderBy("date")  # months of one macro history
    return warehouse.macro(spark, d).select("date", W.expanding_zscore("industrial_production_yoy", w).alias("z_ip"), W.expanding_zscore_floor("usd_mxn", w).alias("z_fx_floor"))


@query("w08_zscore_vs_history", "date z:6", """
SELECT date, CASE WHEN exports_yoy IS NOT NULL AND COUNT(exports_yoy) OVER w >= 23 AND stddev_samp(exports_yoy) OVER w > 1e-12
  THEN (exports_yoy - AVG(exports_yoy) OVER w) / stddev_samp(exports_yoy) OVER w ELSE 0 END AS z
FROM mac WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def zscore_vs_history(spark, d):
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    return warehouse.macro(spark, d).select("date", W.zscore_vs_history("exports_yoy", w).alias("z"))


@query("w09_diff_pct_change", "date rate_diff_3:7 rate_diff_12:7 fx_pct_3:6 fx_pct_21:6", """
SELECT date, banxico_rate - lag(banxico_rate, 3) OVER w AS rate_diff_3, banxico_rate - lag(banxico_rate, 12) OVER w AS rate_diff_12,
  usd_mxn / lag(usd_mxn, 3) OVER w - 1 AS fx_pct_3, usd_mxn / lag(usd_mxn, 21) OVER w - 1 AS fx_pct_21 FROM mac WINDOW w AS (ORDER BY date)""")
def diff_pct_change(spark, d):
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    return warehouse.macro(spark, d).select(
        "date", W.diff("banxico_rate", w, 3).alias("rate_diff_3"), W.diff("banxico_rate", w, 12).alias("rate_diff_12"),
        W.pct_change("usd_mxn", w, 3).alias("fx_pct_3"), W.pct_change("usd_mxn", w, 21).alias("fx_pct_21"))


@query("w10_ewma_unadjusted", "strategy_id date ewma:8", """
WITH RECURSIVE s AS (SELECT strategy_id, date, ret, row_number() OVER (PARTITION BY strategy_id ORDER BY date) AS i FROM ser),
r AS (SELECT strategy_id, date, i, ret AS ewma FROM s WHERE i = 1
  UNION ALL SELECT s.strategy_id, s.date, s.i, r.ewma * (1 - 2::DOUBLE / 7) + s.ret * (2::DOUBLE / 7) FROM r JOIN s ON s.strategy_id = r.strategy_id AND s.i = r.i + 1)
SELECT strategy_id, date, ewma FROM r""")
def ewma_unadjusted(spark, d):
    s = base.strategy_series(spark, d)
    return s.withColumn("ewma", W.ewma("ret", _w("strategy_id"), 2.0 / 7.0))


@query("w11_ewma_adjusted", "strategy_id date ewma:8", """
WITH RECURSIVE s AS (SELECT strategy_id, date, ret, row_number() OVER (PARTITION BY strategy_id ORDER BY date) AS i FROM ser),
r AS (SELECT strategy_id, date, i, ret AS num, 1.0::DOUBLE AS den FROM s WHERE i = 1
  UNION ALL SELECT s.strategy_id, s.date, s.i, r.num * (1 - 1::DOUBLE / 3) + s.ret, r.den * (1 - 1::DOUBLE / 3) + 1 FROM r JOIN s ON s.strategy_id = r.strategy_id AND s.i = r.i + 1)
SELECT strategy_id, date, num / den AS ewma FROM r""")
def ewma_adjusted(spark, d):
    s = base.strategy_series(spark, d)
    return s.withColumn("ewma", W.ewma_adjusted("ret", _w("strategy_id"), 1.0 / 3.0))


_EWSTD = """
WITH RECURSIVE s AS (SELECT strategy_id, date, ret, row_number() OVER (PARTITION BY strategy_id ORDER BY date) AS i FROM ser),
r AS (SELECT strategy_id, date, i, ret AS mean, 0.0::DOUBLE AS m2, 1.0::DOUBLE AS w2 FROM s WHERE i = 1
  UNION ALL SELECT s.strategy_id, s.date, s.i, r.mean + (1::DOUBLE / 11) * (s.ret - r.mean), (10::DOUBLE / 11) * (r.m2 + (1::DOUBLE / 11) * (s.ret - r.mean) * (s.ret - r.mean)),
    (10::DOUBLE / 11) * (10::DOUBLE / 11) * r.w2 + (1::DOUBLE / 11) * (1::DOUBLE / 11) FROM r JOIN s ON s.strategy_id = r.strategy_id AND s.i = r.i + 1)
SELECT strategy_id, date, CASE WHEN i >= 10 THEN sqrt(GREATEST(m2 / NULLIF(1 - w2, 0), 0)) * sqrt(252) END AS realized_vol FROM r"""


@query("w12_realised_volatility", "strategy_id date realized_vol:7", _EWSTD)
def realised_volatility(spark, d):
    return risk.realised_volatility(base.strategy_series(spark, d), "ewma", 21)


@query("w12b_rolling_volatility", "strategy_id date realized_vol:7", f"""
SELECT strategy_id, date, CASE WHEN COUNT(ret) OVER w >= 21 THEN stddev_samp(ret) OVER w * sqrt(252) END AS realized_vol
FROM ser WINDOW w AS ({BY_STRATEGY} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")
def rolling_volatility(spark, d):
    return risk.realised_volatility(base.strategy_series(spark, d), "rolling", 21)


@query("w14_wealth_drawdown", "strategy_id date wealth:6 drawdown:6", "SELECT strategy_id, date, wealth, drawdown FROM ddown")
def wealth_drawdown(spark, d):
    return risk.drawdowns(base.strategy_series(spark, d))


@query("w15_rolling_sharpe", "strategy_id date rolling_sharpe:5", f"""
SELECT strategy_id, date, CASE WHEN COUNT(ret) OVER w >= 63 AND stddev_samp(ret) OVER w > 1e-9 THEN AVG(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252) END AS rolling_sharpe
FROM ser WINDOW w AS ({BY_STRATEGY} ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""")
def rolling_sharpe(spark, d):
    w = _w("strategy_id")
    sd = W.rolling_stddev("ret", w, 63)
    return base.strategy_series(spark, d).withColumn("_sd", sd).withColumn("rolling_sharpe", F.when(F.col("_sd") > 1e-9, W.rolling_sharpe("ret", w, 63)))


@query("w16_rolling_cvar", "strategy_id date rolling_cvar:7", """
SELECT a.strategy_id, a.date, CASE WHEN MAX(a.n) >= 63 THEN AVG(CASE WHEN b.ret <= a.q + 1e-12 THEN b.ret END) END AS rolling_cvar
FROM (SELECT *, quantile_cont(ret, 0.05) OVER w AS q, COUNT(ret) OVER w AS n, row_number() OVER (PARTITION BY strategy_id ORDER BY date) AS i FROM ser
      WINDOW w AS (PARTITION BY strategy_id ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)) a
LEFT JOIN (SELECT strategy_id, ret, row_number() OVER (PARTITION BY strategy_id ORDER BY date) AS i FROM ser) b
  ON b.strategy_id = a.strategy_id AND b.i BETWEEN a.i - 63 AND a.i - 1
GROUP BY 1, 2""")
def rolling_cvar(spark, d):
    s = base.strategy_series(spark, d)
    return s.withColumn("rolling_cvar", W.rolling_cvar_prior("ret", _w("strategy_id"), 63, 0.95))


@query("w17_rolling_quantile", "strategy_id date dynamic_var:7", f"""
SELECT strategy_id, date, CASE WHEN COUNT(ret) OVER w >= 252 THEN quantile_cont(ret, 0.05) OVER w END AS dynamic_var
FROM ser WINDOW w AS ({BY_STRATEGY} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
def rolling_quantile(spark, d):
    return risk.empirical_dynamic_var(base.strategy_series(spark, d))


@query("w18_forward_return", "date ticker forward_return:6 forward_return_date", f"""
SELECT date, ticker, ln(lead(price, 21) OVER w / (price + 1e-9)) AS forward_return, lead(date, 21) OVER w AS forward_return_date
FROM pan WINDOW w AS ({BY_TICKER})""")
def forward_return(spark, d):
    from ..operators.features import forward_return as label
    return label(warehouse.price_panel(spark, d), 21)


@query("w19_hold_weights", "strategy_id date gross_ret:7", "SELECT * FROM gross")
def hold_weights(spark, d):
    return backtest.gross_returns(base.rule_weights(spark, d), base.returns_table(spark, d))


@query("w20_running_best", "trial_id row_date best:6", """
SELECT trial_id, row_date, MAX(metric) OVER (PARTITION BY trial_id ORDER BY row_date ROWS UNBOUNDED PRECEDING) AS best
FROM (SELECT CAST(ts AS DATE) AS row_date, user_id % 20 AS trial_id, AVG(value) AS metric FROM events GROUP BY 1, 2)""")
def running_best(spark, d):
    t = base.trial_days(spark, d)
    w = Window.partitionBy("trial_id").orderBy("row_date").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("best", F.max("metric").over(w))


@query("w21_row_positions", "date pos month_row", """
SELECT date, pos - (SELECT MIN(pos) FROM bdays) AS pos, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS month_row FROM bdays""")
def row_positions(spark, d):
    p = warehouse.price_panel(spark, d)
    low = S.business_day_index(p.agg(F.min("date")).scalar())
    days = p.select("date").distinct()
    w = Window.partitionBy(F.trunc("date", "MM")).orderBy("date")
    return days.select("date", (S.business_day_index("date") - low).cast("long").alias("pos"), F.row_number().over(w).cast("long").alias("month_row"))


@query("w22_change_only_fill", "date ticker held_volume:2", f"""
SELECT date, ticker, last_value(NULLIF(volume, 0) IGNORE NULLS) OVER ({BY_TICKER} ROWS UNBOUNDED PRECEDING) AS held_volume FROM pan""")
def change_only_fill(spark, d):
    p = warehouse.price_panel(spark, d)
    return p.withColumn("held_volume", W.forward_fill(F.nullif(F.col("volume"), F.lit(0.0)), _w("ticker")))


@query("w23_turnover", "strategy_id date turnover:7", "SELECT * FROM turn")
def turnover(spark, d):
    return backtest.turnover(base.rule_weights(spark, d))


@query("w24_row_frames", "date ticker first_5:5 lead_3:5 avg_rank:4", f"""
SELECT date, ticker, first_value(price) OVER ({BY_TICKER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS first_5, lead(price, 3) OVER ({BY_TICKER}) AS lead_3,
  rank() OVER (PARTITION BY date ORDER BY volume) + (COUNT(*) OVER (PARTITION BY date, volume) - 1) / 2.0::DOUBLE AS avg_rank FROM pan""")
def row_frames(spark, d):
    w = _w("ticker")
    return warehouse.price_panel(spark, d).select(
        "date", "ticker", F.first("price").over(w.rowsBetween(-4, 0)).alias("first_5"), F.lead("price", 3).over(w).alias("lead_3"),
        W.average_rank("volume", "date").alias("avg_rank"))
