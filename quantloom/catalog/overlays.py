"""Long/short, leverage and currency overlay queries (inventory group H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest, overlay, tails
from ..session import stage_once
from ..sources import warehouse
from . import base
from .core import query
from .ctes import CTES


def signals(spark, d):
    """Cross-sectional signal of the risky names on rebalance dates."""
    return base.candidates(spark, d).select("date", "ticker", "sector", "asset_class", F.col("momentum_63").alias("expected_return"))


def _book(top: int, bottom: int, neutral: bool, net: float, gross: float) -> str:
    part = "date, sector" if neutral else "date"
    side = "date, side, sector" if neutral else "date, side"
    size = f"WHERE size >= {top + bottom}" if neutral else ""
    return f"""
SELECT date, ticker, sector, side, raw_weight, raw_weight * CASE side WHEN 'long' THEN {0.5 * (gross + net)!r} ELSE {0.5 * (gross - net)!r} END / SUM(ABS(raw_weight)) OVER (PARTITION BY date, side) AS net_weight FROM (
  SELECT date, ticker, sector, side, sg * CASE WHEN SUM(GREATEST(sg * m, 0)) OVER (PARTITION BY {side}) <= 1e-9 THEN 1 ELSE GREATEST(sg * m, 0) END AS raw_weight FROM (
    SELECT date, ticker, sector, m, side, CASE side WHEN 'long' THEN 1.0::DOUBLE ELSE -1.0 END AS sg FROM (
      SELECT date, ticker, sector, momentum_63 AS m, row_number() OVER (PARTITION BY {part} ORDER BY momentum_63 DESC, ticker) AS up,
        row_number() OVER (PARTITION BY {part} ORDER BY momentum_63, ticker DESC) AS dn, COUNT(*) OVER (PARTITION BY {part}) AS size FROM cand)
    JOIN (SELECT unnest(['long', 'short']) AS side) ON (side = 'long' AND up <= {top}) OR (side = 'short' AND dn <= {bottom}) {size}))"""


@query("h01_long_short", "date ticker side raw_weight:6 net_weight:6", _book(5, 5, False, 0.0, 1.0))
def long_short(spark, d):
    return overlay.long_short(signals(spark, d), 5, 5, sector_neutral=False)


@query("h01b_sector_neutral", "date ticker sector side net_weight:6", _book(2, 1, True, 1.0, 1.6))
def sector_neutral(spark, d):
    return overlay.long_short(signals(spark, d), 2, 1, True, 1.0, 1.6)


CTES["lever"] = """
WITH RECURSIVE q AS (SELECT strategy_id, date, ret, row_number() OVER w AS i, CASE WHEN COUNT(ret) OVER f >= 63 THEN quantile_cont(ret, 0.05) OVER f END AS lv FROM ser
  WINDOW w AS (PARTITION BY strategy_id ORDER BY date), f AS (PARTITION BY strategy_id ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)),
c AS (SELECT a.strategy_id, a.date, a.i, ABS(AVG(CASE WHEN b.ret <= a.lv + 1e-12 THEN b.ret END)) AS cv FROM q a LEFT JOIN q b ON b.strategy_id = a.strategy_id AND b.i BETWEEN a.i - 63 AND a.i - 1 GROUP BY 1, 2, 3),
t AS (SELECT *, CASE WHEN cv IS NULL THEN 1 WHEN cv > 0.02 THEN 0.8 + 0.7 * GREATEST(0, 1 - (cv - 0.02) / 0.02) WHEN cv <= 0.01 THEN 1.5 ELSE 0.8 + 0.7 * (0.02 - cv) / 0.01 END::DOUBLE AS target FROM c),
r AS (SELECT strategy_id, date, i, target AS num, 1.0::DOUBLE AS den FROM t WHERE i = 1
  UNION ALL SELECT t.strategy_id, t.date, t.i, r.num * (2::DOUBLE / 3) + t.target, r.den * (2::DOUBLE / 3) + 1 FROM r JOIN t ON t.strategy_id = r.strategy_id AND t.i = r.i + 1)
SELECT strategy_id, date, LEAST(GREATEST(num / den, 0.8), 1.5) AS leverage FROM r"""


@query("h02_dynamic_leverage", "strategy_id date leverage:6", "SELECT * FROM lever")
def dynamic_leverage(spark, d):
    return overlay.dynamic_leverage(base.strategy_series(spark, d), 1.5, 0.02, 0.8)


CTES["hedge"] = """
WITH a AS (SELECT m.date, banxico_rate - us_fed_rate AS rd, usd_mxn FROM (SELECT DISTINCT date FROM cand) m ASOF LEFT JOIN mac x ON m.date >= x.date),
b AS (SELECT *, ln(usd_mxn / lag(usd_mxn, 21) OVER (ORDER BY date)) AS mom FROM a),
z AS (SELECT *, -0.6 * (rd - AVG(rd) OVER w) / GREATEST(stddev_pop(rd) OVER w, 1e-9) + 0.4 * (mom - AVG(mom) OVER w) / GREATEST(stddev_pop(mom) OVER w, 1e-9) AS score FROM b WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT date, score AS fx_signal_score, rd AS rate_differential, mom AS mxn_momentum, CASE WHEN score IS NOT NULL THEN 0.10 + 0.85 / (1 + exp(-LEAST(GREATEST(score, -3), 3) / 3 * 6)) END AS hedge_ratio FROM z"""


def hedges(spark, d):
    return overlay.hedge_ratio(warehouse.macro(spark, d), signals(spark, d))


@query("h03_hedge_ratio", "date hedge_ratio:6 fx_signal_score:6 rate_differential:7 mxn_momentum:6", "SELECT * FROM hedge")
def hedge_ratio(spark, d):
    return hedges(spark, d)


CTES["fxpnl"] = """
WITH a AS (SELECT b.date, COALESCE(h.hedge_ratio, 0.5) AS hr, m.usd_mxn FROM bdays b ASOF LEFT JOIN hedge h ON b.date >= h.date ASOF LEFT JOIN mac m ON b.date >= m.date)
SELECT date, hr AS hedge_ratio, (SELECT AVG(usd_exposure) FROM univ) * (1 - COALESCE(lag(hr) OVER (ORDER BY date), 0.5)) * COALESCE(ln(usd_mxn / lag(usd_mxn) OVER (ORDER BY date)), 0) AS fx_pnl FROM a"""


@query("h04_currency_pnl", "date hedge_ratio:6 fx_pnl:7", "SELECT * FROM fxpnl")
def currency_pnl(spark, d):
    exposure = warehouse.universe(spark, d).agg(F.avg("usd_exposure")).scalar()
    return overlay.currency_pnl(hedges(spark, d), warehouse.macro(spark, d), base.returns_table(spark, d).select("date"), exposure)


@query("h05_tail_hedge", "strategy_id unhedged_loss:6 hedge_payoff:6 daily_cost_drag:5 net_benefit:6 recommended", """
WITH q AS (SELECT strategy_id, -(loc + scale * (1 - pow(-ln(0.01::DOUBLE), shape)) / shape) AS loss, -(loc + scale * (1 - pow(-ln(0.05::DOUBLE), shape)) / shape) AS var95 FROM gevfit),
p AS (SELECT *, GREATEST(0, loss - var95) AS payoff FROM q)
SELECT strategy_id, loss AS unhedged_loss, payoff AS hedge_payoff, 0.003::DOUBLE AS daily_cost_drag, payoff - 0.003::DOUBLE AS net_benefit, payoff - 0.003::DOUBLE > 0 AS recommended FROM p""")
def tail_hedge(spark, d):
    return overlay.tail_hedge(tails.gev_fit(base.strategy_series(spark, d)))


_BAND = 0.02
CTES["banded"] = f"""
WITH RECURSIVE s AS (SELECT DISTINCT strategy_id, date FROM wts), k AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY date) AS i FROM s),
n AS (SELECT DISTINCT strategy_id, ticker FROM wts), t AS (SELECT k.strategy_id, k.date, k.i, n.ticker, COALESCE(w.weight, 0) AS target FROM k JOIN n ON n.strategy_id = k.strategy_id
  LEFT JOIN wts w ON w.strategy_id = k.strategy_id AND w.date = k.date AND w.ticker = n.ticker),
r AS (SELECT strategy_id, date, i, ticker, CASE WHEN ABS(target) >= {_BAND} THEN target ELSE 0 END AS weight FROM t WHERE i = 1
  UNION ALL SELECT t.strategy_id, t.date, t.i, t.ticker, CASE WHEN ABS(t.target - r.weight) >= {_BAND} THEN t.target ELSE r.weight END FROM r JOIN t ON t.strategy_id = r.strategy_id AND t.ticker = r.ticker AND t.i = r.i + 1)
SELECT strategy_id, date, ticker, weight FROM r WHERE weight <> 0"""


@query("h06_no_trade_band", "strategy_id date ticker weight:6", "SELECT * FROM banded")
def no_trade_band(spark, d):
    w = base.rule_weights(spark, d)
    return backtest.drop_small_trades(w, _BAND)


def overlay_series(spark, d):
    def build():
        books = overlay.scenario_books(signals(spark, d))
        return overlay.overlay_backtest(books, base.returns_table(spark, d), warehouse.macro(spark, d), warehouse.universe(spark, d), signals(spark, d),
                                        max_leverage=1.3, cvar_limit=0.04, cost=0.0010)
    return stage_once(spark, d, "overlay", build)


_BOOKS = "\nUNION ALL ".join(f"SELECT '{k}' AS strategy_id, {cap} AS cap, date, ticker, SUM(net_weight) AS weight FROM ({_book(t, b, s, n if b else 1.0, g if b else 1.0)}) GROUP BY date, ticker"
                             for k, t, b, s, n, g, cap in (("regulated", 8, 0, False, 1.05, 1.15, 1.15), ("130_30", 8, 5, False, 1.0, 1.6, 1.3),
                                                           ("market_neutral", 8, 8, False, 0.0, 1.0, 1.0), ("130_30_sector_neutral", 2, 1, True, 1.0, 1.6, 1.3)))
CTES["ovw"] = f"""
WITH RECURSIVE b AS MATERIALIZED ({_BOOKS}), k AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY date) AS i FROM (SELECT DISTINCT strategy_id, date FROM b)),
n AS (SELECT DISTINCT strategy_id, ticker, cap FROM b), t AS (SELECT k.strategy_id, n.cap, k.date, k.i, n.ticker, COALESCE(b.weight, 0) AS target FROM k JOIN n ON n.strategy_id = k.strategy_id
  LEFT JOIN b ON b.strategy_id = k.strategy_id AND b.date = k.date AND b.ticker = n.ticker),
r AS (SELECT strategy_id, cap, date, i, ticker, CASE WHEN ABS(target) >= 0.0005 THEN target ELSE 0 END AS weight FROM t WHERE i = 1
  UNION ALL SELECT t.strategy_id, t.cap, t.date, t.i, t.ticker, CASE WHEN ABS(t.target - r.weight) >= 0.0005 THEN t.target ELSE r.weight END FROM r JOIN t ON t.strategy_id = r.strategy_id AND t.ticker = r.ticker AND t.i = r.i + 1)
SELECT * FROM r"""

CTES["ovs"] = """
WITH RECURSIVE h AS (SELECT strategy_id, date AS d0, COALESCE(lead(date) OVER (PARTITION BY strategy_id ORDER BY date), (SELECT MAX(date) FROM bdays)) AS d1 FROM (SELECT DISTINCT strategy_id, date FROM ovw)),
g AS (SELECT w.strategy_id, r.date, SUM(w.weight * r.ret) AS base_ret, SUM(ABS(LEAST(w.weight, 0))) AS short FROM h JOIN rets r ON r.date > h.d0 AND r.date <= h.d1 JOIN ovw w ON w.strategy_id = h.strategy_id AND w.date = h.d0 AND w.ticker = r.ticker GROUP BY 1, 2),
tv AS (SELECT strategy_id, date, SUM(ABS(weight - pv)) AS turnover FROM (SELECT *, COALESCE(lag(weight) OVER (PARTITION BY strategy_id, ticker ORDER BY date), 0) AS pv FROM ovw) GROUP BY 1, 2),
s AS (SELECT k.strategy_id, k.cap, b.date, COALESCE(g.base_ret, 0) AS base_ret, COALESCE(g.short, 0) AS short, COALESCE(tv.turnover, 0) AS turnover, row_number() OVER (PARTITION BY k.strategy_id ORDER BY b.date) AS i
  FROM bdays b CROSS JOIN (SELECT DISTINCT strategy_id, cap FROM ovw) k LEFT JOIN g ON g.strategy_id = k.strategy_id AND g.date = b.date LEFT JOIN tv ON tv.strategy_id = k.strategy_id AND tv.date = b.date),
q AS (SELECT *, CASE WHEN COUNT(base_ret) OVER f >= 63 THEN quantile_cont(base_ret, 0.05) OVER f END AS lv FROM s WINDOW f AS (PARTITION BY strategy_id ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)),
c AS (SELECT a.strategy_id, a.i, ABS(AVG(CASE WHEN b.base_ret <= a.lv + 1e-12 THEN b.base_ret END)) AS cv FROM q a LEFT JOIN q b ON b.strategy_id = a.strategy_id AND b.i BETWEEN a.i - 63 AND a.i - 1 GROUP BY 1, 2),
t AS (SELECT s.*, CASE WHEN cv IS NULL THEN 1 WHEN cv > 0.04 THEN 0.8 + (cap - 0.8) * GREATEST(0, 1 - (cv - 0.04) / 0.04) WHEN cv <= 0.02 THEN cap ELSE 0.8 + (cap - 0.8) * (0.04 - cv) / 0.02 END::DOUBLE AS target FROM s JOIN c ON c.strategy_id = s.strategy_id AND c.i = s.i),
e AS (SELECT strategy_id, i, target AS num, 1.0::DOUBLE AS den FROM t WHERE i = 1
  UNION ALL SELECT t.strategy_id, t.i, e.num * (2::DOUBLE / 3) + t.target, e.den * (2::DOUBLE / 3) + 1 FROM e JOIN t ON t.strategy_id = e.strategy_id AND t.i = e.i + 1),
l AS (SELECT t.*, LEAST(GREATEST(num / den, 0.8), cap) AS leverage FROM t JOIN e ON e.strategy_id = t.strategy_id AND e.i = t.i)
SELECT l.strategy_id, l.date, base_ret, leverage, base_ret * leverage AS leveraged_ret, x.hedge_ratio, x.fx_pnl, turnover, turnover * 2 * 0.001 AS trade_cost, short * (150 / 10000.0::DOUBLE / 252) AS borrow_cost,
  COALESCE(ABS(leverage - lag(leverage) OVER (PARTITION BY strategy_id ORDER BY l.date)), 0) * (5 / 10000.0::DOUBLE) AS leverage_cost
FROM l JOIN fxpnl x ON x.date = l.date"""
CTES["ovnet"] = "SELECT *, leveraged_ret + fx_pnl - trade_cost - borrow_cost - leverage_cost AS ret FROM ovs"


@query("h07_cost_model", "strategy_id date trade_cost:7 borrow_cost:8 leverage_cost:8", "SELECT * FROM ovs")
def cost_model(spark, d):
    return overlay_series(spark, d)


@query("h08_overlay_backtest", "strategy_id date base_ret:7 leverage:6 fx_pnl:7 ret:7", "SELECT * FROM ovnet")
def overlay_backtest(spark, d):
    books = overlay.scenario_books(signals(spark, d))
    return overlay.overlay_backtest(books, base.returns_table(spark, d), warehouse.macro(spark, d), warehouse.universe(spark, d), signals(spark, d),
                                    max_leverage=1.3, cvar_limit=0.04, cost=0.0010)


@query("h09_structure_scenarios", "strategy_id n sum_ret:5 mean_leverage:5 turnover:6", """
SELECT strategy_id, COUNT(*) AS n, SUM(ret) AS sum_ret, AVG(leverage) AS mean_leverage, AVG(turnover) AS turnover FROM ovnet GROUP BY 1""")
def structure_scenarios(spark, d):
    return overlay_series(spark, d).groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ret").alias("sum_ret"), F.avg("leverage").alias("mean_leverage"), F.avg("turnover").alias("turnover"))


@query("h10_notional_flag", "max_hedge:6 status", """
SELECT MAX(ABS(hedge_ratio)) AS max_hedge, CASE WHEN MAX(ABS(hedge_ratio)) > 0.15 THEN 'exceeded' WHEN MAX(ABS(hedge_ratio)) > 0.12 THEN 'approaching' ELSE 'ok' END AS status FROM hedge""")
def notional_flag(spark, d):
    return overlay.notional_flag(hedges(spark, d))
