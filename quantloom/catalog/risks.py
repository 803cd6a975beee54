"""Back-test and risk queries (inventory groups O15-O21 and R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import INDUSTRIAL_EXPOSURE_SECTORS, SCENARIO_SHOCKS
from ..operators import backtest, covariance, regimes, risk, tails, volatility
from ..settings import DEFAULTS
from ..sources import warehouse
from . import base
from .core import query
from .ctes import CTES, hashed

PACK = "n_obs sharpe:5 sortino:5 max_drawdown:6 calmar:5 cvar_95:7 annualized_return:6 annualized_vol:6 turnover:6"


@query("o15_walk_forward", "strategy_id date ret:7 turnover:6", "SELECT * FROM ser")
def walk_forward(spark, d):
    return backtest.strategy_returns(base.rule_weights(spark, d), base.returns_table(spark, d))


@query("o15b_two_schedules", "strategy_id date ret:7", """
WITH k AS (SELECT * FROM wts WHERE strategy_id <> 'momentum' OR month(date) % 3 = 0),
s AS (SELECT strategy_id, date, lead(date) OVER (PARTITION BY strategy_id ORDER BY date) AS nxt FROM (SELECT DISTINCT strategy_id, date FROM k)),
l AS (SELECT b.date, s.strategy_id, MAX(s.date) AS book FROM bdays b JOIN s ON s.date < b.date GROUP BY 1, 2),
g AS (SELECT l.strategy_id, l.date, SUM(k.weight * r.ret) AS gross FROM l JOIN k ON k.strategy_id = l.strategy_id AND k.date = l.book JOIN rets r ON r.date = l.date AND r.ticker = k.ticker GROUP BY 1, 2),
c AS (SELECT strategy_id, date, SUM(ABS(d)) AS turnover FROM (SELECT strategy_id, date, ticker, SUM(d) AS d FROM (SELECT strategy_id, date, ticker, weight AS d FROM k
  UNION ALL SELECT k.strategy_id, s.nxt, k.ticker, -k.weight FROM k JOIN s ON s.strategy_id = k.strategy_id AND s.date = k.date WHERE s.nxt IS NOT NULL) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT n.strategy_id, b.date, COALESCE(g.gross, 0) - 0.001 * COALESCE(c.turnover, 0) AS ret FROM bdays b CROSS JOIN (SELECT DISTINCT strategy_id FROM k) n
  LEFT JOIN g ON g.strategy_id = n.strategy_id AND g.date = b.date LEFT JOIN c ON c.strategy_id = n.strategy_id AND c.date = b.date""")
def two_schedules(spark, d):
    """One strategy rebalances quarterly, the others monthly; each holds its own last book."""
    w = base.rule_weights(spark, d)
    return backtest.strategy_returns(w.where((F.col("strategy_id") != "momentum") | (F.month("date") % 3 == 0)), base.returns_table(spark, d))


@query("o16_rebalance_turnover", "strategy_id date turnover:6", "SELECT * FROM turn")
def rebalance_turnover(spark, d):
    return backtest.turnover(base.rule_weights(spark, d))


@query("o17_carry_forward", "strategy_id date ticker weight:6", """
WITH slots AS (SELECT DISTINCT date FROM wts), own AS (SELECT DISTINCT strategy_id, date AS book FROM wts WHERE month(date) % 3 = 0),
m AS (SELECT s.date, k.strategy_id, MAX(o.book) AS book FROM slots s CROSS JOIN (SELECT DISTINCT strategy_id FROM own) k JOIN own o ON o.strategy_id = k.strategy_id AND o.book <= s.date GROUP BY 1, 2)
SELECT m.strategy_id, m.date, w.ticker, w.weight FROM m JOIN wts w ON w.strategy_id = m.strategy_id AND w.date = m.book""")
def carry_forward(spark, d):
    """Only every third book is known; the months between repeat it."""
    w = base.rule_weights(spark, d)
    return backtest.carry_forward(w.where(F.month("date") % 3 == 0), w)


@query("o18_multi_strategy", "strategy_id n_dates n_names", "SELECT strategy_id, COUNT(DISTINCT date) AS n_dates, COUNT(DISTINCT ticker) AS n_names FROM wts GROUP BY 1")
def multi_strategy(spark, d):
    return base.rule_weights(spark, d).groupBy("strategy_id").agg(F.count_distinct("date").alias("n_dates"), F.count_distinct("ticker").alias("n_names"))


@query("o19_method_comparison", "sharpe_before:5 sharpe_after:5 turnover_before:6 turnover_after:6 cost_saved_bps:3", """
SELECT a.sharpe AS sharpe_before, b.sharpe AS sharpe_after, a.turnover AS turnover_before, b.turnover AS turnover_after, (a.turnover - b.turnover) * 2520 AS cost_saved_bps
FROM pack a, pack b WHERE a.strategy_id = 'momentum' AND b.strategy_id = 'composite'""")
def method_comparison(spark, d):
    return backtest.compare_methods(backtest.metric_pack(base.strategy_series(spark, d)), "momentum", "composite")


@query("o20_metric_pack", f"strategy_id {PACK}", "SELECT * FROM pack")
def metric_pack(spark, d):
    return backtest.metric_pack(base.strategy_series(spark, d))


_EXPO = """
WITH f AS (SELECT w.strategy_id, SUM(weight * usd_exposure) AS usd, SUM(CASE WHEN sector IN ('Industrial', 'Logistics', 'Materials', 'Infrastructure') THEN weight ELSE 0 END) AS ind
  FROM wts w JOIN univ u ON u.ticker = w.ticker WHERE date = (SELECT MAX(date) FROM wts) GROUP BY 1)
SELECT strategy_id, 'banxico_shock' AS scenario, -0.03 AS shock, 0.25 AS exposure FROM f
UNION ALL SELECT strategy_id, 'peso_depreciation', -0.05, LEAST(GREATEST(1 - usd, 0.20), 0.85) FROM f
UNION ALL SELECT strategy_id, 'us_slowdown', -0.04, LEAST(GREATEST(usd * 1.2, 0.15), 0.80) FROM f
UNION ALL SELECT strategy_id, 'tmec_disruption', -0.07, LEAST(GREATEST((ind * 0.6 + usd * 0.4) * 1.3, 0.20), 0.85) FROM f"""


@query("o21_scenario_exposures", "strategy_id scenario shock:4 exposure:6", _EXPO)
def scenario_exposures(spark, d):
    book = backtest.final_weights(base.rule_weights(spark, d))
    return risk.scenario_exposures(book, warehouse.universe(spark, d), SCENARIO_SHOCKS, INDUSTRIAL_EXPOSURE_SECTORS)


@query("r01_sharpe", "strategy_id sharpe:5", "SELECT strategy_id, sharpe FROM pack")
def sharpe(spark, d):
    return risk.sharpe(base.strategy_series(spark, d))


@query("r02_sortino", "strategy_id sortino:5", """
SELECT strategy_id, AVG(ret) / (CASE WHEN COUNT(*) FILTER (WHERE ret < 0) > 1 THEN sqrt(AVG(ret * ret) FILTER (WHERE ret < 0)) ELSE 0 END + 1e-9) * sqrt(252) AS sortino FROM ser GROUP BY 1""")
def sortino(spark, d):
    return risk.sortino(base.strategy_series(spark, d))


@query("r03_max_drawdown", "strategy_id max_drawdown:6", "SELECT strategy_id, MIN(drawdown) AS max_drawdown FROM ddown GROUP BY 1")
def max_drawdown(spark, d):
    return risk.max_drawdown(base.strategy_series(spark, d))


@query("r04_value_at_risk", "strategy_id var:7", "SELECT strategy_id, quantile_cont(ret, 0.05) AS var FROM ser GROUP BY 1")
def value_at_risk(spark, d):
    return risk.value_at_risk(base.strategy_series(spark, d))


@query("r05_expected_shortfall", "strategy_id cvar:7", """
SELECT s.strategy_id, AVG(ret) FILTER (WHERE ret <= v + 1e-12) AS cvar FROM ser s JOIN (SELECT strategy_id, quantile_cont(ret, 0.01) AS v FROM ser GROUP BY 1) q ON q.strategy_id = s.strategy_id GROUP BY 1""")
def expected_shortfall(spark, d):
    return risk.value_at_risk(base.strategy_series(spark, d), 0.99)


@query("r06_annualised", "strategy_id annualized_return:6 annualized_vol:6", "SELECT strategy_id, exp(AVG(ret) * 252) - 1 AS annualized_return, stddev_samp(ret) * sqrt(252) AS annualized_vol FROM ser GROUP BY 1")
def annualised(spark, d):
    return risk.annualised(base.strategy_series(spark, d))


@query("r07_stress_test", "strategy_id scenario mean_return:8 volatility:7 sharpe:5 max_drawdown:6", f"""
WITH e AS ({_EXPO}), s AS (SELECT r.strategy_id, e.scenario, date, ret + CASE WHEN (row_number() OVER (PARTITION BY r.strategy_id, e.scenario ORDER BY date) - 1) % 126 < 21 THEN CAST(shock AS DOUBLE) * exposure / 21 ELSE 0 END AS ret
  FROM ser r JOIN e ON e.strategy_id = r.strategy_id),
w AS (SELECT *, exp(SUM(ret) OVER (PARTITION BY strategy_id, scenario ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM s),
p AS (SELECT *, wealth / MAX(wealth) OVER (PARTITION BY strategy_id, scenario ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM w)
SELECT strategy_id, scenario, AVG(ret) AS mean_return, stddev_pop(ret) AS volatility, sqrt(252) * (AVG(ret) - 0.02::DOUBLE / 252) / (stddev_pop(ret) + 1e-9) AS sharpe, MIN(dd) AS max_drawdown FROM p GROUP BY 1, 2""")
def stress_test(spark, d):
    return risk.stress_test(base.strategy_series(spark, d), scenario_exposures(spark, d), shock_days=21)


_FIXED = """SELECT f.strategy_id, r.date, r.pos, SUM(r.ret * f.weight / f.total) AS ret FROM rets r JOIN (
  SELECT strategy_id, ticker, weight, SUM(weight) OVER (PARTITION BY strategy_id) AS total FROM wts WHERE date = (SELECT MAX(date) FROM wts)) f ON f.ticker = r.ticker GROUP BY 1, 2, 3"""

_MASKS = """SELECT date, pos, unnest([CASE WHEN ABS(dr) > 0.01 THEN 'banxico_shock' END, CASE WHEN fx > 0.05 THEN 'peso_depreciation' END,
    CASE WHEN ip < 0 AND eq < -0.08 THEN 'us_slowdown' END, CASE WHEN fx > 0.04 AND ip < 1 AND ex < 0 THEN 'tmec_disruption' END]) AS scenario FROM (
  SELECT b.date, b.pos, m.banxico_rate - lag(m.banxico_rate, 21) OVER w AS dr, m.usd_mxn / lag(m.usd_mxn, 21) OVER w - 1 AS fx, m.us_ip_yoy AS ip, m.sp500 / lag(m.sp500, 21) OVER w - 1 AS eq, m.exports_yoy AS ex
  FROM bdays b ASOF LEFT JOIN mac m ON b.date >= m.date WINDOW w AS (ORDER BY b.date))"""

_WINDOWS = f"""
WITH RECURSIVE act AS (SELECT DISTINCT scenario, pos FROM ({_MASKS}) WHERE scenario IS NOT NULL AND LEAST(pos + 20, (SELECT MAX(pos) FROM bdays)) - pos + 1 >= 10),
kept AS (SELECT scenario, MIN(pos) AS pos FROM act GROUP BY scenario
  UNION ALL SELECT k.scenario, (SELECT MIN(a.pos) FROM act a WHERE a.scenario = k.scenario AND a.pos >= k.pos + 10) AS pos FROM kept k WHERE k.pos IS NOT NULL),
fin AS (SELECT * FROM kept WHERE pos IS NOT NULL),
bk AS ({_FIXED}),
own AS (SELECT b.strategy_id, f.scenario, MIN(b.date) AS start, CAST(MIN(b.date) AS VARCHAR) || ' to ' || CAST(MAX(b.date) AS VARCHAR) AS label, exp(SUM(b.ret)) - 1 AS pnl
  FROM fin f JOIN bk b ON b.pos BETWEEN f.pos AND f.pos + 20 GROUP BY b.strategy_id, f.scenario, f.pos)
SELECT strategy_id, scenario, label, start, pnl FROM own"""


@query("r08_stress_windows", "strategy_id scenario label start pnl:7", _WINDOWS)
def stress_windows(spark, d):
    book = risk.fixed_weight_returns(backtest.final_weights(base.rule_weights(spark, d)), base.returns_table(spark, d))
    return risk.stress_windows(book, warehouse.macro(spark, d))


_DRAWS = hashed("(SELECT unnest(generate_series(0, 4999)) AS rep)", 42, {"u": 11}, "rep", "0")


@query("r08b_stress_distribution", "strategy_id scenario n_windows mean:7 p5:7 p25:7 p50:7 p75:7 p95:7 std:7 cvar_95:7 worst_window", f"""
SELECT strategy_id, scenario, MAX(n) AS n_windows, AVG(pnl) AS mean, MAX(p5) AS p5, quantile_cont(pnl, 0.25) AS p25, quantile_cont(pnl, 0.5) AS p50, quantile_cont(pnl, 0.75) AS p75,
  quantile_cont(pnl, 0.95) AS p95, stddev_samp(pnl) AS std, AVG(pnl) FILTER (WHERE pnl <= p5 + 1e-12) AS cvar_95, MAX(worst) AS worst_window FROM (
  SELECT *, quantile_cont(pnl, 0.05) OVER (PARTITION BY strategy_id, scenario) AS p5 FROM (
    SELECT w.strategy_id, w.scenario, n, worst, w.pnl FROM (
      SELECT *, row_number() OVER (PARTITION BY strategy_id, scenario ORDER BY start, label) - 1 AS i, COUNT(*) OVER (PARTITION BY strategy_id, scenario) AS n,
        first_value(label) OVER (PARTITION BY strategy_id, scenario ORDER BY pnl, start, label) AS worst FROM ({_WINDOWS})) w
    JOIN ({_DRAWS}) u ON floor(u.u * w.n) = w.i)) GROUP BY 1, 2""")
def stress_distribution(spark, d):
    return risk.stress_distribution(stress_windows(spark, d))


@query("r09_threshold_regimes", "date regime banxico_delta_3m:7 fx_mom_3m:6", """
SELECT date, dr AS banxico_delta_3m, fx AS fx_mom_3m, CASE WHEN ip < 0 OR fx > 0.05 THEN 'stress' WHEN dr > 0.01 THEN 'tightening' ELSE 'expansion' END AS regime FROM (
  SELECT date, industrial_production_yoy AS ip, usd_mxn / lag(usd_mxn, 3) OVER (ORDER BY date) - 1 AS fx, banxico_rate - lag(banxico_rate, 3) OVER (ORDER BY date) AS dr FROM mac)""")
def threshold_regimes(spark, d):
    return regimes.threshold_regimes(warehouse.macro(spark, d), rate_step=0.01)


_Z = "CASE WHEN COUNT({c}) OVER w >= 3 THEN ({c} - AVG({c}) OVER w) / (NULLIF(stddev_pop({c}) OVER w, 0) + 1e-9) END"
CTES["regimehist"] = f"""
WITH RECURSIVE x AS (SELECT date, industrial_production_yoy AS ip, usd_mxn / lag(usd_mxn, 3) OVER (ORDER BY date) - 1 AS fx, banxico_rate - lag(banxico_rate, 3) OVER (ORDER BY date) AS dr FROM mac),
z AS (SELECT date, {_Z.format(c='ip')} - {_Z.format(c='fx')} - {_Z.format(c='dr')} AS s FROM x WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
n AS (SELECT date, s, row_number() OVER (ORDER BY date) AS i FROM z WHERE s IS NOT NULL),
e AS (SELECT date, i, s, s AS sm FROM n WHERE i = 1 UNION ALL SELECT n.date, n.i, n.s, e.sm * (5::DOUBLE / 7) + n.s * (2::DOUBLE / 7) FROM e JOIN n ON n.i = e.i + 1),
r AS (SELECT z.date, z.s AS regime_score, CASE WHEN e.i >= 3 THEN e.sm END AS regime_score_smoothed FROM z LEFT JOIN e ON e.date = z.date),
q AS (SELECT *, LEAST(ABS(regime_score_smoothed), 3) AS regime_confidence, CASE WHEN regime_score_smoothed IS NULL OR regime_score_smoothed > 0.5 THEN 'expansion' WHEN regime_score_smoothed < -0.5 THEN 'stress' ELSE 'tightening' END AS raw_regime,
  row_number() OVER (ORDER BY date) AS k FROM r)
SELECT *, last_value(CASE WHEN regime_confidence IS NULL OR regime_confidence >= 0.3 OR k = 1 THEN raw_regime END IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS regime FROM q"""


@query("r10_composite_regimes", "date regime raw_regime regime_score:6 regime_score_smoothed:6 regime_confidence:6", "SELECT * FROM regimehist")
def composite_regimes(spark, d):
    return regimes.composite_regimes(warehouse.macro(spark, d))


@query("r11_latest_regime", "regime", "SELECT regime FROM regimehist WHERE date = (SELECT MAX(date) FROM regimehist)")
def latest_regime(spark, d):
    return regimes.latest_regime(regimes.regime_history(warehouse.macro(spark, d)))


_LIST = lambda xs: "[" + ", ".join(f"{x!r}::DOUBLE" for x in xs) + "]"
CTES["resid"] = "SELECT strategy_id, date, ret, ret - AVG(ret) OVER (PARTITION BY strategy_id) AS e, row_number() OVER (PARTITION BY strategy_id ORDER BY date) AS i FROM ser"
CTES["garch"] = f"""
WITH RECURSIVE v AS (SELECT strategy_id, COUNT(*) AS n, GREATEST(AVG(e * e), 1e-16::DOUBLE) AS var, AVG(ret) AS mean FROM resid GROUP BY 1),
p AS (SELECT a, g, b FROM (SELECT unnest({_LIST(volatility.ALPHAS)}) AS a) CROSS JOIN (SELECT unnest({_LIST(volatility.GAMMAS)}) AS g) CROSS JOIN (SELECT unnest({_LIST(volatility.BETAS)}) AS b) WHERE a + g / 2 + b < 0.999::DOUBLE),
r AS (SELECT strategy_id, a, g, b, var * (1 - a - g / 2 - b) AS omega, 0::BIGINT AS i, var AS h, 0::DOUBLE AS nll FROM v CROSS JOIN p
  UNION ALL SELECT r.strategy_id, a, g, b, omega, resid.i, omega + (a + CASE WHEN e < 0 THEN g ELSE 0 END) * e * e + b * h, nll + ln(h) + e * e / h FROM r JOIN resid ON resid.strategy_id = r.strategy_id AND resid.i = r.i + 1),
w AS (SELECT r.strategy_id, v.n, v.var, v.mean, arg_min(struct_pack(omega := omega, a := a, g := g, b := b, nll := nll, h := h), nll) AS s FROM r JOIN v ON v.strategy_id = r.strategy_id AND v.n = r.i GROUP BY 1, 2, 3, 4)
SELECT strategy_id, n, var, mean, s.omega AS omega, s.a AS alpha, s.g AS gamma, s.b AS beta, 0.5 * s.nll + 0.5 * n * ln(2 * pi()) AS nll, s.h AS next_var FROM w"""
CTES["egarch"] = f"""
WITH RECURSIVE v AS (SELECT strategy_id, COUNT(*) AS n, GREATEST(AVG(e * e), 1e-16::DOUBLE) AS var FROM resid GROUP BY 1),
p AS (SELECT a, b FROM (SELECT unnest({_LIST(volatility.LOG_ALPHAS)}) AS a) CROSS JOIN (SELECT unnest({_LIST(volatility.LOG_BETAS)}) AS b)),
r AS (SELECT strategy_id, a, b, ln(var) * (1 - b) AS omega, 0::BIGINT AS i, var AS h, 0::DOUBLE AS nll FROM v CROSS JOIN p
  UNION ALL SELECT r.strategy_id, a, b, omega, resid.i, exp(omega + a * (abs(e) / sqrt(h) - {volatility.NORMAL_SIZE!r}::DOUBLE) + b * ln(h)), nll + ln(h) + e * e / h FROM r JOIN resid ON resid.strategy_id = r.strategy_id AND resid.i = r.i + 1),
w AS (SELECT r.strategy_id, v.n, arg_min(struct_pack(omega := omega, a := a, b := b, nll := nll, h := h), nll) AS s FROM r JOIN v ON v.strategy_id = r.strategy_id AND v.n = r.i GROUP BY 1, 2)
SELECT strategy_id, n, s.omega AS omega, s.a AS alpha, 0::DOUBLE AS gamma, s.b AS beta, 0.5 * s.nll + 0.5 * n * ln(2 * pi()) AS nll, s.h AS next_var FROM w"""


@query("r12_garch_grid", "strategy_id n omega:10 alpha:4 gamma:4 beta:4 nll:4 fallback", "SELECT * REPLACE (CAST(n AS INT) AS n), FALSE AS fallback FROM garch")
def garch_grid(spark, d):
    return volatility.fit_series(base.strategy_series(spark, d))


@query("r12b_egarch_grid", "strategy_id n omega:8 alpha:4 gamma:4 beta:4 nll:4 fallback", "SELECT * REPLACE (CAST(n AS INT) AS n), FALSE AS fallback FROM egarch")
def egarch_grid(spark, d):
    return volatility.fit_series(base.strategy_series(spark, d), "EGARCH")


@query("r13_garch_forecast", "strategy_id annual_vol:6", """
SELECT strategy_id, sqrt(GREATEST(l + (next_var - l) * (1 - pow(p, 21)) / ((1 - p) * 21), 0) * 252) AS annual_vol FROM (SELECT *, alpha + gamma / 2 + beta AS p, omega / (1 - alpha - gamma / 2 - beta) AS l FROM garch)""")
def garch_forecast(spark, d):
    return volatility.forecast(volatility.fit_series(base.strategy_series(spark, d)), 21)


@query("r13b_egarch_forecast", "strategy_id annual_vol:6", """
SELECT strategy_id, sqrt(252 * list_avg([exp(l + (ln(next_var) - l) * pow(beta, k)) FOR k IN range(21)])) AS annual_vol FROM (SELECT *, omega / (1 - beta) AS l FROM egarch)""")
def egarch_forecast(spark, d):
    return volatility.forecast(volatility.fit_series(base.strategy_series(spark, d), "EGARCH"), 21)


@query("r14_rolling_forecast", "strategy_id date garch_vol:6")
def rolling_forecast(spark, d):
    return volatility.rolling_forecast(base.strategy_series(spark, d), DEFAULTS["garch_forecast_horizon"], DEFAULTS["garch_lookback"], DEFAULTS["garch_refit_every"])


@query("r15_dynamic_var", "strategy_id date sigma:7 dynamic_var:7", """
WITH RECURSIVE h AS (SELECT g.strategy_id, r.date, r.e, r.i, g.var AS h FROM garch g JOIN resid r ON r.strategy_id = g.strategy_id AND r.i = 1
  UNION ALL SELECT h.strategy_id, r.date, r.e, r.i, omega + (alpha + CASE WHEN h.e < 0 THEN gamma ELSE 0 END) * h.e * h.e + beta * h.h FROM h JOIN garch g ON g.strategy_id = h.strategy_id JOIN resid r ON r.strategy_id = h.strategy_id AND r.i = h.i + 1)
SELECT strategy_id, date, sqrt(h) AS sigma, sqrt(h) * quantile_cont(e / sqrt(h), 0.05) OVER (PARTITION BY strategy_id) AS dynamic_var FROM h""")
def dynamic_var(spark, d):
    return volatility.dynamic_var(base.strategy_series(spark, d))


@query("r15b_ewma_dynamic_var", "strategy_id date dynamic_var:7", """
WITH RECURSIVE s AS (SELECT strategy_id, date, ret, row_number() OVER (PARTITION BY strategy_id ORDER BY date) AS i FROM ser),
r AS (SELECT strategy_id, date, i, ret, ret AS mean, 0.0::DOUBLE AS m2, 1.0::DOUBLE AS w2 FROM s WHERE i = 1
  UNION ALL SELECT s.strategy_id, s.date, s.i, s.ret, r.mean + (1::DOUBLE / 11) * (s.ret - r.mean), (10::DOUBLE / 11) * (r.m2 + (1::DOUBLE / 11) * (s.ret - r.mean) * (s.ret - r.mean)),
    (10::DOUBLE / 11) * (10::DOUBLE / 11) * r.w2 + (1::DOUBLE / 11) * (1::DOUBLE / 11) FROM r JOIN s ON s.strategy_id = r.strategy_id AND s.i = r.i + 1),
v AS (SELECT strategy_id, date, ret, CASE WHEN i >= 10 THEN sqrt(GREATEST(m2 / NULLIF(1 - w2, 0), 0)) END AS sigma FROM r)
SELECT strategy_id, date, sigma * quantile_cont(CASE WHEN sigma > 1e-9 THEN ret / sigma END, 0.05) OVER (PARTITION BY strategy_id) AS dynamic_var FROM v WHERE sigma IS NULL OR sigma > 1e-9""")
def ewma_dynamic_var(spark, d):
    vol = risk.realised_volatility(base.strategy_series(spark, d), "ewma", 21)
    sigma = vol.withColumn("sigma", F.col("realized_vol") / F.sqrt(F.lit(252.0)))
    return risk.scaled_dynamic_var(sigma.where(F.coalesce("sigma", F.lit(1.0)) > 1e-9))


_NORMALS = hashed("(SELECT unnest(generate_series(0, 9999)) AS rep)", 42, {"u1": 21, "u2": 22}, "rep", "0")


@query("r16_monte_carlo_var", "strategy_id mc_var:7 n_sim", f"""
WITH bk AS ({_FIXED}), law AS (SELECT strategy_id, AVG(ret) AS mu, stddev_samp(ret) AS sigma FROM bk GROUP BY 1)
SELECT strategy_id, quantile_cont(mu + sigma * sqrt(-2 * ln(u1)) * cos(6.283185307179586 * u2), 0.05) AS mc_var, COUNT(*) AS n_sim FROM law CROSS JOIN ({_NORMALS}) GROUP BY 1""")
def monte_carlo_var(spark, d):
    """Univariate law of the current book."""
    book = risk.fixed_weight_returns(backtest.final_weights(base.rule_weights(spark, d)), base.returns_table(spark, d))
    law = book.groupBy("strategy_id").agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sigma"))
    return risk.monte_carlo_var(law)


_LW = """
WITH x AS (SELECT r.ticker, r.pos, r.ret - AVG(r.ret) OVER (PARTITION BY r.ticker) AS z FROM rets r),
t AS (SELECT pos, SUM(z * z) AS q FROM x GROUP BY pos), n AS (SELECT COUNT(*) AS n, SUM(q * q) AS b FROM t), p AS (SELECT COUNT(DISTINCT ticker) AS p FROM x),
c AS (SELECT a.ticker AS i, b.ticker AS j, SUM(a.z * b.z) AS s FROM x a JOIN x b ON a.pos = b.pos GROUP BY 1, 2),
d AS (SELECT SUM(s * s) / MAX(n) / MAX(n) AS delta, SUM(CASE WHEN i = j THEN s END) / MAX(n) AS tr FROM c, n),
k AS (SELECT n, p, tr / p AS mu, tr, GREATEST(LEAST((b / n - delta) / (p * n), (delta - 2 * tr / p * tr + p * (tr / p) * (tr / p)) / p) / ((delta - 2 * tr / p * tr + p * (tr / p) * (tr / p)) / p), 0) AS shrink FROM n, p, d)"""


@query("r16b_monte_carlo_factor", "strategy_id sigma:8 mc_var:7", f"""
{_LW}, f AS (SELECT strategy_id, ticker, weight / SUM(weight) OVER (PARTITION BY strategy_id) AS w FROM wts WHERE date = (SELECT MAX(date) FROM wts)),
bk AS ({_FIXED}), law AS (SELECT b.strategy_id, AVG(b.ret) AS mu, sqrt((1 - MAX(k.shrink)) * var_pop(b.ret) + MAX(k.shrink) * MAX(k.mu) * MAX(g.w2)) AS sigma
  FROM bk b, k, (SELECT strategy_id, SUM(w * w) AS w2 FROM f GROUP BY 1) g WHERE g.strategy_id = b.strategy_id GROUP BY 1)
SELECT strategy_id, MAX(sigma) AS sigma, quantile_cont(mu + sigma * sqrt(-2 * ln(u1)) * cos(6.283185307179586 * u2), 0.05) AS mc_var FROM law CROSS JOIN ({_NORMALS}) GROUP BY strategy_id""")
def monte_carlo_factor(spark, d):
    """Correlated law: portfolio variance under the shrunk covariance of all tickers."""
    book = backtest.final_weights(base.rule_weights(spark, d))
    law = covariance.portfolio_law(book, base.returns_table(spark, d))
    out = risk.monte_carlo_var(law)
    return out.join(law.select("strategy_id", "sigma"), "strategy_id")


CTES["gevfit"] = """
WITH t AS (SELECT strategy_id, -ret AS x, row_number() OVER (PARTITION BY strategy_id ORDER BY -ret, date) AS i, COUNT(*) OVER (PARTITION BY strategy_id) AS n FROM ser WHERE ret < 0),
b AS (SELECT strategy_id, MAX(n) AS n, AVG(x) AS b0, AVG(x * (i - 1) / (n - 1)) AS b1, AVG(x * (i - 1) / (n - 1) * (i - 2) / (n - 2)) AS b2 FROM t GROUP BY 1),
s AS (SELECT *, (2 * b1 - b0) / (3 * b2 - b0) - 0.6309297535714574 AS c FROM b),
g AS (SELECT *, 7.859 * c + 2.9554 * c * c AS k FROM s), h AS (SELECT g.*, gamma(1 + k) AS gk FROM g),
q AS (SELECT *, (2 * b1 - b0) * k / (gk * (1 - pow(2, -k))) AS scale FROM h), p AS (SELECT *, b0 + scale * (gk - 1) / k AS loc FROM q),
f AS (SELECT t.strategy_id, t.i, t.n, CASE WHEN 1 - p.k * (x - loc) / scale <= 0 THEN CASE WHEN p.k > 0 THEN 1 ELSE 0 END ELSE exp(-pow(1 - p.k * (x - loc) / scale, 1 / p.k)) END AS cdf FROM t JOIN p ON p.strategy_id = t.strategy_id)
SELECT p.strategy_id, p.n AS n_tail, p.k AS shape, p.loc, p.scale, m.ks FROM p JOIN (SELECT strategy_id, MAX(GREATEST(i::DOUBLE / n - cdf, cdf - (i - 1)::DOUBLE / n)) AS ks FROM f GROUP BY 1) m ON m.strategy_id = p.strategy_id"""


@query("r17_gev_tail", "strategy_id n_tail shape:6 loc:8 scale:8 ks:6", "SELECT * FROM gevfit")
def gev_tail(spark, d):
    return tails.gev_fit(base.strategy_series(spark, d))


_KS = " + ".join(f"({2.0 * (-1) ** (j - 1)!r}::DOUBLE) * exp({-2.0 * j * j!r}::DOUBLE * lam * lam)" for j in range(1, 21))


@query("r17b_gev_var", "strategy_id method gev_var:7 gev_cvar:7", f"""
WITH p AS (SELECT *, (sqrt(n_tail) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n_tail)) * ks AS lam, loc + scale * (1 - pow(-ln(0.95::DOUBLE), shape)) / shape AS v,
  loc + scale * (1 - pow(-ln(0.9999::DOUBLE), shape)) / shape AS top FROM gevfit),
g AS (SELECT *, (top - v) / 999 AS step, unnest(generate_series(0, 999)) AS j FROM p),
t AS (SELECT *, v + step * j AS x, pow(GREATEST(1 - shape * (v + step * j - loc) / scale, 1e-300::DOUBLE), 1 / shape) AS t FROM g),
a AS (SELECT strategy_id, SUM(CASE WHEN j IN (0, 999) THEN 0.5::DOUBLE ELSE 1 END * x * pow(t, 1 - shape) * exp(-t) / scale * step) AS area FROM t GROUP BY 1),
l AS (SELECT strategy_id, ret, quantile_cont(ret, 0.05) OVER (PARTITION BY strategy_id) AS l FROM ser),
e AS (SELECT strategy_id, MAX(l) AS ev, AVG(CASE WHEN ret <= l + 1e-12 THEN ret END) AS ec FROM l GROUP BY 1),
o AS (SELECT e.*, p.v, a.area, COALESCE(p.n_tail >= 20 AND CASE WHEN p.lam < 0.2 THEN 1 ELSE LEAST(GREATEST({_KS}, 0), 1) END >= 0.05, FALSE) AS good
  FROM e LEFT JOIN p ON p.strategy_id = e.strategy_id LEFT JOIN a ON a.strategy_id = e.strategy_id)
SELECT strategy_id, CASE WHEN good THEN 'gev' ELSE 'empirical' END AS method, CASE WHEN good THEN -v ELSE ev END AS gev_var, CASE WHEN good THEN -area / 0.05::DOUBLE ELSE ec END AS gev_cvar FROM o""")
def gev_var(spark, d):
    return tails.gev_var(base.strategy_series(spark, d))


@query("r18_regime_switches", "method switches", """
SELECT 'ewma' AS method, CAST(SUM(CASE WHEN regime <> p THEN 1 ELSE 0 END) AS BIGINT) AS switches FROM (SELECT regime, lag(regime) OVER (ORDER BY date) AS p FROM regimehist)
UNION ALL SELECT 'threshold', CAST(SUM(CASE WHEN r <> p THEN 1 ELSE 0 END) AS BIGINT) FROM (SELECT r, lag(r) OVER (ORDER BY date) AS p FROM (SELECT date, CASE WHEN ip < 0 OR fx > 0.05 THEN 'stress' WHEN dr > 0.25 THEN 'tightening' ELSE 'expansion' END AS r FROM (
    SELECT date, industrial_production_yoy AS ip, usd_mxn / lag(usd_mxn, 3) OVER (ORDER BY date) - 1 AS fx, banxico_rate - lag(banxico_rate, 3) OVER (ORDER BY date) AS dr FROM mac)))""")
def regime_switches(spark, d):
    m = warehouse.macro(spark, d)
    one = lambda h, name: regimes.count_switches(h).withColumn("method", F.lit(name))
    return one(regimes.composite_regimes(m), "ewma").unionByName(one(regimes.threshold_regimes(m), "threshold"))
