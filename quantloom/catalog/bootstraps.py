"""Resampling and significance queries (inventory group B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import backtest, resampling, risk, significance
from ..settings import DEFAULTS
from . import base, relational
from .core import query
from .ctes import CTES, hashed

#: Replicates of intervals and p-values, and paths of the fan chart.
REPS, PATHS = DEFAULTS["bootstrap_n_reps"], 1000

CTES["rowsn"] = "SELECT strategy_id, ret, CAST(row_number() OVER (PARTITION BY strategy_id ORDER BY date) - 1 AS BIGINT) AS i, COUNT(*) OVER (PARTITION BY strategy_id) AS n FROM ser"


def _draws(reps: int, block: int, n: str) -> str:
    """(rep, pos, src) of the circular block bootstrap for series of length n."""
    grid = f"(SELECT rep, pos, n FROM (SELECT unnest(generate_series(0, {reps - 1})) AS rep) CROSS JOIN (SELECT unnest(generate_series(0, n - 1)) AS pos, n FROM ({n})))"
    u = hashed(grid, 42, {"u1": 1, "u2": 2}, "rep", "pos")
    return f"""SELECT rep, pos, (start_ + pos - opened) % n AS src FROM (
  SELECT rep, pos, n, opened, arg_max(CAST(floor(u2 * n) AS BIGINT), pos) FILTER (WHERE fresh) OVER (PARTITION BY rep ORDER BY pos ROWS UNBOUNDED PRECEDING) AS start_ FROM (
    SELECT *, MAX(CASE WHEN fresh THEN pos ELSE 0 END) OVER (PARTITION BY rep ORDER BY pos ROWS UNBOUNDED PRECEDING) AS opened FROM (SELECT *, pos = 0 OR u1 < {1.0 / block!r}::DOUBLE AS fresh FROM ({u}))))"""


CTES["bdraws"] = _draws(REPS, 20, "SELECT MAX(n) AS n FROM rowsn")
CTES["bsample"] = "SELECT r.strategy_id, d.rep, d.pos, r.ret FROM bdraws d JOIN rowsn r ON r.i = d.src"
CTES["pdraws"] = _draws(PATHS, 20, "SELECT MAX(n) AS n FROM rowsn")
CTES["psample"] = "SELECT r.strategy_id, d.rep, d.pos, r.ret FROM pdraws d JOIN rowsn r ON r.i = d.src"
CTES["bmetric"] = """
WITH s AS (SELECT *, exp(SUM(ret) OVER (PARTITION BY strategy_id, rep ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS wealth FROM bsample),
p AS (SELECT *, wealth / MAX(wealth) OVER (PARTITION BY strategy_id, rep ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM s),
v AS (SELECT strategy_id, rep, quantile_cont(ret, 0.05) AS q FROM bsample GROUP BY 1, 2)
SELECT p.strategy_id, p.rep, sqrt(252) * (AVG(ret) - 0.02::DOUBLE / 252) / (stddev_pop(ret) + 1e-9) AS sharpe,
  (AVG(ret) - 0.02::DOUBLE / 252) / (CASE WHEN COUNT(*) FILTER (WHERE ret < 0.02::DOUBLE / 252) > 1 THEN sqrt(AVG(pow(ret - 0.02::DOUBLE / 252, 2)) FILTER (WHERE ret < 0.02::DOUBLE / 252)) ELSE 0 END + 1e-9) * sqrt(252) AS sortino,
  AVG(ret) FILTER (WHERE ret <= q + 1e-12) AS cvar_95, MIN(dd) AS max_drawdown, exp(AVG(ret) * 252) - 1 AS cagr
FROM p JOIN v ON v.strategy_id = p.strategy_id AND v.rep = p.rep GROUP BY 1, 2"""


@query("b01_block_indices", "strategy_id rep ret_sum:7 ret_sq:8 first_ret:7", """
SELECT strategy_id, CAST(rep AS INT) AS rep, SUM(ret) AS ret_sum, SUM(ret * ret) AS ret_sq, MAX(CASE WHEN pos = 700 THEN ret END) AS first_ret FROM bsample GROUP BY 1, 2""")
def block_indices(spark, d):
    paths = resampling.bootstrap_paths(base.strategy_series(spark, d), n_paths=REPS)
    return paths.groupBy("strategy_id", F.col("path_id").alias("rep")).agg(
        F.sum("ret").alias("ret_sum"), F.sum(F.col("ret") * F.col("ret")).alias("ret_sq"), F.max(F.when(F.col("pos") == 700, F.col("ret"))).alias("first_ret"))


_POINTS = "SELECT strategy_id, UNNEST(['sharpe', 'sortino', 'cvar_95', 'max_drawdown', 'cagr']) AS metric, UNNEST([sharpe, sortino, cvar_95, max_drawdown, annualized_return]) AS point FROM pack"
_LONG = "SELECT strategy_id, rep, UNNEST(['sharpe', 'sortino', 'cvar_95', 'max_drawdown', 'cagr']) AS metric, UNNEST([sharpe, sortino, cvar_95, max_drawdown, cagr]) AS value FROM bmetric"


def metric_points(series, keys=("strategy_id",)):
    pack = backtest.metric_pack(series, keys=keys).withColumnRenamed("annualized_return", "cagr")
    return pack.unpivot(list(keys), ["sharpe", "sortino", "cvar_95", "max_drawdown", "cagr"], "metric", "point")


@query("b02_metric_intervals", "strategy_id metric point:5 ci_low:5 ci_high:5 se:6 n_reps", f"""
SELECT l.strategy_id, l.metric, MAX(point) AS point, quantile_cont(value, 0.025) AS ci_low, quantile_cont(value, 0.975) AS ci_high, stddev_samp(value) AS se, COUNT(value) AS n_reps
FROM ({_LONG}) l JOIN ({_POINTS}) p ON p.strategy_id = l.strategy_id AND p.metric = l.metric GROUP BY 1, 2""")
def metric_intervals(spark, d):
    s = base.strategy_series(spark, d)
    draws = resampling.bootstrap_metrics(s, n_reps=REPS)
    return resampling.summarise(draws, metric_points(s), ["strategy_id"])


_PAIRQ = """
WITH b AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, ret AS bench FROM bench WHERE benchmark = 'ALL'),
s AS (SELECT r.strategy_id, d.rep, r.ret, b.bench FROM bdraws d JOIN rowsn r ON r.i = d.src JOIN b ON b.i = d.src),
m AS (SELECT strategy_id, rep, covar_samp(ret, bench) / (var_samp(bench) + 1e-12) AS beta, exp(AVG(ret) * 252) - 1 AS rp, exp(AVG(bench) * 252) - 1 AS rm,
  sqrt(252) * AVG(ret - bench) / (stddev_pop(ret - bench) + 1e-9) AS information_ratio, stddev_pop(ret - bench) * sqrt(252) AS tracking_error FROM s GROUP BY 1, 2)
SELECT strategy_id, CAST(rep AS INT) AS rep, rp - (0.04 + beta * (rm - 0.04)) AS alpha_annualized, information_ratio, tracking_error FROM m"""


@query("b03_paired_metrics", "strategy_id rep alpha_annualized:6 information_ratio:5 tracking_error:6", _PAIRQ)
def paired_metrics(spark, d):
    bench = base.benchmark_series(spark, d).where("benchmark = 'ALL'")
    pairs = significance.align(base.strategy_series(spark, d), bench)
    draws = resampling.bootstrap_pairs(pairs, ["strategy_id", "benchmark"], n_reps=REPS)
    return draws.groupBy("strategy_id", "rep").pivot("metric", ["alpha_annualized", "information_ratio", "tracking_error"]).agg(F.first("value"))


@query("b04_sign_p_value", "strategy_id metric p_value:5", f"""
SELECT l.strategy_id, l.metric, CASE WHEN ABS(MAX(point)) < 1e-12 THEN 1 ELSE AVG(CASE WHEN (point > 0 AND value <= 0) OR (point <= 0 AND value >= 0) THEN 1.0::DOUBLE ELSE 0 END) END AS p_value
FROM ({_LONG}) l JOIN ({_POINTS}) p ON p.strategy_id = l.strategy_id AND p.metric = l.metric WHERE l.metric IN ('sharpe', 'cagr') GROUP BY 1, 2""")
def sign_p_value(spark, d):
    s = base.strategy_series(spark, d)
    draws = resampling.bootstrap_metrics(s, metrics=("sharpe", "cagr"), n_reps=REPS)
    return resampling.summarise(draws, metric_points(s), ["strategy_id"])


@query("b05_block_length", "strategy_id n m block_raw:4 block", """
WITH e AS (SELECT strategy_id, i, n, ret - AVG(ret) OVER (PARTITION BY strategy_id) AS e FROM rowsn),
c AS (SELECT strategy_id, MAX(n) AS n, 5 AS kn, CAST(ceil(sqrt(MAX(n))) AS INT) + 5 AS mmax, 2 * sqrt(log10(MAX(n)) / MAX(n)) AS cv, MAX(i) AS top FROM e GROUP BY 1),
k AS (SELECT c.*, unnest(generate_series(0, mmax)) AS k FROM c),
x AS (SELECT k.strategy_id, k.k, SUM(a.e * b.e) AS cr FROM k JOIN e a ON a.strategy_id = k.strategy_id AND a.i >= k.k JOIN e b ON b.strategy_id = a.strategy_id AND b.i = a.i - k.k GROUP BY 1, 2),
v AS (SELECT k.strategy_id, k.k, SUM(CASE WHEN e.i >= k.k + 1 THEN e.e * e.e END) AS v1, SUM(CASE WHEN e.i <= e.n - k.k - 2 THEN e.e * e.e END) AS v2 FROM k JOIN e ON e.strategy_id = k.strategy_id GROUP BY 1, 2),
a AS (SELECT x.strategy_id, x.k, x.cr, ABS(x.cr) / sqrt(v1 * v2) AS ac FROM x JOIN v ON v.strategy_id = x.strategy_id AND v.k = x.k),
q AS (SELECT a.strategy_id, a.k, MAX(ac) OVER (PARTITION BY a.strategy_id ORDER BY a.k ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS worst FROM a),
o AS (SELECT c.strategy_id, c.n, c.mmax, MIN(CASE WHEN q.k >= 5 AND q.worst < c.cv THEN q.k - 5 END) AS opt FROM c JOIN q ON q.strategy_id = c.strategy_id GROUP BY 1, 2, 3),
m AS (SELECT *, CASE WHEN opt IS NULL THEN mmax ELSE LEAST(2 * GREATEST(opt, 1), mmax) END AS m FROM o),
l AS (SELECT m.*, a.k, a.cr / n AS acv, CASE WHEN a.k::DOUBLE / m <= 0.5 THEN 1 ELSE 2 * (1 - a.k::DOUBLE / m) END AS lam FROM m JOIN a ON a.strategy_id = m.strategy_id AND a.k <= m),
g AS (SELECT strategy_id, MAX(n) AS n, MAX(m) AS m, SUM(CASE WHEN k > 0 THEN 2 * lam * k * acv END) AS g, SUM(CASE WHEN k = 0 THEN acv ELSE 2 * lam * acv END) AS lr FROM l GROUP BY 1),
r AS (SELECT *, LEAST(pow(2 * g * g / (2 * lr * lr) * n, 1.0::DOUBLE / 3), ceil(LEAST(3 * sqrt(n), n / 3.0::DOUBLE))) AS block_raw FROM g)
SELECT strategy_id, CAST(n AS INT) AS n, CAST(m AS INT) AS m, block_raw, CAST(LEAST(GREATEST(round(block_raw), 5), 60) AS INT) AS block FROM r""")
def block_length(spark, d):
    return resampling.optimal_block_length(base.strategy_series(spark, d))


@query("b06_bootstrap_paths", "strategy_id path_id n end_wealth:6", """
SELECT strategy_id, CAST(rep AS INT) AS path_id, COUNT(*) AS n, exp(SUM(ret)) AS end_wealth FROM psample GROUP BY 1, 2""")
def bootstrap_paths(spark, d):
    return resampling.bootstrap_paths(base.strategy_series(spark, d), n_paths=PATHS).groupBy("strategy_id", "path_id").agg(F.count(F.lit(1)).alias("n"), F.exp(F.sum("ret")).alias("end_wealth"))


@query("b07_fan_chart", "strategy_id pos p05:6 p25:6 median:6 p75:6 p95:6", """
WITH w AS (SELECT strategy_id, pos, exp(SUM(ret) OVER (PARTITION BY strategy_id, rep ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS x FROM psample)
SELECT strategy_id, CAST(pos AS INT) AS pos, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.95) AS p95 FROM w GROUP BY 1, 2""")
def fan_chart(spark, d):
    return resampling.fan_chart(resampling.bootstrap_paths(base.strategy_series(spark, d), n_paths=PATHS))


_ALPHA = """
WITH b AS (SELECT benchmark, date, row_number() OVER (PARTITION BY benchmark ORDER BY date) - 1 AS i, ret AS bench FROM bench),
pt AS (SELECT s.strategy_id, b.benchmark, covar_samp(s.ret, b.bench) / (var_samp(b.bench) + 1e-12) AS beta, exp(AVG(s.ret) * 252) - 1 AS rp, exp(AVG(b.bench) * 252) - 1 AS rm,
  sqrt(252) * AVG(s.ret - b.bench) / (stddev_pop(s.ret - b.bench) + 1e-9) AS ir, stddev_pop(s.ret - b.bench) * sqrt(252) AS te FROM ser s JOIN b ON b.date = s.date GROUP BY 1, 2),
dr AS (SELECT r.strategy_id, b.benchmark, d.rep, covar_samp(r.ret, b.bench) / (var_samp(b.bench) + 1e-12) AS beta, exp(AVG(r.ret) * 252) - 1 AS rp, exp(AVG(b.bench) * 252) - 1 AS rm,
  sqrt(252) * AVG(r.ret - b.bench) / (stddev_pop(r.ret - b.bench) + 1e-9) AS ir, stddev_pop(r.ret - b.bench) * sqrt(252) AS te FROM bdraws d JOIN rowsn r ON r.i = d.src JOIN b ON b.i = d.src GROUP BY 1, 2, 3),
lp AS (SELECT strategy_id, benchmark, beta, UNNEST(['alpha_annualized', 'information_ratio', 'tracking_error']) AS metric, UNNEST([rp - (0.04 + beta * (rm - 0.04)), ir, te]) AS point FROM pt),
ld AS (SELECT strategy_id, benchmark, UNNEST(['alpha_annualized', 'information_ratio', 'tracking_error']) AS metric, UNNEST([rp - (0.04 + beta * (rm - 0.04)), ir, te]) AS value FROM dr)
SELECT ld.strategy_id, ld.benchmark, ld.metric, MAX(point) AS point, quantile_cont(value, 0.025) AS ci_low, quantile_cont(value, 0.975) AS ci_high, stddev_samp(value) AS se,
  CASE WHEN ld.metric <> 'tracking_error' THEN AVG(CASE WHEN (point > 0 AND value <= 0) OR (point <= 0 AND value >= 0) THEN 1.0::DOUBLE ELSE 0 END) END AS p_value, MAX(beta) AS beta
FROM ld JOIN lp ON lp.strategy_id = ld.strategy_id AND lp.benchmark = ld.benchmark AND lp.metric = ld.metric GROUP BY 1, 2, 3"""


@query("b08_alpha_significance", "strategy_id benchmark metric point:5 ci_low:5 ci_high:5 se:5 p_value:5 beta:3", _ALPHA)
def alpha_significance(spark, d):
    return significance.alpha_significance(base.strategy_series(spark, d), base.benchmark_series(spark, d), n_reps=REPS)


@query("b08b_alpha_points", "strategy_id benchmark n beta:5 alpha_annualized:6 information_ratio:5 tracking_error:6", """
SELECT strategy_id, benchmark, n, beta, rp - (0.04 + beta * (rm - 0.04)) AS alpha_annualized, information_ratio, tracking_error FROM (
  SELECT s.strategy_id, b.benchmark, COUNT(*) AS n, covar_samp(s.ret, b.ret) / (var_samp(b.ret) + 1e-12) AS beta, exp(AVG(s.ret) * 252) - 1 AS rp, exp(AVG(b.ret) * 252) - 1 AS rm,
    sqrt(252) * AVG(s.ret - b.ret) / (stddev_pop(s.ret - b.ret) + 1e-9) AS information_ratio, stddev_pop(s.ret - b.ret) * sqrt(252) AS tracking_error
  FROM ser s JOIN bench b ON b.date = s.date GROUP BY 1, 2)""")
def alpha_points(spark, d):
    return significance.pair_points(significance.align(base.strategy_series(spark, d), base.benchmark_series(spark, d)))


def _ic(spark, d):
    return significance.signal_ic(base.feature_table(spark, d))


CTES["icser"] = relational._IC_SQL


@query("b09_signal_ic", "signal n_periods ic_mean:5 ic_t_stat:4", """
SELECT signal, COUNT(*) AS n_periods, AVG(ic) AS ic_mean, AVG(ic) / (stddev_samp(ic) + 1e-9) * sqrt(COUNT(*)) AS ic_t_stat FROM icser GROUP BY 1 HAVING COUNT(*) >= 4""")
def signal_ic(spark, d):
    return significance.ic_points(_ic(spark, d))


@query("b09b_ic_diagnostics", "signal n_periods ic_mean:5 ci_low:5 ci_high:5 p_value:5 significant")
def ic_diagnostics(spark, d):
    return significance.ic_diagnostics(_ic(spark, d), n_reps=REPS)


@query("b10_benchmark_curves", "benchmark date wealth:6", "SELECT benchmark, date, exp(SUM(ret) OVER (PARTITION BY benchmark ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM bench")
def benchmark_curves(spark, d):
    return risk.drawdowns(base.benchmark_series(spark, d), ["benchmark"])


@query("b11_hashed_uniforms", "key u:12", hashed("(SELECT l_orderkey * 10 + l_linenumber AS key, l_orderkey, l_linenumber FROM lineitem)", 7, {"u": 3}, "l_orderkey", "l_linenumber", "key"))
def hashed_uniforms(spark, d):
    from ..sources.warehouse import read
    li = read(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), S.hash_uniform(7, 3, F.col("l_orderkey"), F.col("l_linenumber")).alias("u"))
