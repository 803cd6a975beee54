"""Parameter search and overfitting queries (inventory group X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import EULER_MASCHERONI
from ..functions import scalars as S
from ..operators import backtest, overfitting, search
from ..session import stage, stage_once
from ..settings import DEFAULTS
from ..sources import warehouse
from . import base
from .core import query
from .ctes import CTES, hashed

CTES["folds"] = """
WITH s AS (SELECT COUNT(*) AS n FROM bdays), i AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM bdays),
f AS (SELECT k, 252 + k * GREATEST(floor((n - 273) / 3.0), 30)::BIGINT AS te, GREATEST(floor((n - 273) / 3.0), 30)::BIGINT AS blk, n FROM s, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 303),
g AS (SELECT k, te - 1 AS e, te + 21 AS a, LEAST(te + 21 + blk, n - 1) AS z FROM f)
SELECT k AS fold_idx, (SELECT MIN(date) FROM bdays) AS train_start, b.date AS train_end, c.date AS test_start, d.date AS test_end
FROM g JOIN i b ON b.i = g.e JOIN i c ON c.i = g.a JOIN i d ON d.i = g.z WHERE z > a"""


def folds(spark, d):
    return search.walk_forward_folds(warehouse.price_panel(spark, d))


@query("x01_walk_forward_folds", "fold_idx train_start train_end test_start test_end", "SELECT * FROM folds")
def walk_forward_folds(spark, d):
    return folds(spark, d)


N_TRIALS = 50


@query("x02_sampled_trials", "trial_id bl_tau:8 mv_risk_aversion:6 regime_ewma_span:0", f"""
SELECT trial_id, exp(ln(0.01) + u1 * (ln(0.15) - ln(0.01))) AS bl_tau, exp(ln(1.0) + u2 * (ln(10.0) - ln(1.0))) AS mv_risk_aversion, LEAST(3 + floor(u8 * 10), 12) AS regime_ewma_span
FROM ({hashed(f"(SELECT DISTINCT user_id % {N_TRIALS} AS trial_id FROM events)", 42, {"u1": 101, "u2": 102, "u8": 108}, "trial_id", "0")})""")
def sampled_trials(spark, d):
    """Draws for the trial ids that occur in the event stream."""
    seen = warehouse.read(spark, d, "events").select((F.col("user_id") % N_TRIALS).alias("trial_id")).distinct()
    t = search.sample_trials(spark, N_TRIALS).join(seen, "trial_id", "left_semi")
    get = lambda k: F.element_at("params", k).alias(k)
    return t.select("trial_id", get("bl_tau"), get("mv_risk_aversion"), get("regime_ewma_span"))


def trial_series(spark, d):
    def build():
        members = warehouse.universe(spark, d)
        books = stage(search.trial_weights(search.sample_trials(spark, N_TRIALS), base.feature_table(spark, d), warehouse.price_panel(spark, d), base.returns_table(spark, d), warehouse.macro(spark, d), members, DEFAULTS), "trial-books")
        return backtest.strategy_returns(books, base.returns_table(spark, d))
    return stage_once(spark, d, "trial_series", build)


def trial_metrics(spark, d):
    return search.fold_metrics(trial_series(spark, d), folds(spark, d))


@query("x03_trial_fold_metrics", "strategy_id fold_idx n_obs sharpe:5 sortino:5 max_drawdown:6 cvar_95:7 turnover:6")
def trial_fold_metrics(spark, d):
    return trial_metrics(spark, d)


@query("x03b_rule_fold_metrics", "strategy_id fold_idx n_obs sharpe:5 max_drawdown:6 cvar_95:7 turnover:6", """
WITH s AS (SELECT strategy_id, fold_idx, s.date, ret, turnover FROM ser s JOIN folds f ON s.date BETWEEN f.test_start AND f.test_end),
w AS (SELECT *, exp(SUM(ret) OVER (PARTITION BY strategy_id, fold_idx ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM s),
p AS (SELECT *, wealth / MAX(wealth) OVER (PARTITION BY strategy_id, fold_idx ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM w),
v AS (SELECT strategy_id, fold_idx, quantile_cont(ret, 0.05) AS q FROM s GROUP BY 1, 2)
SELECT p.strategy_id, p.fold_idx, COUNT(*) AS n_obs, sqrt(252) * (AVG(ret) - 0.02::DOUBLE / 252) / (stddev_pop(ret) + 1e-9) AS sharpe, MIN(dd) AS max_drawdown, AVG(ret) FILTER (WHERE ret <= q + 1e-12) AS cvar_95, AVG(turnover) AS turnover
FROM p JOIN v ON v.strategy_id = p.strategy_id AND v.fold_idx = p.fold_idx GROUP BY 1, 2""")
def rule_fold_metrics(spark, d):
    return search.fold_metrics(base.strategy_series(spark, d), folds(spark, d))


@query("x04_objective", "strategy_id value:5 sharpe_mean:5 turnover_mean:6")
def objective(spark, d):
    return search.objective(trial_metrics(spark, d))


@query("x05_best_trial", "strategy_id value:5 sharpe_mean:5 sortino_mean:5 drawdown_mean:6 turnover_mean:6")
def best_trial(spark, d):
    return search.best_trial(search.objective(trial_metrics(spark, d)))


@query("x06_parameter_importance", "param importance:5")
def parameter_importance(spark, d):
    history = search.objective(trial_metrics(spark, d))
    return search.parameter_importance(search.sample_trials(spark, N_TRIALS), history)


@query("x06b_bin_variance_share", "share:6", """
WITH v AS (SELECT user_id % 20 AS trial_id, AVG(value) AS value FROM events GROUP BY 1), b AS (SELECT *, ntile(4) OVER (ORDER BY trial_id) AS bin FROM v),
m AS (SELECT bin, AVG(value) AS m, COUNT(*) AS n FROM b GROUP BY 1)
SELECT (SELECT SUM(n * m * m) - pow(SUM(n * m), 2) / SUM(n) FROM m) / (SELECT SUM(value * value) - pow(SUM(value), 2) / COUNT(*) FROM b) AS share""")
def bin_variance_share(spark, d):
    values = warehouse.read(spark, d, "events").groupBy((F.col("user_id") % 20).alias("trial_id")).agg(F.avg("value").alias("value"))
    trials = values.select("trial_id", F.create_map(F.lit("x"), F.col("trial_id").cast("double")).alias("params"))
    history = values.select(F.col("trial_id").cast("string").alias("strategy_id"), "value")
    return search.parameter_importance(trials, history).select(F.col("raw").alias("share"))




def _poly(x: str, coefficients) -> str:
    out = f"{float(coefficients[0])!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {float(c)!r}::DOUBLE)"
    return out


def _ppf(p: str) -> str:
    """Normal quantile of column ``p`` (the published rational approximation)."""
    q, mid = f"({p} - 0.5)", f"(0.180625::DOUBLE - ({p} - 0.5) * ({p} - 0.5))"
    r = f"sqrt(-ln(LEAST({p}, 1 - {p})))"
    near = f"{_poly(f'({r} - 1.6)', S.PPF_NEAR_NUM)} / {_poly(f'({r} - 1.6)', S.PPF_NEAR_DEN)}"
    return f"CASE WHEN ABS({q}) <= 0.425 THEN {q} * {_poly(mid, S.PPF_MID_NUM)} / {_poly(mid, S.PPF_MID_DEN)} ELSE sign({q}) * {near} END"


def _cdf(x: str) -> str:
    upper = f"exp(-{x} * {x} / 2) * {_poly(f'ABS({x})', S.CDF_NUM)} / {_poly(f'ABS({x})', S.CDF_DEN)}"
    return f"CASE WHEN {x} > 0 THEN 1 - {upper} ELSE {upper} END"


_EMAX = f"CASE WHEN n_trials <= 1 THEN 0 ELSE {1.0 - EULER_MASCHERONI!r}::DOUBLE * ({_ppf('p1')}) + {EULER_MASCHERONI!r}::DOUBLE * ({_ppf('p2')}) END"


@query("x07_expected_max_sharpe", "n_trials emax:9", f"""
SELECT n_trials, {_EMAX} AS emax FROM (SELECT n_trials, 1 - 1.0::DOUBLE / n_trials AS p1, 1 - 0.36787944117144233::DOUBLE / n_trials AS p2 FROM (
  SELECT DISTINCT n_trials FROM (SELECT CAST(ts AS DATE) AS d, COUNT(DISTINCT user_id % 20) AS n_trials FROM events GROUP BY 1)))""")
def expected_max_sharpe(spark, d):
    """Expected best of N for every trial count found in the event stream."""
    counts = base.trial_days(spark, d).groupBy("row_date").agg(F.count_distinct("trial_id").alias("n_trials")).select("n_trials").distinct()
    return counts.withColumn("emax", overfitting.expected_max_sharpe(F.col("n_trials").cast("double")))


def dsr(spark, d):
    return overfitting.deflated_sharpe(base.strategy_series(spark, d), N_TRIALS)


CTES["dsr"] = f"""
WITH z AS (SELECT *, AVG(ret) OVER (PARTITION BY strategy_id) AS m, stddev_samp(ret) OVER (PARTITION BY strategy_id) AS sd FROM ser),
a AS (SELECT strategy_id, COUNT(*) AS n_obs, MAX(m) / MAX(sd) AS sr, AVG(pow((ret - m) / sd, 3)) AS skew, AVG(pow((ret - m) / sd, 4)) AS kurtosis FROM z GROUP BY 1),
e AS (SELECT {_EMAX} AS emax FROM (SELECT {N_TRIALS} AS n_trials, 1 - 1.0::DOUBLE / {N_TRIALS} AS p1, 1 - 0.36787944117144233::DOUBLE / {N_TRIALS} AS p2)),
t AS (SELECT a.*, sqrt(1.0::DOUBLE / (n_obs - 1)) * emax AS sr0, (1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) / (n_obs - 1) AS v FROM a, e),
u AS (SELECT *, (sr - sr0) / sqrt(v) AS x FROM t)
SELECT strategy_id, n_obs, sr AS sharpe_observed, sr * sqrt(252) AS sharpe_annualized, sr0 AS expected_max_sharpe, {_cdf('x')} AS dsr_p_value, skew, kurtosis FROM u"""


@query("x08_deflated_sharpe", "strategy_id n_obs sharpe_observed:6 sharpe_annualized:5 expected_max_sharpe:6 dsr_p_value:6 skew:4 kurtosis:3", "SELECT * FROM dsr")
def deflated_sharpe(spark, d):
    return dsr(spark, d)


CTES["cm"] = """
WITH m AS (SELECT CAST(ts AS DATE) AS row_id, user_id % 20 AS trial_id, AVG(value) AS metric FROM events GROUP BY 1, 2),
l AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT row_id FROM m)),
e AS (SELECT k, floor(k * (SELECT MAX(n) FROM l) / 14.0) AS a, floor((k + 1) * (SELECT MAX(n) FROM l) / 14.0) AS b FROM (SELECT unnest(generate_series(0, 13)) AS k))
SELECT trial_id, k AS chunk, AVG(metric) AS metric FROM m JOIN l ON l.row_id = m.row_id JOIN e ON l.i >= e.a AND l.i < e.b GROUP BY 1, 2"""


@query("x09_overfitting_probability", "pbo:6 median_logit:6 n_splits n_trials", """
WITH t AS (SELECT trial_id FROM cm GROUP BY 1 HAVING COUNT(*) = 14), s AS (SELECT unnest(generate_series(0, 16383)) AS s), h AS (SELECT s FROM s WHERE bit_count(s::INT) = 7),
p AS (SELECT s, c.trial_id, SUM(CASE WHEN (s >> chunk::INT) & 1 = 1 THEN metric ELSE 0 END) / 7 AS isp, SUM(CASE WHEN (s >> chunk::INT) & 1 = 0 THEN metric ELSE 0 END) / 7 AS oos FROM cm c JOIN t ON t.trial_id = c.trial_id CROSS JOIN h GROUP BY 1, 2),
b AS (SELECT s, arg_max(oos, isp) AS best FROM p GROUP BY 1),
r AS (SELECT p.s, COUNT(*) AS n, COUNT(*) FILTER (WHERE oos < best) + (COUNT(*) FILTER (WHERE oos = best) + 1) / 2.0::DOUBLE AS rk FROM p JOIN b ON b.s = p.s GROUP BY 1),
g AS (SELECT ln((rk / (n + 1)) / (1 - rk / (n + 1))) AS lam, n FROM r)
SELECT AVG(CASE WHEN lam < 0 THEN 1.0::DOUBLE ELSE 0 END) AS pbo, median(lam) AS median_logit, COUNT(*) AS n_splits, MAX(n) AS n_trials FROM g""")
def overfitting_probability(spark, d):
    m = base.trial_days(spark, d).withColumnRenamed("row_date", "row_id")
    return overfitting.overfitting_probability(m)


@query("x10_verdicts", "strategy_id dsr_verdict pbo_verdict")
def verdicts(spark, d):
    pbo = overfitting_probability(spark, d).select("pbo").scalar()
    a, b = overfitting.verdicts(F.col("dsr_p_value"), F.col("pbo"))
    return dsr(spark, d).withColumn("pbo", pbo).select("strategy_id", a.alias("dsr_verdict"), b.alias("pbo_verdict"))


@query("x11_metric_udf", "strategy_id metric point:6 value_mean:6")
def metric_udf(spark, d):
    """User metric callables: a one-series and a two-series function run beside the built-ins."""
    import numpy as np

    from ..operators import resampling, significance
    spread = lambda x: np.quantile(x, 0.75, axis=1) - np.quantile(x, 0.25, axis=1)
    s = base.strategy_series(spark, d)
    one = resampling.bootstrap_metrics(s, metrics=(), custom={"iqr": spread})
    pairs = significance.align(s, base.benchmark_series(spark, d).where("benchmark = 'ALL'"))
    two = resampling.bootstrap_pairs(pairs, ["strategy_id"], metrics=(), custom={"active_iqr": lambda f, b: spread(f - b)})
    both = one.unionByName(two)
    return both.groupBy("strategy_id", "metric").agg(F.max(F.when(F.col("rep") == 0, F.col("value"))).alias("point"), F.avg("value").alias("value_mean"))
