"""Forecast, covariance and view queries (inventory group M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import EQUITY_MODEL_FEATURES
from ..operators import covariance, forecast, posterior, spectra, views
from ..session import stage, stage_once
from ..settings import DEFAULTS
from ..sources import warehouse
from . import base
from .core import query
from .ctes import CTES

CTES["labelled"] = """
SELECT *, ln(lead(price, 21) OVER w / (price + 1e-9)) AS label, lead(date, 21) OVER w AS label_date FROM feq WINDOW w AS (PARTITION BY ticker ORDER BY date)"""


@query("m01_elastic_net_forecast", "date ticker asset_class n_train penalty:8 l1_ratio:2 prediction:6 expected_return:5")
def elastic_net_forecast(spark, d):
    return forecasts(spark, d)


def forecasts(spark, d):
    return stage_once(spark, d, "forecasts", lambda: forecast.forecast_returns(base.feature_table(spark, d)))


@query("m01b_expanding_gram", "month n:0 sum_y:5 sum_mom_y:6 sum_pe_mom:4 sum_vol_vol:6", """
SELECT month, SUM(n) OVER w AS n, SUM(sy) OVER w AS sum_y, SUM(smy) OVER w AS sum_mom_y, SUM(spm) OVER w AS sum_pe_mom, SUM(svv) OVER w AS sum_vol_vol FROM (
  SELECT CAST(date_trunc('month', label_date) AS DATE) AS month, COUNT(*) AS n, SUM(label) AS sy, SUM(momentum_63 * label) AS smy, SUM(pe_ratio * momentum_63) AS spm, SUM(volatility_63 * volatility_63) AS svv
  FROM labelled WHERE label IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY month ROWS UNBOUNDED PRECEDING)""")
def expanding_gram(spark, d):
    """Training sums of every refit month from one pass over history."""
    rows = forecast.labelled_rows(base.feature_table(spark, d).where("asset_class = 'equity'"), EQUITY_MODEL_FEATURES, 21)
    run = forecast.expanding_grams(forecast.monthly_grams(rows, EQUITY_MODEL_FEATURES, forecast.ticker_folds(rows, 5)))
    k = len(EQUITY_MODEL_FEATURES) + 2
    mom, vol, pe, y = 1, 3, 4, k - 1
    return _entries(run, k, {"n": (0, 0), "sum_y": (0, y), "sum_mom_y": (mom, y), "sum_pe_mom": (mom, pe), "sum_vol_vol": (vol, vol)})


@query("m01c_elastic_net_optimality", "month n_train residual:5", """
SELECT month, n AS n_train, 0::DOUBLE AS residual FROM (SELECT month, (SUM(n) OVER (ORDER BY month))::BIGINT AS n FROM (SELECT CAST(date_trunc('month', label_date) AS DATE) AS month, COUNT(*) AS n FROM labelled WHERE label IS NOT NULL GROUP BY 1)) WHERE n >= 50""")
def elastic_net_optimality(spark, d):
    """The optimality conditions of every fitted equity model: none is missed."""
    own = base.feature_table(spark, d).where("asset_class = 'equity' AND price IS NOT NULL")
    rows = forecast.labelled_variants(own, EQUITY_MODEL_FEATURES, [21])
    run = stage(forecast.expanding_grams(forecast.monthly_grams(rows, EQUITY_MODEL_FEATURES, forecast.ticker_folds(own, 5))), "expanding")
    k = len(EQUITY_MODEL_FEATURES) + 2
    return forecast.optimality(run, forecast.fit_models(run, k, 5, [DEFAULTS["elasticnet_l1_ratios"]], DEFAULTS["forecast_min_train_rows"], DEFAULTS["elasticnet_max_iter"]), k)


def _entries(run, k, wanted):
    """Named Gram entries summed over folds, one row per month."""
    at = lambda i, j: F.sum(F.when(F.col("pos") == forecast.gram_position(k, i, j), F.col("g")))
    return run.groupBy("month").agg(*[at(i, j).alias(name) for name, (i, j) in wanted.items()])


_EACH = ", ".join(f"SUM(COALESCE({c}, 0)) AS s_{c}, SUM(COALESCE({c}, 0) * COALESCE({c}, 0)) AS q_{c}" for c in EQUITY_MODEL_FEATURES)
_SPREAD = " UNION ALL ".join(f"SELECT month, '{c}' AS feature, SUM(n) OVER w AS n, SUM(s_{c}) OVER w AS sx, SUM(q_{c}) OVER w AS sxx FROM g WINDOW w AS (ORDER BY month ROWS UNBOUNDED PRECEDING)" for c in EQUITY_MODEL_FEATURES)


@query("m02_training_standardise", "month feature mean:5 sd:4", f"""
WITH g AS (SELECT CAST(date_trunc('month', label_date) AS DATE) AS month, COUNT(*) AS n, {_EACH} FROM labelled WHERE label IS NOT NULL GROUP BY 1)
SELECT month, feature, sx / n AS mean, sqrt(GREATEST(sxx / n - pow(sx / n, 2), 0)) AS sd FROM ({_SPREAD})""")
def training_standardise(spark, d):
    """Mean and spread of every feature over the training rows of each refit month."""
    rows = forecast.labelled_rows(base.feature_table(spark, d).where("asset_class = 'equity'"), EQUITY_MODEL_FEATURES, 21)
    run = forecast.expanding_grams(forecast.monthly_grams(rows, EQUITY_MODEL_FEATURES, forecast.ticker_folds(rows, 5)))
    k = len(EQUITY_MODEL_FEATURES) + 2
    sums = _entries(run, k, {"n": (0, 0)} | {f"s_{c}": (0, i + 1) for i, c in enumerate(EQUITY_MODEL_FEATURES)} | {f"q_{c}": (i + 1, i + 1) for i, c in enumerate(EQUITY_MODEL_FEATURES)})
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s_{c}").alias("sx"), F.col(f"q_{c}").alias("sxx")) for c in EQUITY_MODEL_FEATURES])).alias("z")
    mean = F.col("sx") / F.col("n")
    return sums.select("month", "n", each).select("month", "n", "z.*").select("month", "feature", mean.alias("mean"), F.sqrt(F.greatest(F.col("sxx") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"))


@query("m03_training_gate", "month n_train", """
SELECT month, CAST(n AS BIGINT) AS n_train FROM (SELECT month, SUM(n) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS n FROM (
  SELECT CAST(date_trunc('month', label_date) AS DATE) AS month, COUNT(*) AS n FROM labelled WHERE label IS NOT NULL GROUP BY 1)) WHERE n >= 50""")
def training_gate(spark, d):
    rows = forecast.labelled_rows(base.feature_table(spark, d).where("asset_class = 'equity'"), ["momentum_63"], 21)
    run = forecast.expanding_grams(forecast.monthly_grams(rows, ["momentum_63"], forecast.ticker_folds(rows, 5)))
    counts = _entries(run, 3, {"n_train": (0, 0)})
    return counts.withColumn("n_train", F.round("n_train").cast("long")).where(F.col("n_train") >= DEFAULTS["forecast_min_train_rows"])


def _windows(length: int) -> str:
    return f"""x AS (SELECT m.date AS as_of, m.pos - r.pos AS age, r.ticker, r.ret, r.ret - AVG(r.ret) OVER (PARTITION BY m.date, r.ticker) AS z
    FROM (SELECT date, pos FROM bdays WHERE date IN (SELECT date FROM mends)) m JOIN rets r ON r.pos BETWEEN m.pos - {length - 1} AND m.pos)"""


_SHRINK = """t AS (SELECT as_of, age, SUM(z * z) AS q FROM x GROUP BY 1, 2), n AS (SELECT as_of, COUNT(*)::DOUBLE AS n, SUM(q * q) AS b FROM t GROUP BY 1),
p AS (SELECT as_of, COUNT(DISTINCT ticker)::DOUBLE AS p FROM x GROUP BY 1),
c AS (SELECT a.as_of, a.ticker AS i, b.ticker AS j, SUM(a.z * b.z) AS s FROM x a JOIN x b ON a.as_of = b.as_of AND a.age = b.age AND a.ticker <= b.ticker GROUP BY 1, 2, 3),
d AS (SELECT c.as_of, SUM(s * s * CASE WHEN i = j THEN 1 ELSE 2 END) AS s2, SUM(CASE WHEN i = j THEN s END) AS tr FROM c GROUP BY 1),
e AS (SELECT d.as_of, n, p, b, s2 / n / n AS dr, tr / n AS trace, tr / n / p AS mu FROM d JOIN n ON n.as_of = d.as_of JOIN p ON p.as_of = d.as_of),
k AS (SELECT *, CASE WHEN LEAST(be, de) = 0 THEN 0 ELSE LEAST(be, de) / de END AS shrink FROM (SELECT *, (b / n - dr) / (p * n) AS be, (dr - 2 * mu * trace + p * mu * mu) / p AS de FROM e))"""

_LW = f"""WITH {_windows(63)}, {_SHRINK}
SELECT c.as_of, i AS ticker_i, j AS ticker_j, CASE WHEN n < 10 THEN CASE WHEN i = j THEN mu * n / (n - 1) ELSE 0 END ELSE (1 - shrink) * s / n + CASE WHEN i = j THEN shrink * mu ELSE 0 END END AS cov FROM c JOIN k ON k.as_of = c.as_of"""


def rolling_cov(spark, d):
    return stage_once(spark, d, "rolling_cov", lambda: covariance.ledoit_wolf(base.returns_table(spark, d), base.month_ends(spark, d)))


def ewma_cov(spark, d):
    return stage_once(spark, d, "ewma_cov", lambda: covariance.ewma_ledoit_wolf(base.returns_table(spark, d), base.month_ends(spark, d)))


@query("m04_ledoit_wolf", "as_of ticker_i ticker_j cov:9", _LW)
def ledoit_wolf(spark, d):
    return covariance.ledoit_wolf(base.returns_table(spark, d), base.month_ends(spark, d))


@query("m05_ewma_ledoit_wolf", "as_of ticker_i ticker_j cov:9", f"""
WITH {_windows(252)}, {_SHRINK},
w AS (SELECT x.*, pow(0.94::DOUBLE, age) * CASE WHEN age = n - 1 THEN 1 ELSE 0.06::DOUBLE END AS w FROM x JOIN n ON n.as_of = x.as_of),
zz AS (SELECT *, ret - SUM(w * ret) OVER (PARTITION BY as_of, ticker) AS zw FROM w),
b2 AS (SELECT as_of, SUM(w * w) AS w2 FROM (SELECT DISTINCT as_of, age, w FROM w) GROUP BY 1),
r AS (SELECT a.as_of, a.ticker AS i, b.ticker AS j, SUM(a.w * a.zw * b.zw) / (1 - MAX(w2)) AS c FROM zz a JOIN zz b ON a.as_of = b.as_of AND a.age = b.age AND a.ticker <= b.ticker JOIN b2 ON b2.as_of = a.as_of GROUP BY 1, 2, 3),
tr AS (SELECT as_of, SUM(CASE WHEN i = j THEN c END) AS tr FROM r GROUP BY 1)
SELECT r.as_of, i AS ticker_i, j AS ticker_j, (1 - shrink) * c + CASE WHEN i = j THEN shrink * tr.tr / p ELSE 0 END AS cov FROM r JOIN tr ON tr.as_of = r.as_of JOIN k ON k.as_of = r.as_of WHERE n >= 60""")
def ewma_ledoit_wolf(spark, d):
    return covariance.ewma_ledoit_wolf(base.returns_table(spark, d), base.month_ends(spark, d))


def spectrum(spark, d, decay=None):
    window, rows = (63, 1) if decay is None else (252, 60)
    return stage_once(spark, d, f"spectra_{window}", lambda: spectra.spectra(spectra.window_grams(base.returns_table(spark, d), base.month_ends(spark, d), window, decay), decay, rows))


@query("m06_covariance_choice", "as_of method_used fallback_to_rolling condition_ratio:3 det_ratio:6")
def covariance_choice(spark, d):
    return spectra.covariance_choice(spectrum(spark, d), spectrum(spark, d, 0.94))


@query("m06b_spectral_sums", "as_of n_names trace:8 squares:11 ordered", f"""
SELECT as_of, COUNT(DISTINCT ticker_i) AS n_names, SUM(CASE WHEN ticker_i = ticker_j THEN cov END) AS trace, SUM(cov * cov * CASE WHEN ticker_i = ticker_j THEN 1 ELSE 2 END) AS squares, TRUE AS ordered FROM ({_LW}) GROUP BY as_of""")
def spectral_sums(spark, d):
    """Eigenvalues against the covariance itself: their sum is its trace, the sum of their squares that of its entries."""
    return spectrum(spark, d).withColumn("ordered", (F.col("least") >= -1e-9) & (F.col("largest") <= F.col("trace") + 1e-12) & (F.col("least") * F.col("n_names") <= F.col("trace") + 1e-12))


@query("m07_correlation", "as_of ticker_i ticker_j corr:6", f"""
WITH q AS ({_LW}) SELECT q.as_of, q.ticker_i, q.ticker_j, LEAST(GREATEST(q.cov / (sqrt(a.cov) * sqrt(b.cov) + 1e-12), -1), 1) AS corr FROM q
JOIN q a ON a.as_of = q.as_of AND a.ticker_i = q.ticker_i AND a.ticker_j = q.ticker_i JOIN q b ON b.as_of = q.as_of AND b.ticker_i = q.ticker_j AND b.ticker_j = q.ticker_j""")
def correlation(spark, d):
    return covariance.correlation(rolling_cov(spark, d))


CTES["fviews"] = """
SELECT date, ticker, view, CASE WHEN hi - lo > 1e-9 THEN 0.30 + 0.40 * (ABS(view) - lo) / (hi - lo) ELSE 0.50 END AS confidence FROM (
  SELECT *, MIN(ABS(view)) OVER (PARTITION BY date) AS lo, MAX(ABS(view)) OVER (PARTITION BY date) AS hi FROM (SELECT date, ticker, AVG(momentum_63) AS view FROM cand WHERE momentum_63 IS NOT NULL GROUP BY date, ticker))"""


def _forecast_views(spark, d):
    """Views of each rebalance date from that date's signal alone."""
    return views.forecast_views(base.candidates(spark, d).withColumnRenamed("momentum_63", "expected_return").where("expected_return IS NOT NULL"), ["date"])


@query("m08_forecast_views", "date ticker view:7 confidence:6", "SELECT * FROM fviews")
def forecast_views(spark, d):
    return _forecast_views(spark, d)


_ZH = "CASE WHEN {c} IS NOT NULL AND COUNT({c}) OVER w >= 23 AND stddev_samp({c}) OVER w > 1e-12 THEN ({c} - AVG({c}) OVER w) / stddev_samp({c}) OVER w ELSE 0 END AS {c}"
_NAMES = ["industrial_production_yoy", "exports_yoy", "us_ip_yoy", "inflation_yoy", "banxico_rate_delta", "usd_mxn_mom"]
CTES["mviews"] = f"""
WITH a AS (SELECT *, banxico_rate - lag(banxico_rate, 21) OVER (ORDER BY date) AS banxico_rate_delta, usd_mxn / lag(usd_mxn, 21) OVER (ORDER BY date) - 1 AS usd_mxn_mom FROM mac),
z AS (SELECT date, {', '.join(_ZH.format(c=c) for c in _NAMES)} FROM a WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT date, signal, 0.015 * tanh(z) AS mag FROM (UNPIVOT z ON {', '.join(_NAMES)} INTO NAME signal VALUE z)),
rl AS (SELECT * FROM (VALUES ('industrial_production_yoy', 'Industrial', 1.0), ('industrial_production_yoy', 'Logistics', 0.5), ('industrial_production_yoy', 'Infrastructure', 0.5),
  ('exports_yoy', 'Industrial', 1.0), ('exports_yoy', 'Logistics', 0.7), ('us_ip_yoy', 'Industrial', 0.8), ('us_ip_yoy', 'Logistics', 0.6),
  ('banxico_rate_delta', 'FIBRA', -1.0), ('banxico_rate_delta', 'Infrastructure', -0.4), ('inflation_yoy', 'FIBRA', -0.4)) v(signal, sector, sgn)),
s AS (SELECT date, sector, SUM(sgn::DOUBLE * mag) AS v FROM rl JOIN l ON l.signal = rl.signal GROUP BY date, sector),
b AS (SELECT s.date, u.ticker, s.v FROM univ u JOIN s ON s.sector = u.sector WHERE ABS(s.v) > 1e-9
  UNION ALL SELECT l.date, u.ticker, (usd_exposure - 0.4) / 0.6 * l.mag FROM univ u, l WHERE l.signal = 'usd_mxn_mom' AND usd_exposure > 0.4),
k AS (SELECT r.date, MAX(m.date) AS at FROM mends r JOIN mac m ON m.date <= r.date GROUP BY r.date)
SELECT k.date, ticker, GREATEST(LEAST(SUM(v), 0.015::DOUBLE), -0.015::DOUBLE) AS view, 0.2::DOUBLE AS confidence FROM k JOIN b ON b.date = k.at GROUP BY k.date, ticker"""


@query("m09_macro_views", "date ticker view:8 confidence:4", "SELECT * FROM mviews")
def macro_views(spark, d):
    """The macro views known at each rebalance date."""
    macro = warehouse.macro(spark, d)
    dated = views.macro_views(macro, warehouse.universe(spark, d), latest_only=False)
    return views.views_in_force(dated, macro, base.month_ends(spark, d))


def _sources(spark, d):
    return {"forecast": _forecast_views(spark, d).select("date", "ticker", "view", "confidence"),
            "macro": macro_views(spark, d).select("date", "ticker", "view", "confidence")}


def combined(spark, d):
    rows = None
    for name, df in _sources(spark, d).items():
        part = df.withColumn("source", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return views.combine_views(rows, ["date"])


@query("m10_combined_views", "date ticker view:7 confidence:6", """
SELECT date, ticker, SUM(view * confidence) / SUM(confidence) AS view, MAX(confidence) AS confidence FROM (SELECT date, ticker, view, confidence FROM fviews UNION ALL SELECT date, ticker, view, confidence FROM mviews) GROUP BY date, ticker HAVING SUM(confidence) > 1e-12""")
def combined_views(spark, d):
    return combined(spark, d)


@query("m11_views_breakdown", "date source target view_pct:7 confidence:6",
       "SELECT date, 'forecast' AS source, ticker AS target, view AS view_pct, confidence FROM fviews UNION ALL SELECT date, 'macro', ticker, view, confidence FROM mviews")
def views_breakdown(spark, d):
    return views.views_breakdown(_sources(spark, d))


CTES["bl_post"] = f"""
WITH RECURSIVE q AS ({_LW}), f AS (SELECT as_of, ticker_i AS i, ticker_j AS j, cov FROM q UNION ALL SELECT as_of, ticker_j, ticker_i, cov FROM q WHERE ticker_i <> ticker_j),
pr AS (SELECT as_of, i AS ticker, 2.5::DOUBLE * SUM(cov * market_cap / ((SELECT SUM(market_cap) FROM univ) + 1e-9::DOUBLE)) AS prior FROM f JOIN univ u ON u.ticker = f.j GROUP BY 1, 2),
vw AS (SELECT date, ticker, SUM(view * confidence) / SUM(confidence) AS view, MAX(confidence) AS confidence FROM (SELECT date, ticker, view, confidence FROM fviews UNION ALL SELECT date, ticker, view, confidence FROM mviews) GROUP BY date, ticker HAVING SUM(confidence) > 1e-12),
mat AS (SELECT as_of, list(r ORDER BY i) AS c FROM (SELECT as_of, i, list(0.05::DOUBLE * cov ORDER BY j) AS r FROM f GROUP BY as_of, i) GROUP BY as_of),
vec AS (SELECT pr.as_of, list(pr.ticker ORDER BY pr.ticker) AS t, list(prior ORDER BY pr.ticker) AS p, list(view ORDER BY pr.ticker) AS v, list(0.05::DOUBLE / GREATEST(confidence, 1e-6::DOUBLE) + 1e-6::DOUBLE ORDER BY pr.ticker) AS o
  FROM pr LEFT JOIN vw ON vw.date = pr.as_of AND vw.ticker = pr.ticker GROUP BY pr.as_of),
ch AS (SELECT mat.as_of, 0 AS k, c, p AS m FROM mat JOIN vec ON vec.as_of = mat.as_of
  UNION ALL
  SELECT ch.as_of, k + 1, CASE WHEN v[k + 1] IS NULL THEN c ELSE [[c[i][j] - c[i][k + 1] * c[j][k + 1] / (c[k + 1][k + 1] + o[k + 1]) FOR j IN range(1, len(c) + 1)] FOR i IN range(1, len(c) + 1)] END,
    CASE WHEN v[k + 1] IS NULL THEN m ELSE [m[i] + c[i][k + 1] * (v[k + 1] - m[k + 1]) / (c[k + 1][k + 1] + o[k + 1]) FOR i IN range(1, len(c) + 1)] END
  FROM ch JOIN vec ON vec.as_of = ch.as_of WHERE k < len(c))
SELECT ch.as_of, unnest(t) AS ticker, unnest(p) AS prior, unnest(m) AS posterior FROM ch JOIN vec ON vec.as_of = ch.as_of WHERE k = len(c)"""


def blended(spark, d):
    """Posterior of every name at every month end, from the views of that date."""
    return stage_once(spark, d, "posterior", lambda: posterior.black_litterman(
        base.returns_table(spark, d), base.month_ends(spark, d), views.market_weights(warehouse.universe(spark, d)), combined(spark, d).withColumnRenamed("date", "as_of")))


@query("m12_black_litterman", "as_of ticker prior:8 posterior:8", "SELECT * FROM bl_post")
def black_litterman(spark, d):
    return blended(spark, d)


CTES["adjret"] = """
SELECT p.as_of, p.ticker, posterior + COALESCE(u.usd_exposure, 0) * 0.5::DOUBLE * COALESCE((SELECT AVG(c) FROM (SELECT date, ln(usd_mxn / lag(usd_mxn) OVER (ORDER BY date)) AS c FROM mac) x WHERE x.date <= k.at), 0) AS expected_return
FROM bl_post p LEFT JOIN univ u ON u.ticker = p.ticker LEFT JOIN (SELECT r.date, MAX(m.date) AS at FROM mends r JOIN mac m ON m.date <= r.date GROUP BY r.date) k ON k.date = p.as_of"""


def adjusted_returns(spark, d):
    """What allocation reads: posterior plus the currency term."""
    return stage_once(spark, d, "adjusted", lambda: posterior.adjusted(
        blended(spark, d), warehouse.universe(spark, d), posterior.currency_return(warehouse.macro(spark, d), base.month_ends(spark, d))))


@query("m14b_adjusted_returns", "as_of ticker expected_return:8", "SELECT * FROM adjret")
def adjusted_expected_returns(spark, d):
    return adjusted_returns(spark, d)


@query("m12b_equilibrium_prior", "as_of ticker prior:8", f"""
WITH q AS ({_LW}), f AS (SELECT as_of, ticker_i AS i, ticker_j AS j, cov FROM q UNION ALL SELECT as_of, ticker_j, ticker_i, cov FROM q WHERE ticker_i <> ticker_j)
SELECT as_of, i AS ticker, 2.5 * SUM(cov * market_cap / ((SELECT SUM(market_cap) FROM univ) + 1e-9)) AS prior FROM f JOIN univ u ON u.ticker = f.j GROUP BY 1, 2""")
def equilibrium_prior(spark, d):
    return black_litterman(spark, d)


@query("m13_market_weights", "ticker market_weight:7", "SELECT ticker, market_cap / ((SELECT SUM(market_cap) FROM univ) + 1e-9) AS market_weight FROM univ")
def market_weights(spark, d):
    return views.market_weights(warehouse.universe(spark, d))


@query("m14_currency_adjustment", "date ticker expected_return:7", "SELECT c.date, c.ticker, momentum_63 + u.usd_exposure * 0.5 * 0.04 AS expected_return FROM cand c JOIN univ u ON u.ticker = c.ticker")
def currency_adjustment(spark, d):
    c = base.candidates(spark, d).select("date", "ticker", F.col("momentum_63").alias("expected_return"))
    return views.currency_adjusted(c, warehouse.universe(spark, d), 0.04)
