"""Allocation queries (inventory group O1-O14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation, backtest, optimise, regimes
from ..session import stage_once
from ..settings import DEFAULTS
from ..sources import warehouse
from . import base
from .core import query
from . import risks  # noqa: F401  (shared regime SQL)
from .estimation import adjusted_returns, forecasts

BOUNDS = [("equity", 0.45, 0.81), ("fibra", 0.045, 0.27)]
_BOUNDS_SQL = "(VALUES ('equity', 0.45::DOUBLE, 0.81::DOUBLE), ('fibra', 0.045::DOUBLE, 0.27::DOUBLE)) b(asset_class, min_weight, max_weight)"


def bounds(spark):
    return spark.createDataFrame(BOUNDS, "asset_class string, min_weight double, max_weight double")


def names(spark, d):
    """Forecast and volatility of the names on each rebalance date."""
    vol = base.feature_table(spark, d).select("date", "ticker", F.col("volatility_63").alias("vol"))
    return forecasts(spark, d).join(vol, ["date", "ticker"]).select(F.col("date").alias("as_of"), "ticker", "expected_return", "vol")


def books(spark, d, target=0.9):
    return stage_once(spark, d, "candidate_books", lambda: allocation.feasible_only(
        allocation.candidate_books(names(spark, d), warehouse.universe(spark, d), bounds(spark), target), warehouse.universe(spark, d), bounds(spark), target))


def terms(spark, d):
    return stage_once(spark, d, "objective_terms", lambda: allocation.objective_terms(
        books(spark, d), names(spark, d), base.returns_table(spark, d), warehouse.universe(spark, d)))


@query("o01_objective", "as_of cand ret_term:6 var_term:6 turn_term:6 impact_term:6 objective:6")
def objective(spark, d):
    return allocation.score(terms(spark, d))


@query("o01b_objective_linear", "strategy_id date ret_term:6 w2:6", """
SELECT w.strategy_id, w.date, SUM(-weight * momentum_63) AS ret_term, SUM(weight * weight) AS w2 FROM wts w JOIN cand c ON c.date = w.date AND c.ticker = w.ticker GROUP BY 1, 2""")
def objective_linear(spark, d):
    w = base.rule_weights(spark, d).join(base.candidates(spark, d).select("date", "ticker", "momentum_63"), ["date", "ticker"])
    return w.groupBy("strategy_id", "date").agg(F.sum(-F.col("weight") * F.col("momentum_63")).alias("ret_term"), F.sum(F.col("weight") * F.col("weight")).alias("w2"))


def settings(kind):
    return optimise.strategies(DEFAULTS)[kind]


def dated_bounds(spark, d):
    """Class bounds at each rebalance date, by the regime then known."""
    return regimes.bounds_in_force(regimes.composite_regimes(warehouse.macro(spark, d)), base.month_ends(spark, d), bounds(spark), min_confidence=1.2)


def solved(spark, d, kind, signal="forecast", anchor=None):
    """(problems, books) of a kind: from forecasts, from momentum, which SQL can follow, or the whole run: adjusted returns under the bounds of each date's regime."""
    def problem():
        if signal == "run":
            who = adjusted_returns(spark, d).join(base.candidates(spark, d).select(F.col("date").alias("as_of"), "ticker"), ["as_of", "ticker"], "left_semi")
            return optimise.problems(who, warehouse.universe(spark, d), dated_bounds(spark, d), base.returns_table(spark, d), optimise.WINDOWS[kind])
        who = names(spark, d) if signal == "forecast" else base.candidates(spark, d).where("momentum_63 IS NOT NULL").select(F.col("date").alias("as_of"), "ticker", F.col("momentum_63").alias("expected_return"))
        bands = None if anchor is None else allocation.sector_bands(_targets(spark, d), warehouse.universe(spark, d), anchor)
        return optimise.problems(who, warehouse.universe(spark, d), bounds(spark), base.returns_table(spark, d), optimise.WINDOWS[kind], bands)

    label = f"{optimise.WINDOWS[kind]}_{signal}_{anchor}"
    packed = stage_once(spark, d, f"problems_{label}", problem)
    return packed, stage_once(spark, d, f"books_{kind}_{label}", lambda: optimise.books(packed, {kind: settings(kind)}))


@query("o02_mean_variance", "strategy_id date ticker weight:6")
def mean_variance(spark, d):
    return optimise.weights(solved(spark, d, "mv")[1])


@query("o03_mean_cvar", "strategy_id date ticker weight:6")
def mean_cvar(spark, d):
    return optimise.weights(solved(spark, d, "cvar")[1])


@query("o04_resampled", "strategy_id date ticker weight:6")
def resampled(spark, d):
    return optimise.weights(solved(spark, d, "robust")[1])


_OPTIMAL = """SELECT '{k}' AS strategy_id, date, COUNT(*) AS n_names, {t}::DOUBLE AS total, 0::DOUBLE AS violation, 0::DOUBLE AS gap FROM cand WHERE momentum_63 IS NOT NULL GROUP BY date"""


@query("o02b_optimality", "strategy_id date n_names total:6 violation:6 gap:5", _OPTIMAL.format(k="mv", t=0.9))
def optimality(spark, d):
    """How far each mean-variance book may be from the optimum, from its multipliers: nothing, on any date."""
    packed, found = solved(spark, d, "mv", "momentum")
    return optimise.certificate(found, packed, settings("mv"))


@query("o03b_optimality", "strategy_id date n_names total:6 violation:6 gap:4", _OPTIMAL.format(k="cvar", t=0.75))
def tail_optimality(spark, d):
    packed, found = solved(spark, d, "cvar", "momentum")
    return optimise.certificate(found, packed, settings("cvar"))


@query("o02c_run_optimality", "strategy_id date n_names total:6 violation:6 gap:5", "SELECT 'mv' AS strategy_id, date, COUNT(*) AS n_names, 0.9::DOUBLE AS total, 0::DOUBLE AS violation, 0::DOUBLE AS gap FROM cand GROUP BY date")
def run_optimality(spark, d):
    """The main run's books: posterior and currency term as forecasts, regime bounds per date, costs against the held book; none is off its optimum."""
    packed, found = solved(spark, d, "mv", "run")
    return optimise.certificate(found, packed, settings("mv"))


_ANCHORED = """SELECT CASE WHEN sector = 'FIBRA' THEN 'FIBRA' ELSE 'Industrial' END AS anchor, SUM(market_cap) / (SELECT SUM(market_cap) FROM univ) AS target FROM univ GROUP BY 1"""


@query("o08b_bands_bind", "date anchor target:6 within optimal", f"""
SELECT DISTINCT date, anchor, target, TRUE AS within, TRUE AS optimal FROM cand c JOIN univ u ON u.ticker = c.ticker JOIN ({_ANCHORED}) a ON a.anchor = CASE WHEN u.sector = 'FIBRA' THEN 'FIBRA' ELSE 'Industrial' END WHERE momentum_63 IS NOT NULL""")
def bands_bind(spark, d):
    """Books under bands of six hundredths (the budget is a tenth short of 1) around the anchor sectors' shares: every sector stays within, and the books are the best of those."""
    packed, found = solved(spark, d, "mv", "momentum", 0.06)
    bands, mapping = allocation.sector_bands(_targets(spark, d), warehouse.universe(spark, d), 0.06)
    held = optimise.weights(found).join(mapping, "ticker").groupBy("date", "anchor").agg(F.sum("weight").alias("s")).join(bands, "anchor")
    proof = optimise.certificate(found, packed, settings("mv")).select("date", ((F.abs("gap") < 1e-5) & (F.col("violation") < 1e-6)).alias("optimal"))
    inside = (F.col("s") <= F.col("max_weight") + 1e-6) & (F.col("s") >= F.col("min_weight") - 1e-6)
    return held.withColumn("within", inside).join(proof, "date").select("date", "anchor", "target", "within", "optimal")


@query("o05_feasible_start", "as_of ticker weight:7", f"""
WITH s AS (SELECT c.date AS as_of, c.ticker, c.asset_class, COUNT(*) OVER (PARTITION BY c.date, c.asset_class) AS n, min_weight, max_weight FROM cand c JOIN {_BOUNDS_SQL} ON b.asset_class = c.asset_class),
w0 AS (SELECT as_of, ticker, LEAST(GREATEST((min_weight + LEAST(max_weight, n * 0.1)) / 2 / n, 0), 0.1) AS w FROM s),
w1 AS (SELECT as_of, ticker, w * 0.9 / SUM(w) OVER (PARTITION BY as_of) AS w FROM w0),
w2 AS (SELECT as_of, ticker, MAX(w) OVER (PARTITION BY as_of) > 0.1 + 1e-9 AS over_, CASE WHEN MAX(w) OVER (PARTITION BY as_of) > 0.1 + 1e-9 THEN LEAST(w, 0.1) ELSE w END AS w FROM w1)
SELECT as_of, ticker, CASE WHEN over_ THEN w * 0.9 / SUM(w) OVER (PARTITION BY as_of) ELSE w END AS weight FROM w2""")
def feasible_start(spark, d):
    c = base.candidates(spark, d).select(F.col("date").alias("as_of"), "ticker", "asset_class")
    return allocation.feasible_start(c, bounds(spark), target=0.9)


@query("o06_sanitised_bounds", "asset_class min_weight:6 max_weight:6", """
WITH b AS (SELECT * FROM (VALUES ('equity', 0.60::DOUBLE, 0.95::DOUBLE), ('fibra', 0.70::DOUBLE, 0.80::DOUBLE), ('fixed_income', 0.10::DOUBLE, 0.30::DOUBLE)) v(asset_class, min_weight, max_weight)),
n AS (SELECT asset_class, COUNT(*) AS n FROM univ GROUP BY 1),
s AS (SELECT b.asset_class, CASE WHEN min_weight > COALESCE(n, 0) * 0.1 + 1e-9 THEN round(COALESCE(n, 0) * 0.1::DOUBLE, 4) ELSE min_weight END AS lo, LEAST(max_weight, 0.9) AS hi FROM b LEFT JOIN n ON n.asset_class = b.asset_class)
SELECT asset_class, lo * CASE WHEN (SELECT SUM(lo) FROM s) > 0.9 + 1e-9 THEN 0.9 / (SELECT SUM(lo) FROM s) ELSE 1 END AS min_weight, hi AS max_weight FROM s""")
def sanitised_bounds(spark, d):
    asked = spark.createDataFrame([("equity", 0.60, 0.95), ("fibra", 0.70, 0.80), ("fixed_income", 0.10, 0.30)], "asset_class string, min_weight double, max_weight double")
    counts = warehouse.universe(spark, d).groupBy("asset_class").agg(F.count(F.lit(1)).alias("n"))
    return allocation.sanitise_bounds(asked, counts, target=0.9)


_VIOL = f"""
WITH caps AS (SELECT ticker, LEAST(0.1, COALESCE(max_position_override, 0.1)) AS cap, asset_class, issuer_id, COUNT(*) OVER (PARTITION BY issuer_id) AS k FROM univ),
j AS (SELECT w.*, c.cap, c.asset_class, c.issuer_id, c.k FROM wts w JOIN caps c ON c.ticker = w.ticker),
v AS (SELECT strategy_id, date, 'position_cap' AS rule, ticker AS item, weight - cap AS amount FROM j
UNION ALL SELECT strategy_id, date, 'target_sum', 'total', ABS(SUM(weight) - 1) FROM j GROUP BY 1, 2
UNION ALL SELECT strategy_id, date, 'class_min', s.asset_class, LEAST(min_weight, max_weight) - s FROM (SELECT strategy_id, date, asset_class, SUM(weight) AS s FROM j GROUP BY 1, 2, 3) s JOIN {_BOUNDS_SQL} ON b.asset_class = s.asset_class
UNION ALL SELECT strategy_id, date, 'class_max', s.asset_class, s - max_weight FROM (SELECT strategy_id, date, asset_class, SUM(weight) AS s FROM j GROUP BY 1, 2, 3) s JOIN {_BOUNDS_SQL} ON b.asset_class = s.asset_class
UNION ALL SELECT strategy_id, date, 'issuer_limit', issuer_id, SUM(weight) - 0.10 FROM j WHERE k > 1 GROUP BY 1, 2, 4)
SELECT * FROM v WHERE amount > 1e-4"""


@query("o07_violations", "strategy_id date rule item amount:6", _VIOL)
def violations(spark, d):
    return allocation.violations(base.rule_weights(spark, d), warehouse.universe(spark, d), bounds(spark), keys=("strategy_id", "date"))


def _targets(spark, d):
    uni = warehouse.universe(spark, d)
    total = uni.agg(F.sum("market_cap")).scalar()
    return uni.groupBy("sector").agg((F.sum("market_cap") / total).alias("weight"))


@query("o08_sector_bands", "anchor target:6 min_weight:6 max_weight:6", """
SELECT anchor, SUM(weight) AS target, GREATEST(0, SUM(weight) - 0.15) AS min_weight, LEAST(1, SUM(weight) + 0.15) AS max_weight FROM (
  SELECT CASE WHEN sector = 'FIBRA' THEN 'FIBRA' ELSE 'Industrial' END AS anchor, market_cap / (SELECT SUM(market_cap) FROM univ) AS weight FROM univ) GROUP BY 1""")
def sector_bands(spark, d):
    return allocation.sector_bands(_targets(spark, d), warehouse.universe(spark, d))[0]


@query("o09_final_sector_weights", "strategy_id as_of sector weight:6", """
SELECT strategy_id, CAST(date AS VARCHAR) AS as_of, sector, SUM(weight) AS weight FROM wts w JOIN univ u ON u.ticker = w.ticker WHERE date = (SELECT MAX(date) FROM wts) AND sector <> 'Government' GROUP BY 1, 2, 3""")
def final_sector_weights(spark, d):
    w = backtest.final_weights(base.rule_weights(spark, d)).join(warehouse.universe(spark, d).select("ticker", "sector"), "ticker")
    return w.where("sector <> 'Government'").groupBy("strategy_id", F.col("date").cast("string").alias("as_of"), "sector").agg(F.sum("weight").alias("weight"))


@query("o10_issuer_and_caps", "ticker issuer_id n_tickers cap:4", """
SELECT u.ticker, u.issuer_id, k AS n_tickers, LEAST(0.1, COALESCE(max_position_override, 0.1)) AS cap FROM (SELECT *, COUNT(*) OVER (PARTITION BY issuer_id) AS k FROM univ) u WHERE k > 1""")
def issuer_and_caps(spark, d):
    uni = warehouse.universe(spark, d)
    return allocation.issuer_groups(uni).join(allocation.position_caps(uni), "ticker")


_THRESH = """SELECT date, CASE WHEN ip < 0 OR fx > 0.05 THEN 'stress' WHEN dr > 0.01 THEN 'tightening' ELSE 'expansion' END AS regime FROM (
  SELECT date, industrial_production_yoy AS ip, usd_mxn / lag(usd_mxn, 3) OVER (ORDER BY date) - 1 AS fx, banxico_rate - lag(banxico_rate, 3) OVER (ORDER BY date) AS dr FROM mac)"""


def _regimes(spark, d):
    return regimes.threshold_regimes(warehouse.macro(spark, d), rate_step=0.01).select("date", "regime")


@query("o11_liquidity_sleeve", "date regime total_sleeve:4 cetes28_weight:4 cetes91_weight:4", f"""
SELECT date, regime, s AS total_sleeve, s / 2 AS cetes28_weight, s / 2 AS cetes91_weight FROM (SELECT *, CASE regime WHEN 'stress' THEN 0.115 WHEN 'tightening' THEN 0.065 ELSE 0.04 END AS s FROM ({_THRESH}))""")
def liquidity_sleeve(spark, d):
    return regimes.liquidity_sleeve(_regimes(spark, d))


@query("o12_regime_bounds", "date regime asset_class min_weight:4 max_weight:4", f"""
SELECT date, r.regime, asset_class, lo AS min_weight, hi AS max_weight FROM ({_THRESH}) r JOIN (VALUES ('expansion', 'equity', 0.55, 0.90), ('expansion', 'fibra', 0.05, 0.25), ('expansion', 'fixed_income', 0.00, 0.10),
  ('tightening', 'equity', 0.45, 0.75), ('tightening', 'fibra', 0.05, 0.20), ('tightening', 'fixed_income', 0.05, 0.20), ('stress', 'equity', 0.35, 0.60), ('stress', 'fibra', 0.03, 0.15), ('stress', 'fixed_income', 0.10, 0.30)) v(g, asset_class, lo, hi) ON v.g = r.regime""")
def regime_bounds(spark, d):
    return regimes.regime_bounds(_regimes(spark, d))


@query("o13_blended_bounds", "date asset_class min_weight:5 max_weight:5", f"""
WITH v AS (SELECT * FROM (VALUES ('expansion', 'equity', 0.55, 0.90), ('expansion', 'fibra', 0.05, 0.25), ('expansion', 'fixed_income', 0.00, 0.10),
  ('tightening', 'equity', 0.45, 0.75), ('tightening', 'fibra', 0.05, 0.20), ('tightening', 'fixed_income', 0.05, 0.20), ('stress', 'equity', 0.35, 0.60), ('stress', 'fibra', 0.03, 0.15), ('stress', 'fixed_income', 0.10, 0.30)) v(g, asset_class, lo, hi)),
r AS (SELECT date, regime, lag(regime) OVER (ORDER BY date) AS p FROM ({_THRESH}))
SELECT date, a.asset_class, 0.75 * b.lo + 0.25 * a.lo AS min_weight, 0.75 * b.hi + 0.25 * a.hi AS max_weight FROM r JOIN v a ON a.g = r.regime JOIN v b ON b.g = r.p AND b.asset_class = a.asset_class""")
def blended_bounds(spark, d):
    from pyspark.sql.window import Window
    r = _regimes(spark, d).withColumn("prev", F.lag("regime").over(Window.partitionBy(F.lit(1)).orderBy("date"))).where(F.col("prev").isNotNull())
    now = regimes.regime_bounds(r.select("date", "regime"))
    before = regimes.regime_bounds(r.select("date", F.col("prev").alias("regime")))
    cols = ["date", "asset_class", "min_weight", "max_weight"]
    return regimes.blend_bounds(before.select(*cols), now.select(*cols), 0.25, keys=("date", "asset_class"))


_TRANS = f"""
WITH RECURSIVE s AS (SELECT date, regime, regime_confidence AS c, row_number() OVER (ORDER BY date) AS i FROM regimehist),
w AS (SELECT i, date, regime AS prev, CAST(NULL AS VARCHAR) AS tgt, CAST(NULL AS VARCHAR) AS org, 0 AS step, regime AS lab, CAST(NULL AS DOUBLE) AS a FROM s WHERE i = 1
UNION ALL SELECT i, date, CASE WHEN bl AND NOT done THEN prev ELSE regime END, CASE WHEN bl AND NOT done THEN regime END, CASE WHEN bl AND NOT done THEN o END, CASE WHEN bl AND NOT done THEN st + 1 ELSE 0 END,
  CASE WHEN bl THEN o || '->' || regime ELSE regime END, CASE WHEN bl THEN st / 2.0::DOUBLE END FROM (
  SELECT *, st >= 2 AS done FROM (SELECT s.i, s.date, s.regime, w.prev, (s.regime <> w.prev AND s.c IS NOT NULL AND s.c < 1.2) AS bl,
    CASE WHEN w.tgt = s.regime THEN w.step ELSE 1 END AS st, CASE WHEN w.tgt = s.regime THEN w.org ELSE w.prev END AS o FROM w JOIN s ON s.i = w.i + 1)))
SELECT date, lab AS effective_regime, a AS transition_alpha FROM w"""


@query("o14_regime_transition", "date effective_regime transition_alpha:3", _TRANS)
def regime_transition(spark, d):
    h = regimes.composite_regimes(warehouse.macro(spark, d)).select(F.lit("one").alias("strategy_id"), "date", "regime", "regime_confidence")
    return regimes.transition_path(h, min_confidence=1.2)


_IN_FORCE = _TRANS.replace("FROM regimehist", "FROM (SELECT r.date, h.regime, h.regime_confidence FROM mends r JOIN (SELECT r.date AS at, MAX(h.date) AS known FROM mends r JOIN regimehist h ON h.date <= r.date GROUP BY 1) k ON k.at = r.date JOIN regimehist h ON h.date = k.known)")


@query("o14b_bounds_in_force", "as_of asset_class min_weight:6 max_weight:6", f"""
WITH p AS ({_IN_FORCE}), v AS (SELECT * FROM (VALUES ('expansion', 'equity', 0.55, 0.90), ('expansion', 'fibra', 0.05, 0.25), ('tightening', 'equity', 0.45, 0.75), ('tightening', 'fibra', 0.05, 0.20), ('stress', 'equity', 0.35, 0.60), ('stress', 'fibra', 0.03, 0.15)) v(g, asset_class, lo, hi)),
b AS (SELECT p.date, x.asset_class, (1 - COALESCE(transition_alpha, 1)) * x.lo + COALESCE(transition_alpha, 1) * y.lo AS lo, (1 - COALESCE(transition_alpha, 1)) * x.hi + COALESCE(transition_alpha, 1) * y.hi AS hi
  FROM p JOIN v x ON x.g = string_split(effective_regime, '->')[1] JOIN v y ON y.asset_class = x.asset_class AND y.g = string_split(effective_regime, '->')[-1])
SELECT m.date AS as_of, o.asset_class, COALESCE(b.lo, o.min_weight) AS min_weight, COALESCE(b.hi, o.max_weight) AS max_weight FROM mends m CROSS JOIN (SELECT * FROM {_BOUNDS_SQL}) o LEFT JOIN b ON b.date = m.date AND b.asset_class = o.asset_class""")
def bounds_in_force(spark, d):
    return dated_bounds(spark, d)
