"""Joins, aggregates, top-k and set operations (inventory groups J, A, T, U)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import backtest, features, joins, quality, ranks, reporting, risk, significance, views
from ..sources import panel, payloads, warehouse
from . import base
from .core import query

# ------------------------------------------------------------------ joins


@query("j01_asof_fundamentals", "date ticker price:4 pe_ratio:8 ebitda_growth:6", """
SELECT p.date, p.ticker, p.price, f.pe_ratio, f.ebitda_growth FROM pan p ASOF LEFT JOIN fund_lag f ON p.ticker = f.ticker AND p.date >= f.known""")
def asof_fundamentals(spark, d):
    reports = quality.publication_lag(warehouse.fundamentals(spark, d))
    return joins.asof_join(warehouse.price_panel(spark, d), reports, ["ticker"], ["pe_ratio", "ebitda_growth"])


@query("j01b_asof_by_window", "date ticker roe:9 profit_margin:9", """
SELECT p.date, p.ticker, f.roe, f.profit_margin FROM pan p ASOF LEFT JOIN fund_lag f ON p.ticker = f.ticker AND p.date >= f.known""")
def asof_by_window(spark, d):
    reports = quality.publication_lag(warehouse.fundamentals(spark, d))
    return joins.asof_by_window(warehouse.price_panel(spark, d), reports, ["ticker"], ["roe", "profit_margin"])


@query("j02_asof_macro", "date ticker usd_mxn:6 banxico_rate:7", """
SELECT p.date, p.ticker, m.usd_mxn, m.banxico_rate FROM pan p ASOF LEFT JOIN mac m ON p.date >= m.date""")
def asof_macro(spark, d):
    return features.daily_macro(warehouse.price_panel(spark, d), warehouse.macro(spark, d), ["usd_mxn", "banxico_rate"])


@query("j03_dimension_join", "date ticker sector weight:7", "SELECT w.date, w.ticker, u.sector, w.weight FROM wts w LEFT JOIN univ u ON u.ticker = w.ticker")
def dimension_join(spark, d):
    return base.rule_weights(spark, d).join(warehouse.universe(spark, d).select("ticker", "sector"), "ticker", "left")


@query("j04_calendar_join", "date ticker price:5", "SELECT g.date, g.ticker, p.price FROM grid g LEFT JOIN px p ON p.date = g.date AND p.ticker = g.ticker")
def calendar_join(spark, d):
    return panel.on_calendar(warehouse.prices(spark, d).select("date", "ticker", "price"))


@query("j05_exact_date_fill", "date usd_mxn:6", """
SELECT b.date, last_value(m.usd_mxn IGNORE NULLS) OVER (ORDER BY b.date ROWS UNBOUNDED PRECEDING) AS usd_mxn FROM bdays b LEFT JOIN mac m ON m.date = b.date""")
def exact_date_fill(spark, d):
    from ..functions import windows as W
    days = warehouse.price_panel(spark, d).select("date").distinct()
    df = days.join(warehouse.macro(spark, d).select("date", "usd_mxn"), "date", "left")
    return df.withColumn("usd_mxn", W.forward_fill("usd_mxn", Window.partitionBy(F.lit(1)).orderBy("date")))


@query("j06_align_series", "strategy_id benchmark n ret_sum:6 bench_sum:6", """
SELECT s.strategy_id, b.benchmark, COUNT(*) AS n, SUM(s.ret) AS ret_sum, SUM(b.ret) AS bench_sum FROM ser s JOIN bench b ON b.date = s.date GROUP BY 1, 2""")
def align_series(spark, d):
    pairs = significance.align(base.strategy_series(spark, d), base.benchmark_series(spark, d))
    return pairs.groupBy("strategy_id", "benchmark").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("ret_sum"), F.sum("bench").alias("bench_sum"))


@query("j07_lookup_or_self", "date ticker expected_return:6", """
SELECT c.date, c.ticker, COALESCE(v.x, c.momentum_63) AS expected_return FROM cand c LEFT JOIN
  (SELECT ticker, market_cap / (SELECT SUM(market_cap) FROM univ) AS x FROM univ WHERE asset_class = 'fibra') v ON v.ticker = c.ticker""")
def lookup_or_self(spark, d):
    uni = warehouse.universe(spark, d)
    total = uni.agg(F.sum("market_cap")).scalar()
    lookup = uni.where(F.col("asset_class") == "fibra").select("ticker", (F.col("market_cap") / total).alias("x"))
    c = base.candidates(spark, d).select("date", "ticker", F.col("momentum_63").alias("expected_return"))
    return joins.lookup_or_self(c, lookup, "ticker", "x", "expected_return")


@query("j08_semi_join", "date ticker volume:2", "SELECT date, ticker, volume FROM px WHERE ticker IN (SELECT ticker FROM univ WHERE sector = 'Logistics')")
def semi_join(spark, d):
    chosen = warehouse.universe(spark, d).where(F.col("sector") == "Logistics")
    return joins.keep_tickers(warehouse.prices(spark, d), chosen)


@query("j09_anti_join", "ticker", "SELECT ticker FROM univ WHERE liquidity_score < (SELECT quantile_cont(liquidity_score, 0.2) FROM univ)")
def anti_join(spark, d):
    uni = warehouse.universe(spark, d)
    return joins.drop_tickers(uni, quality.drop_illiquid(uni))


@query("j10_combine_first", "date ticker price:5", """
SELECT COALESCE(a.date, b.date) AS date, COALESCE(a.ticker, b.ticker) AS ticker, COALESCE(a.price, b.price) AS price
FROM (SELECT date, ticker, price FROM px WHERE date <= DATE '1998-06-30') a FULL JOIN (SELECT date, ticker, price + 1 AS price FROM px WHERE date >= DATE '1998-01-01') b
  ON a.date = b.date AND a.ticker = b.ticker""")
def combine_first(spark, d):
    px = warehouse.prices(spark, d).select("date", "ticker", "price")
    train, test = px.where("date <= date'1998-06-30'"), px.where("date >= date'1998-01-01'").withColumn("price", F.col("price") + 1.0)
    return joins.combine_first(train, test, ["date", "ticker"], ["price"])


@query("j11_source_priority", "date ticker price:5", """
SELECT date, ticker, price FROM (SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY k) AS rn FROM (
  SELECT date, ticker, ln(raw_price) AS price, 1 AS k FROM px WHERE volume > 30 UNION ALL SELECT date, ticker, price, 2 FROM px)) WHERE rn = 1""")
def source_priority(spark, d):
    px = warehouse.prices(spark, d)
    first = px.where(F.col("volume") > 30).select("date", "ticker", F.ln("raw_price").alias("price"))
    return panel.union_by_priority([first, px.select("date", "ticker", "price")])


@query("j12_many_source_join", "date IMAI:2 usd_mxn:6 us_fed_rate:7 banxico_rate:7", """
SELECT date, activity_level AS IMAI, usd_mxn, CASE WHEN quarter(date) < 3 THEN us_fed_rate END AS us_fed_rate, CASE WHEN year(date) > 1996 THEN banxico_rate END AS banxico_rate FROM macro_lv""")
def many_source_join(spark, d):
    m = warehouse.macro_levels(spark, d)
    return payloads.merge_macro([
        m.select("date", F.col("activity_level").alias("IMAI")), m.select("date", "usd_mxn"),
        m.where(F.quarter("date") < 3).select("date", "us_fed_rate"), m.where(F.year("date") > 1996).select("date", "banxico_rate")])


@query("j14_scenario_product", "strategy_id date ret:8", """
SELECT f.strategy_id, r.date, SUM(r.ret * f.weight / f.total) AS ret FROM rets r JOIN (
  SELECT strategy_id, ticker, weight, SUM(weight) OVER (PARTITION BY strategy_id) AS total FROM wts WHERE date = (SELECT MAX(date) FROM wts)) f ON f.ticker = r.ticker GROUP BY 1, 2""")
def scenario_product(spark, d):
    return risk.fixed_weight_returns(backtest.final_weights(base.rule_weights(spark, d)), base.returns_table(spark, d))


@query("j15_interval_join", "label strategy_id n ret_sum:6", """
SELECT label, strategy_id, COUNT(*) AS n, SUM(ret) AS ret_sum FROM ser JOIN (VALUES ('crash', DATE '1997-07-01', DATE '1997-10-31'), ('calm', DATE '1996-01-01', DATE '1997-08-15'),
  ('late', DATE '2000-01-01', DATE '2001-06-30')) v(label, a, b) ON date BETWEEN a AND b GROUP BY 1, 2""")
def interval_join(spark, d):
    spans = spark.createDataFrame([("crash", "1997-07-01", "1997-10-31"), ("calm", "1996-01-01", "1997-08-15"), ("late", "2000-01-01", "2001-06-30")], "label string, a string, b string")
    spans = spans.select("label", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    hit = joins.label_intervals(base.strategy_series(spark, d), spans, "a", "b", ["label"])
    return hit.groupBy("label", "strategy_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("ret_sum"))


# ------------------------------------------------------------------ aggregates


@query("a01_group_mean", "ticker view:7", "SELECT ticker, AVG(momentum_63) AS view FROM cand GROUP BY ticker")
def group_mean(spark, d):
    return views.forecast_views(base.candidates(spark, d).withColumnRenamed("momentum_63", "expected_return"))


@query("a02_month_last", "ticker date price:5", """
SELECT ticker, LAST_DAY(MAX(date)) AS date, arg_max(price, date) AS price FROM px GROUP BY ticker, date_trunc('month', date)""")
def month_last(spark, d):
    return payloads.month_last(warehouse.prices(spark, d).select("date", "ticker", "price"), ["ticker"], "price")


@query("a03_month_sum", "strategy_id month turnover:6", "SELECT strategy_id, CAST(date_trunc('month', date) AS DATE) AS month, SUM(turnover) AS turnover FROM ser GROUP BY 1, 2")
def month_sum(spark, d):
    return reporting.monthly_turnover(base.strategy_series(spark, d)).select("strategy_id", "month", "turnover")


@query("a04_week_mean", "ticker week_end volume:4", """
SELECT ticker, CAST(date + CAST((7 - isodow(date)) AS INT) AS DATE) AS week_end, AVG(volume) AS volume FROM pan GROUP BY 1, 2""")
def week_mean(spark, d):
    return warehouse.price_panel(spark, d).groupBy("ticker", S.week_end_sunday("date").alias("week_end")).agg(F.avg("volume").alias("volume"))


@query("a05_last_of_group", "ticker date volume:2", "SELECT ticker, MAX(date) AS date, arg_max(volume, date) AS volume FROM px GROUP BY ticker, date_trunc('month', date)")
def last_of_group(spark, d):
    return warehouse.prices(spark, d).groupBy("ticker", F.trunc("date", "MM").alias("m")).agg(F.max("date").alias("date"), F.max_by("volume", "date").alias("volume"))


@query("a06_pivot", "strategy_id date FIBRA:6 Industrial:6 Infrastructure:6 Logistics:6", """
SELECT strategy_id, w.date, SUM(CASE WHEN sector = 'FIBRA' THEN weight END) AS FIBRA, SUM(CASE WHEN sector = 'Industrial' THEN weight END) AS Industrial,
  SUM(CASE WHEN sector = 'Infrastructure' THEN weight END) AS Infrastructure, SUM(CASE WHEN sector = 'Logistics' THEN weight END) AS Logistics
FROM wts w JOIN univ u ON u.ticker = w.ticker GROUP BY strategy_id, w.date""")
def pivot(spark, d):
    w = base.rule_weights(spark, d).join(warehouse.universe(spark, d).select("ticker", "sector"), "ticker")
    return w.groupBy("strategy_id", "date").pivot("sector", ["FIBRA", "Industrial", "Infrastructure", "Logistics"]).agg(F.sum("weight"))


@query("a07_group_weights", "strategy_id date sector weight:6", "SELECT strategy_id, date, sector, SUM(weight) AS weight FROM wts w JOIN univ u ON u.ticker = w.ticker GROUP BY 1, 2, 3")
def group_weights(spark, d):
    return reporting.weights_by(base.rule_weights(spark, d), warehouse.universe(spark, d), "sector")


@query("a08_exact_quantiles", "ticker q05:6 q50:6 q95:6", """
SELECT ticker, quantile_cont(ret, 0.05) AS q05, quantile_cont(ret, 0.5) AS q50, quantile_cont(ret, 0.95) AS q95 FROM rets GROUP BY ticker""")
def exact_quantiles(spark, d):
    q = F.percentile("ret", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    r = base.returns_table(spark, d).groupBy("ticker").agg(q.alias("q"))
    return r.select("ticker", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q95"))


@query("a08b_table_quantile", "n quantile:4", "SELECT COUNT(l_extendedprice) AS n, quantile_cont(l_extendedprice, 0.99) AS quantile FROM lineitem")
def table_quantile(spark, d):
    """Exact quantile of a whole fact column without gathering it."""
    from ..functions.quantiles import exact_quantile
    return exact_quantile(warehouse.read(spark, d, "lineitem"), "l_extendedprice", 0.99)


@query("a09_tail_mean", "strategy_id var:7 cvar:7", """
SELECT s.strategy_id, MAX(v) AS var, AVG(ret) FILTER (WHERE ret <= v + 1e-12) AS cvar FROM ser s JOIN (SELECT strategy_id, quantile_cont(ret, 0.05) AS v FROM ser GROUP BY 1) q ON q.strategy_id = s.strategy_id GROUP BY 1""")
def tail_mean(spark, d):
    return risk.value_at_risk(base.strategy_series(spark, d))


@query("a10_deviations", "ticker sd_pop:7 sd_samp:7", "SELECT ticker, stddev_pop(ret) AS sd_pop, stddev_samp(ret) AS sd_samp FROM rets GROUP BY ticker")
def deviations(spark, d):
    return base.returns_table(spark, d).groupBy("ticker").agg(F.stddev_pop("ret").alias("sd_pop"), F.stddev_samp("ret").alias("sd_samp"))


@query("a11_beta", "strategy_id benchmark n beta:6", """
SELECT strategy_id, benchmark, COUNT(*) AS n, CASE WHEN COUNT(*) < 20 THEN 1 ELSE covar_samp(s.ret, b.ret) / (var_samp(b.ret) + 1e-12) END AS beta
FROM ser s JOIN bench b ON b.date = s.date GROUP BY 1, 2""")
def beta(spark, d):
    return significance.pair_points(significance.align(base.strategy_series(spark, d), base.benchmark_series(spark, d)))


_CORR_COLS = ["momentum_63", "momentum_126", "volatility_63", "value_score", "quality_score", "liquidity_score"]
_CORR_SQL = "\nUNION ALL ".join(
    f"SELECT '{a}' AS left_feature, '{b}' AS right_feature, corr({a}, {b}) AS corr FROM fm" for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i:])


@query("a12_feature_correlation", "left_feature right_feature corr:6", _CORR_SQL)
def feature_correlation(spark, d):
    return reporting.correlation_matrix(base.feature_table(spark, d), _CORR_COLS)


_SIGNALS = ["momentum_63", "momentum_126", "volatility_63", "value_score", "quality_score", "liquidity_score"]
_IC_SQL = f"""
WITH lab AS (SELECT date, ticker, {', '.join(_SIGNALS)}, ln(lead(price, 21) OVER (PARTITION BY ticker ORDER BY date) / (price + 1e-9)) AS fwd FROM fm),
rows_ AS (SELECT l.* FROM lab l JOIN (SELECT ticker, MAX(date) AS date FROM fm GROUP BY ticker, date_trunc('month', date)) m ON m.ticker = l.ticker AND m.date = l.date),
long_ AS (SELECT * FROM (UNPIVOT rows_ ON {', '.join(_SIGNALS)} INTO NAME signal VALUE x) WHERE fwd IS NOT NULL),
rk AS (SELECT signal, date, rank() OVER (PARTITION BY signal, date ORDER BY x) + (COUNT(*) OVER (PARTITION BY signal, date, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY signal, date ORDER BY fwd) + (COUNT(*) OVER (PARTITION BY signal, date, fwd) - 1) / 2.0::DOUBLE AS ry FROM long_)
SELECT signal, date, COUNT(*) AS n, corr(rx, ry) AS ic FROM rk GROUP BY signal, date HAVING COUNT(*) >= 4 AND var_pop(rx) > 0 AND var_pop(ry) > 0"""


@query("a13_rank_correlation", "signal date n ic:5", _IC_SQL)
def rank_correlation(spark, d):
    return significance.signal_ic(base.feature_table(spark, d))


@query("a14_skew_kurtosis", "strategy_id n_obs skew:5 kurtosis:4", """
SELECT strategy_id, COUNT(*) AS n_obs, AVG(pow((ret - m) / s, 3)) AS skew, AVG(pow((ret - m) / s, 4)) AS kurtosis
FROM (SELECT *, AVG(ret) OVER (PARTITION BY strategy_id) AS m, stddev_samp(ret) OVER (PARTITION BY strategy_id) AS s FROM ser) GROUP BY 1""")
def skew_kurtosis(spark, d):
    from ..operators.overfitting import moments
    return moments(base.strategy_series(spark, d))


@query("a15_median", "ticker median_volume:2", "SELECT ticker, median(volume) AS median_volume FROM px GROUP BY ticker")
def median(spark, d):
    return warehouse.prices(spark, d).groupBy("ticker").agg(F.median("volume").alias("median_volume"))


@query("a16_distinct_keys", "ticker sector date", """
SELECT ticker, sector, MAX(date) AS date FROM cand GROUP BY 1, 2""")
def distinct_keys(spark, d):
    c = base.candidates(spark, d)
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    return c.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("ticker", "sector", "date")


@query("a17_value_counts", "asset_class sector n share:6", "SELECT asset_class, sector, COUNT(*) AS n, COUNT(*) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM univ) AS share FROM univ GROUP BY 1, 2")
def value_counts(spark, d):
    return reporting.composition(warehouse.universe(spark, d), ["asset_class", "sector"])


@query("a18_arg_extremes", "strategy_id best_date worst_date", "SELECT strategy_id, arg_max(date, (ret, date)) AS best_date, arg_min(date, (ret, date)) AS worst_date FROM ser GROUP BY 1")
def arg_extremes(spark, d):
    return base.strategy_series(spark, d).groupBy("strategy_id").agg(
        F.max_by("date", F.struct("ret", "date")).alias("best_date"), F.min_by("date", F.struct("ret", "date")).alias("worst_date"))


@query("a19_state_changes", "switches", """
SELECT CAST(SUM(CASE WHEN r <> p THEN 1 ELSE 0 END) AS BIGINT) AS switches FROM (SELECT r, lag(r) OVER (ORDER BY date) AS p FROM (
  SELECT date, CASE WHEN ip < 0 OR fx > 0.05 THEN 'stress' WHEN dr > 0.25 THEN 'tightening' ELSE 'expansion' END AS r FROM (
    SELECT date, industrial_production_yoy AS ip, usd_mxn / lag(usd_mxn, 3) OVER (ORDER BY date) - 1 AS fx, banxico_rate - lag(banxico_rate, 3) OVER (ORDER BY date) AS dr FROM mac)))""")
def state_changes(spark, d):
    from ..operators import regimes
    return regimes.count_switches(regimes.threshold_regimes(warehouse.macro(spark, d)))


@query("a20_weighted_average", "ticker view:7 confidence:6", """
SELECT ticker, SUM(v * c) / SUM(c) AS view, MAX(c) AS confidence FROM (
  SELECT ticker, momentum_63 AS v, 0.2 + 0.1 * (month(date) % 5) AS c FROM cand) GROUP BY ticker HAVING SUM(c) > 1e-12""")
def weighted_average(spark, d):
    rows = base.candidates(spark, d).select(F.lit("m").alias("source"), "ticker", F.col("momentum_63").alias("view"), (F.lit(0.2) + F.lit(0.1) * (F.month("date") % 5)).alias("confidence"))
    return views.combine_views(rows)


@query("a21_minmax", "ticker score:6", "SELECT ticker, (market_cap - MIN(market_cap) OVER ()) / (MAX(market_cap) OVER () - MIN(market_cap) OVER ()) AS score FROM univ")
def minmax(spark, d):
    return quality.minmax_score(warehouse.universe(spark, d), "market_cap", "score")


@query("a22_histogram", "strategy_id bin n", """
SELECT s.strategy_id, LEAST(CAST(floor((ret - lo) / (hi - lo) * 60) AS BIGINT), 59) AS bin, COUNT(*) AS n FROM ser s
JOIN (SELECT strategy_id, MIN(ret) AS lo, MAX(ret) AS hi FROM ser GROUP BY 1) b ON b.strategy_id = s.strategy_id GROUP BY 1, 2""")
def histogram(spark, d):
    return reporting.return_histogram(base.strategy_series(spark, d), 60)


@query("a23_monthly_box", "month n q1:6 median:6 q3:6 low:6 high:6", """
SELECT month, COUNT(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, MIN(x) AS low, MAX(x) AS high
FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, momentum_63 AS x FROM cand) WHERE month IN (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS m FROM cand ORDER BY m DESC LIMIT 12) GROUP BY month""")
def monthly_box(spark, d):
    return reporting.monthly_dispersion(base.candidates(spark, d), "momentum_63", 12)


# ------------------------------------------------------------------ top-k and sorts


@query("t01_top_bottom", "date ticker side", """
SELECT date, ticker, side FROM (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY momentum_63 DESC, ticker) AS up, row_number() OVER (PARTITION BY date ORDER BY momentum_63, ticker DESC) AS dn FROM cand)
CROSS JOIN (SELECT unnest(['long', 'short']) AS side) WHERE (side = 'long' AND up <= 5) OR (side = 'short' AND dn <= 3)""")
def top_bottom(spark, d):
    from ..operators.overlay import pick_sides
    return pick_sides(base.candidates(spark, d).withColumnRenamed("momentum_63", "expected_return"), 5, 3)


@query("t02_top_tickers", "strategy_id ticker mean_weight:6", """
SELECT strategy_id, ticker, mean_weight FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY round(mean_weight, 9) DESC, ticker) AS rn FROM (
  SELECT w.strategy_id, w.ticker, SUM(weight) / MAX(k) AS mean_weight FROM wts w JOIN (SELECT strategy_id, COUNT(DISTINCT date) AS k FROM wts GROUP BY 1) n ON n.strategy_id = w.strategy_id GROUP BY 1, 2)) WHERE rn <= 8""")
def top_tickers(spark, d):
    return reporting.top_by_mean_weight(base.rule_weights(spark, d), 8)


@query("t03_top_trials", "trial_id value:6", "SELECT user_id % 20 AS trial_id, AVG(value) AS value FROM events GROUP BY 1 ORDER BY value DESC, trial_id LIMIT 10")
def top_trials(spark, d):
    trials = warehouse.read(spark, d, "events").groupBy((F.col("user_id") % 20).alias("trial_id")).agg(F.avg("value").alias("value"))
    return reporting.top_trials(trials, 10)


@query("t04_last_rows", "ticker n first_date last_date", """
SELECT ticker, COUNT(*) AS n, MIN(date) AS first_date, MAX(date) AS last_date FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM px) WHERE rn <= 252 GROUP BY ticker""")
def last_rows(spark, d):
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    last = warehouse.prices(spark, d).withColumn("_rn", F.row_number().over(w)).where("_rn <= 252")
    return last.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("t05_presentation_sort", "rank ticker market_cap:2", "SELECT row_number() OVER (ORDER BY market_cap DESC, ticker) AS rank, ticker, market_cap FROM univ")
def presentation_sort(spark, d):
    return ranks.row_numbers(warehouse.universe(spark, d), [F.col("market_cap").desc(), F.col("ticker")])


# ------------------------------------------------------------------ set operations


@query("u01_union_by_name", "asset_class rows", "SELECT asset_class, COUNT(*) AS rows FROM fm GROUP BY 1")
def union_by_name(spark, d):
    return features.signal_matrix(**base.feature_inputs(spark, d)).groupBy("asset_class").agg(F.count(F.lit(1)).alias("rows"))


@query("u02_union_parts", "strategy_id n", "SELECT strategy_id, COUNT(*) AS n FROM wts GROUP BY 1")
def union_parts(spark, d):
    return base.rule_weights(spark, d).groupBy("strategy_id").agg(F.count(F.lit(1)).alias("n"))


@query("u03_set_difference", "date ticker", "SELECT date, ticker FROM grid EXCEPT SELECT date, ticker FROM px")
def set_difference(spark, d):
    return panel.on_calendar(warehouse.prices(spark, d)).select("date", "ticker").exceptAll(warehouse.prices(spark, d).select("date", "ticker"))


@query("u04_intersection", "ticker", "SELECT ticker FROM wts WHERE strategy_id = 'momentum' INTERSECT SELECT ticker FROM wts WHERE strategy_id = 'lowvol'")
def intersection(spark, d):
    w = base.rule_weights(spark, d)
    return w.where("strategy_id = 'momentum'").select("ticker").intersect(w.where("strategy_id = 'lowvol'").select("ticker"))


@query("u05_union_keys", "ticker", "SELECT ticker FROM wts WHERE strategy_id = 'momentum' UNION SELECT ticker FROM univ WHERE asset_class = 'fibra'")
def union_keys(spark, d):
    w = base.rule_weights(spark, d).where("strategy_id = 'momentum'").select("ticker")
    return w.union(warehouse.universe(spark, d).where("asset_class = 'fibra'").select("ticker")).distinct()
