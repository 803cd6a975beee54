"""Scans, filters, fills, features (inventory groups S, P, F)."""

from __future__ import annotations

from zlib import crc32

import itertools

from pyspark.sql import functions as F

from ..constants import EQUITY_DEFAULTS, FUNDAMENTAL_FIELDS, QUALIFIED_MARKS, REGULATED_KEYS
from ..functions import scalars as S
from ..operators import features, joins, quality
from ..session import shared_dir, stage_once
from ..sources import panel, payloads, providers, sinks, warehouse
from . import base
from .core import query

# ------------------------------------------------------------------ sources


@query("s01_parquet_scan", "date ticker ext_sum:4 qty_sum:2 disc_sum:6 tax_sum:6 returned_n n",
       "SELECT * FROM cells")
def parquet_scan(spark, d):
    return warehouse.daily_cells(spark, d)


def _wide(spark, d, value):
    """Wide landing derived from the observed cells (one column per ticker)."""
    cells = warehouse.prices(spark, d)
    tickers = [r.ticker for r in warehouse.universe(spark, d).select("ticker").orderBy("ticker").toLocalIterator()]
    return stage_once(spark, d, f"wide_{value}", lambda: cells.groupBy("date").pivot("ticker", tickers).agg(F.first(value)))


@query("s02_wide_price_scan", "date ticker price:5", """
SELECT g.date, t.ticker, last_value(p.price IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY g.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS price
FROM (SELECT DISTINCT date FROM px WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') g CROSS JOIN (SELECT DISTINCT ticker FROM px) t
LEFT JOIN px p ON p.date = g.date AND p.ticker = t.ticker""")
def wide_price_scan(spark, d):
    return panel.wide_price_scan(_wide(spark, d, "price"), start="1996-01-01", end="1999-12-31")


@query("s03_wide_volume_scan", "date ticker volume:2", """
SELECT g.date, t.ticker, COALESCE(p.volume, 0) AS volume
FROM (SELECT DISTINCT date FROM px WHERE date >= DATE '1997-01-01') g CROSS JOIN (SELECT DISTINCT ticker FROM px) t
LEFT JOIN px p ON p.date = g.date AND p.ticker = t.ticker""")
def wide_volume_scan(spark, d):
    return panel.wide_volume_scan(_wide(spark, d, "volume"), start="1997-01-01")


def _eav(spark, d):
    """Fundamentals as (date, ticker, field, value text) under vendor field names."""
    back = {v: k for k, v in FUNDAMENTAL_FIELDS.items()}
    reports = warehouse.fundamentals(spark, d)
    text = reports.select("date", "ticker", *[F.col(c).cast("string").alias(back[c]) for c in back])
    return text.unpivot(["date", "ticker"], list(back.values()), "field", "value").where(F.col("value").isNotNull())


@query("s04_eav_pivot", "date ticker pe_ratio:8 pb_ratio:9 roe:9 profit_margin:9 net_debt_to_ebitda:9 ebitda_growth:6 capex_to_sales:9",
       "SELECT * FROM fund WHERE date <= DATE '2000-12-31'")
def eav_pivot(spark, d):
    wide = panel.eav_pivot(_eav(spark, d), list(FUNDAMENTAL_FIELDS), end="2000-12-31")
    return panel.conform(panel.rename_fields(wide, FUNDAMENTAL_FIELDS), panel.table_schema(list(EQUITY_DEFAULTS)))


@query("s05_rename_fields", "date ticker price:6 ytm:6 duration:6 credit_spread:6",
       "SELECT date, ticker, price, ytm, duration, credit_spread FROM bnd")
def rename_fields(spark, d):
    vendor = warehouse.bonds(spark, d).withColumnsRenamed(
        {"price": "PX_LAST", "ytm": "YLD_YTM_MID", "duration": "DUR_MID", "credit_spread": "Z_SPRD_MID"})
    from ..constants import BOND_FIELDS
    return panel.rename_fields(vendor, BOND_FIELDS)


@query("s06_conform_schema", "date ticker asset_class price:6 ytm:6 duration:6 credit_spread:6", """
SELECT date, ticker, CAST(NULL AS VARCHAR) AS asset_class, price, CAST(NULL AS DOUBLE) AS ytm, duration, CAST(NULL AS DOUBLE) AS credit_spread FROM bnd""")
def conform_schema(spark, d):
    partial = warehouse.bonds(spark, d).select("date", "ticker", F.col("price").cast("string").alias("price"), "duration")
    return panel.conform(partial, panel.table_schema(["asset_class", "price", "ytm", "duration", "credit_spread"]))


@query("s07_landed_tables", "table_name rows value_sum:4", """
SELECT 'prices' AS table_name, COUNT(price) AS rows, SUM(price) AS value_sum FROM (
  SELECT last_value(p.price IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY g.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS price
  FROM (SELECT DISTINCT date FROM px) g CROSS JOIN (SELECT DISTINCT ticker FROM px) t LEFT JOIN px p ON p.date = g.date AND p.ticker = t.ticker)
UNION ALL SELECT 'fundamentals', COUNT(*), SUM(pe_ratio) FROM fund
UNION ALL SELECT 'bonds', COUNT(*), SUM(price) FROM bnd
UNION ALL SELECT 'macro', COUNT(*), SUM(usd_mxn) FROM mac
UNION ALL SELECT 'market_caps', COUNT(*), SUM(market_cap) FROM univ""")
def landed_tables(spark, d):
    folder = f"{shared_dir(spark)}/landing-{spark.sparkContext.applicationId}-{crc32(d.encode())}"

    def land():
        sinks.write_tables({
            "prices": _wide(spark, d, "price"), "fundamentals": _eav(spark, d),
            "bonds": warehouse.bonds(spark, d), "macro": warehouse.macro(spark, d).drop("sp500"),
            "market_caps": warehouse.universe(spark, d).select("ticker", F.col("market_cap").alias("market_cap_mxn")),
        }, folder)
        return spark.createDataFrame([(folder,)], "folder string")

    stage_once(spark, d, "landing", land)
    source = providers.get_provider("landed", spark, folder)
    total = lambda df, name, value: df.agg(F.lit(name).alias("table_name"), F.count(value).alias("rows"), F.sum(value).alias("value_sum"))
    parts = [total(source.prices(), "prices", "price"), total(source.fundamentals(), "fundamentals", "pe_ratio"),
             total(source.bonds(), "bonds", "price"), total(source.macro(), "macro", "usd_mxn"),
             total(source.market_caps(), "market_caps", "market_cap")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("s08_index_csv_scan", "date ticker price:5", """
SELECT b.date, t.ticker, last_value(p.price IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY b.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS price
FROM bdays b CROSS JOIN (SELECT DISTINCT ticker FROM px) t
LEFT JOIN px p ON p.date = b.date AND p.ticker = t.ticker""")
def index_csv_scan(spark, d):
    folder = f"{shared_dir(spark)}/csv-{spark.sparkContext.applicationId}-{crc32(d.encode())}"

    def land():
        warehouse.prices(spark, d).select("date", "price", "ticker").write.mode("overwrite").partitionBy("ticker").option("header", True).csv(folder)
        return spark.createDataFrame([(folder,)], "folder string")

    stage_once(spark, d, "index_csv", land)
    return panel.read_index_folder(spark, folder)


def _series_payload(spark, d):
    """Landed series documents: one JSON text per series, day-first dates, numbers as text."""
    m = warehouse.macro_levels(spark, d)
    point = lambda c: F.struct(F.date_format("date", "dd/MM/yyyy").alias("fecha"), F.col(c).cast("string").alias("dato"))
    rows = m.agg(*[F.collect_list(point(c)).alias(c) for c in ("banxico_rate", "inflation_level", "usd_mxn")])
    series = F.array(*[F.struct(F.lit(sid).alias("idSerie"), F.col(c).alias("datos")) for sid, c in
                       (("SF43783", "banxico_rate"), ("SP1", "inflation_level"), ("SF60653", "usd_mxn"))])
    return rows.select(F.to_json(F.struct(F.struct(series.alias("series")).alias("bmx"))).alias("payload"))


@query("s09_series_payload", "date banxico_rate:6 inflation_index:2 usd_mxn_banxico:6",
       "SELECT date, banxico_rate, inflation_level AS inflation_index, usd_mxn AS usd_mxn_banxico FROM macro_lv")
def series_payload(spark, d):
    from ..constants import MACRO_SERIES
    return payloads.month_rows_pivot(payloads.series_rows(_series_payload(spark, d)), MACRO_SERIES, "series_id")


def _observation_payload(spark, d):
    m = warehouse.macro_levels(spark, d)
    obs = F.struct(F.date_format("date", "yyyy/MM").alias("TIME_PERIOD"), F.col("activity_level").cast("string").alias("OBS_VALUE"))
    return m.agg(F.collect_list(obs).alias("o")).select(
        F.lit("activity").alias("indicator"),
        F.to_json(F.struct(F.array(F.struct(F.col("o").alias("OBSERVATIONS"))).alias("Series"))).alias("payload"))


@query("s10_observation_payload", "indicator date value:4",
       "SELECT 'activity' AS indicator, CAST(date_trunc('month', date) AS DATE) AS date, activity_level AS value FROM macro_lv")
def observation_payload(spark, d):
    return payloads.observation_rows(_observation_payload(spark, d))


@query("s11_macro_merge", "date IMAI:2 industrial_production_yoy:6 exports_yoy:6 usd_mxn:6 banxico_rate:6 inflation_yoy:6 us_ip_yoy:6 us_fed_rate:6", """
SELECT CAST(LAST_DAY(c.m) AS DATE) AS date, activity_level AS IMAI, CAST(NULL AS DOUBLE) AS industrial_production_yoy, CAST(NULL AS DOUBLE) AS exports_yoy,
  CASE WHEN month(date) % 2 = 0 THEN usd_mxn ELSE usd_mxn + 1 END AS usd_mxn, banxico_rate, CAST(NULL AS DOUBLE) AS inflation_yoy, CAST(NULL AS DOUBLE) AS us_ip_yoy, us_fed_rate
FROM (SELECT unnest(generate_series((SELECT CAST(date_trunc('month', MIN(date)) AS TIMESTAMP) FROM macro_lv), (SELECT CAST(MAX(date) AS TIMESTAMP) FROM macro_lv), INTERVAL 1 MONTH)) AS m) c
LEFT JOIN macro_lv ON LAST_DAY(c.m) = date""")
def macro_merge(spark, d):
    m = warehouse.macro_levels(spark, d)
    rates = m.select("date", "us_fed_rate", F.when(F.month("date") % 2 == 0, F.col("usd_mxn")).alias("usd_mxn"))
    bank = m.select("date", "banxico_rate", (F.col("usd_mxn") + 1.0).alias("usd_mxn_banxico"))
    activity = m.select("date", F.col("activity_level").alias("IMAI"))
    return payloads.merge_macro([rates, bank, activity])


@query("s12_symbol_mapping", "ticker symbol", """
SELECT ticker, CASE WHEN k % 4 = 1 THEN 'X ' || k || ' Equity' WHEN k % 4 = 2 THEN 'Q' || k
  WHEN k % 4 = 3 THEN 'Y' || k || ' MM Equity' ELSE ticker || ' MM Equity' END AS symbol
FROM (SELECT ticker, CAST(SUBSTR(ticker, 7) AS INT) AS k FROM univ) WHERE NOT (k % 4 = 0 AND k % 8 = 0)""")
def symbol_mapping(spark, d):
    """Mapping rows of every kind: qualified text, qualified flag, plain, NULL (skip), none."""
    tickers = warehouse.universe(spark, d).select("ticker")
    k = F.substring("ticker", 7, 4).cast("int")
    symbol = (F.when(k % 4 == 1, F.concat(F.lit("X "), k, F.lit(" Equity"))).when(k % 4 == 2, F.concat(F.lit("Q"), k))
              .when(k % 4 == 3, F.concat(F.lit("Y"), k)))
    mapping = tickers.where((k % 4 != 0) | (k % 8 == 0)).select(
        F.col("ticker").alias("canonical"), F.lit("bloomberg").alias("provider"), symbol.alias("symbol"), (k % 4 == 2).alias("qualified"))
    marks = QUALIFIED_MARKS["bloomberg"]
    return panel.resolve_symbols(tickers, mapping, "bloomberg", " MM Equity", marks["prefix"], marks["contains"])


@query("s13_vendor_normalise", "date ticker price:5",
       "SELECT date, CASE ticker WHEN 'Brand#1' THEN 'ONE' ELSE ticker END AS ticker, price FROM px")
def vendor_normalise(spark, d):
    vendor = warehouse.prices(spark, d).select(
        F.col("date").alias("Date"), F.concat(F.lit(" "), "ticker").alias("security"), F.lit("PX_LAST").alias("field"),
        F.col("price").cast("string").alias("value"))
    return panel.vendor_long(vendor, {"Brand#1": "ONE"}, "price")


@query("s14_month_end_densify", "date ticker pe_ratio:8 roe:9", """
SELECT g.date, g.ticker, f.pe_ratio, f.roe FROM (
  SELECT CAST(LAST_DAY(m) AS DATE) AS date, ticker FROM (SELECT unnest(generate_series((SELECT CAST(date_trunc('month', MIN(date)) AS TIMESTAMP) FROM fund), (SELECT CAST(MAX(date) AS TIMESTAMP) FROM fund), INTERVAL 1 MONTH)) AS m)
  CROSS JOIN (SELECT DISTINCT ticker FROM fund)) g ASOF LEFT JOIN fund f ON g.ticker = f.ticker AND g.date >= f.date""")
def month_end_densify(spark, d):
    return panel.month_end_fill(warehouse.fundamentals(spark, d), ["pe_ratio", "roe"])


@query("s15_field_fallback", "date ticker price:5", """
SELECT date, ticker, COALESCE(CASE WHEN volume > 40 THEN price END, CASE WHEN volume > 10 THEN price + 1 END, ln(raw_price)) AS price FROM px""")
def field_fallback(spark, d):
    df = warehouse.prices(spark, d).select(
        "date", "ticker", F.when(F.col("volume") > 40, F.col("price")).alias("close_adjusted"),
        F.when(F.col("volume") > 10, F.col("price") + 1.0).otherwise(F.lit(float("nan"))).alias("close"), F.ln("raw_price").alias("last_trade"))
    return panel.first_available(df, ["close_adjusted", "close", "last_trade"], "price")


@query("s16_source_fallback", "date ticker price:5", """
SELECT date, ticker, CASE WHEN CAST(SUBSTR(ticker, 7) AS INT) % 3 = 0 THEN price * 2 ELSE price END AS price FROM px""")
def source_fallback(spark, d):
    """A third of the tickers have no usable primary value and come from the second source."""
    px = warehouse.prices(spark, d)
    missing = F.substring("ticker", 7, 4).cast("int") % 3 == 0
    primary = px.select("date", "ticker", F.when(~missing, F.col("price")).alias("price"))
    return panel.source_fallback(primary, px.select("date", "ticker", (F.col("price") * 2).alias("price")))


@query("s17_load_bundle", "item value", """
SELECT 'dropped_ticker' AS item, ticker AS value FROM (SELECT DISTINCT ticker FROM px) WHERE ticker NOT IN (
  SELECT ticker FROM pan WHERE price IS NOT NULL GROUP BY ticker HAVING COUNT(*) >= 126 AND MAX(pos) >= (SELECT MAX(pos) FROM bdays) - 5)
UNION ALL SELECT 'fundamentals_lag_days', '90'
UNION ALL SELECT 'kept_tickers', CAST(COUNT(*) AS VARCHAR) FROM (
  SELECT ticker FROM pan WHERE price IS NOT NULL GROUP BY ticker HAVING COUNT(*) >= 126 AND MAX(pos) >= (SELECT MAX(pos) FROM bdays) - 5)""")
def load_bundle(spark, d):
    from ..plans.research import load_bundle as load
    return load(spark, d)["data_integrity"].where(F.col("item") != "source")


@query("s18_etf_bundle", "date ticker price:5", """
SELECT date, ticker, price FROM pan WHERE ticker IN (SELECT ticker FROM univ WHERE asset_class = 'fibra')
UNION ALL
SELECT b.date, t.ticker, last_value(p.price IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY b.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
FROM bdays b CROSS JOIN (SELECT DISTINCT ticker FROM bnd) t LEFT JOIN bnd p ON p.date = b.date AND p.ticker = t.ticker""")
def etf_bundle(spark, d):
    from ..plans.research import load_etf_bundle
    return load_etf_bundle(spark, d)["panel"]


@query("s19_parquet_sink", "year ticker rows", "SELECT CAST(year(date) AS INT) AS year, ticker, COUNT(*) AS rows FROM px GROUP BY 1, 2")
def parquet_sink(spark, d):
    path = f"{shared_dir(spark)}/sink-{spark.sparkContext.applicationId}-{crc32(d.encode())}"
    sinks.write_table(warehouse.prices(spark, d).withColumn("year", F.year("date")), path, ["year"])
    return spark.read.parquet(path).groupBy("year", "ticker").agg(F.count(F.lit(1)).alias("rows"))


@query("s20_sector_weight_json", "as_of source sector weight:6", """
SELECT CAST(LAST_DAY(MAX(date) OVER ()) AS VARCHAR) AS as_of, 'warehouse' AS source, sector, weight FROM (
  SELECT u.sector, SUM(u.market_cap) / (SELECT SUM(market_cap) FROM univ) AS weight, (SELECT MAX(date) FROM px) AS date FROM univ u GROUP BY u.sector)""")
def sector_weight_json(spark, d):
    uni = warehouse.universe(spark, d)
    end = warehouse.prices(spark, d).agg(F.max("date")).scalar()
    total = uni.agg(F.sum("market_cap")).scalar()
    weights = uni.groupBy("sector").agg((F.sum("market_cap") / total).alias("weight")).withColumn("as_of", F.last_day(end).cast("string"))
    path = f"{shared_dir(spark)}/anchor-{spark.sparkContext.applicationId}-{crc32(d.encode())}"
    sinks.write_json(sinks.sector_weight_records(weights, "warehouse"), path)
    return sinks.read_sector_weights(spark, path)


def _trial_params(spark, d):
    """Trial rows from the events table: value per (user bucket) plus text parameters."""
    e = warehouse.read(spark, d, "events").groupBy((F.col("user_id") % 20).alias("trial_id")).agg(F.avg("value").alias("value"))
    names = ["bl_tau", "mv_risk_aversion", "max_position"]
    return (e.withColumn("source", F.when(F.col("trial_id") % 2 == 0, "even").otherwise("odd"))
            .withColumn("param", F.explode(F.array(*[F.lit(n) for n in names])))
            .withColumn("param_value", F.concat("param", F.lit("="), F.col("trial_id").cast("string"))))


@query("s21_trial_history_json", "source trial_id param param_value value:6", """
SELECT CASE WHEN trial_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, trial_id, p AS param, p || '=' || trial_id AS param_value, value
FROM (SELECT user_id % 20 AS trial_id, AVG(value) AS value FROM events GROUP BY 1) CROSS JOIN (SELECT unnest(['bl_tau', 'mv_risk_aversion', 'max_position']) AS p)""")
def trial_history_json(spark, d):
    path = f"{shared_dir(spark)}/history-{spark.sparkContext.applicationId}-{crc32(d.encode())}"
    sinks.write_json(_trial_params(spark, d), path)
    return spark.read.schema("source string, trial_id bigint, param string, param_value string, value double").json(path)


@query("s22_best_parameters", "source param param_value", """
SELECT source, p AS param, p || '=' || trial_id AS param_value FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY value DESC, trial_id) AS rn FROM (
    SELECT user_id % 20 AS trial_id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, AVG(value) AS value FROM events GROUP BY 1, 2))
CROSS JOIN (SELECT unnest(['bl_tau', 'mv_risk_aversion']) AS p) WHERE rn = 1""")
def best_parameters(spark, d):
    return sinks.best_parameters(_trial_params(spark, d))


# ------------------------------------------------------------------ predicates and fills


@query("p01_derived_scores", "date ticker value_score:8 quality_score:9 macro_exposure:6",
       "SELECT date, ticker, value_score, quality_score, macro_exposure FROM fm WHERE asset_class = 'equity'")
def derived_scores(spark, d):
    x = base.feature_inputs(spark, d)
    return features.equity_features(x["panel"], x["fundamentals"], x["macro"], x["universe"])


@query("p02_investable_filter", "ticker asset_class", "SELECT ticker, asset_class FROM univ WHERE investable AND asset_class IN ('equity', 'fibra')")
def investable_filter(spark, d):
    return quality.investable(warehouse.universe(spark, d))


@query("p03_drop_null_subset", "ticker n", "SELECT ticker, COUNT(*) AS n FROM sigok GROUP BY ticker")
def drop_null_subset(spark, d):
    return features.price_signals(warehouse.price_panel(spark, d)).dropna(subset=["momentum_63", "volatility_63"]).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("p04_history_branch", "branch n", """
SELECT 'history' AS branch, COUNT(*) AS n FROM feq
UNION ALL SELECT 'snapshot', COUNT(*) FROM sigok s JOIN univ u ON u.ticker = s.ticker AND u.asset_class = 'equity'""")
def history_branch(spark, d):
    """Real report history fills gaps; a snapshot dated after the panel leaves prices only."""
    x = base.feature_inputs(spark, d)
    late = x["fundamentals"].withColumn("date", F.lit("2100-01-01").cast("date"))
    count = lambda reports, name: features.equity_features(x["panel"], reports, x["macro"], x["universe"]).agg(
        F.lit(name).alias("branch"), F.count(F.lit(1)).alias("n"))
    return count(x["fundamentals"], "history").unionByName(count(late, "snapshot"))


@query("p05_masked_fill", "asset_class n_default pe_sum:4", """
SELECT u.asset_class, COUNT(*) FILTER (WHERE u.asset_class = 'equity' AND f.pe_ratio IS NULL) AS n_default,
  SUM(CASE WHEN u.asset_class = 'equity' THEN COALESCE(f.pe_ratio, 14) ELSE f.pe_ratio END) AS pe_sum
FROM sigok s JOIN univ u ON u.ticker = s.ticker ASOF LEFT JOIN fund_lag f ON s.ticker = f.ticker AND s.date >= f.known GROUP BY u.asset_class""")
def masked_fill(spark, d):
    x = base.feature_inputs(spark, d)
    sig = features.price_signals(x["panel"]).where(F.col("momentum_63").isNotNull() & F.col("volatility_63").isNotNull())
    df = joins.asof_join(sig, x["fundamentals"], ["ticker"], ["pe_ratio"], horizon=features.last_date(x["panel"]))
    df = df.join(x["universe"].select("ticker", "asset_class"), "ticker")
    equity = F.col("asset_class") == "equity"
    filled = F.when(equity, F.coalesce("pe_ratio", F.lit(14.0))).otherwise(F.col("pe_ratio"))
    return df.groupBy("asset_class").agg(F.count_if(equity & F.col("pe_ratio").isNull()).alias("n_default"), F.sum(filled).alias("pe_sum"))


_GAPPY = "SELECT date, ticker, CASE WHEN pe_ratio > 26 THEN NULL ELSE pe_ratio END AS pe_ratio, CAST(NULL AS DOUBLE) AS ebitda_growth FROM fund"


@query("p06_median_fill", "date ticker pe_ratio:8 ebitda_growth:6", f"""
SELECT date, ticker, COALESCE(pe_ratio, (SELECT median(pe_ratio) FROM ({_GAPPY}))) AS pe_ratio, 0.05 AS ebitda_growth FROM ({_GAPPY})""")
def median_fill(spark, d):
    gappy = warehouse.fundamentals(spark, d).select(
        "date", "ticker", F.when(F.col("pe_ratio") <= 26, F.col("pe_ratio")).alias("pe_ratio"), "ebitda_growth")
    return quality.fill_with_median(gappy, {"pe_ratio": 14.0, "ebitda_growth": 0.05})


@query("p07_percent_units", "date usd_mxn:6 banxico_rate:6", """
SELECT date, CASE WHEN (SELECT median(abs(usd_mxn)) FROM mac) > 1 THEN usd_mxn / 100 ELSE usd_mxn END AS usd_mxn,
  CASE WHEN (SELECT median(abs(banxico_rate * 100)) FROM mac) > 1 THEN banxico_rate ELSE banxico_rate * 100 END AS banxico_rate FROM mac""")
def percent_units(spark, d):
    raw = warehouse.macro(spark, d).select("date", "usd_mxn", (F.col("banxico_rate") * 100.0).alias("banxico_rate"))
    return quality.percent_to_decimal(raw, ["usd_mxn", "banxico_rate"])


@query("p08_min_history", "ticker n_prices last_price_date usable", """
SELECT ticker, COUNT(price) AS n_prices, MAX(date) AS last_price_date, COUNT(price) >= 126 AND MAX(pos) >= (SELECT MAX(pos) FROM bdays) - 5 AS usable
FROM pan WHERE price IS NOT NULL GROUP BY ticker""")
def min_history(spark, d):
    return quality.price_history(warehouse.price_panel(spark, d))


@query("p09_liquidity_filter", "ticker liquidity_score:6", """
SELECT ticker, liquidity_score FROM univ WHERE NOT (liquidity_score < (SELECT quantile_cont(liquidity_score, 0.2) FROM univ))""")
def liquidity_filter(spark, d):
    return quality.drop_illiquid(warehouse.universe(spark, d))


@query("p10_finite_clean", "ticker n_clean clean_sum:4", """
SELECT ticker, COUNT(*) FILTER (WHERE volume > 10) AS n_clean, SUM(CASE WHEN volume > 10 THEN price END) AS clean_sum FROM px GROUP BY ticker""")
def finite_clean(spark, d):
    dirty = F.when(F.col("volume") > 10, F.col("price")).when(F.col("volume") > 5, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return warehouse.prices(spark, d).select("ticker", S.finite(dirty).alias("x")).groupBy("ticker").agg(
        F.count("x").alias("n_clean"), F.sum("x").alias("clean_sum"))


@query("p11_inverse_rate", "date ticker earnings_yield:6", "SELECT date, ticker, 1 / NULLIF(pe_ratio, 0) AS earnings_yield FROM fund")
def inverse_rate(spark, d):
    return warehouse.fundamentals(spark, d).withColumn("earnings_yield", S.inverse_rate("pe_ratio"))


@query("p12_publication_lag", "date ticker roe:9", "SELECT known AS date, ticker, roe FROM fund_lag")
def publication_lag(spark, d):
    return quality.publication_lag(warehouse.fundamentals(spark, d))


@query("p13_union_missing_columns", "asset_class n n_cap_rate n_carry",
       "SELECT asset_class, COUNT(*) AS n, SUM(has_cap)::BIGINT AS n_cap_rate, SUM(has_carry)::BIGINT AS n_carry FROM (SELECT asset_class, 0 AS has_cap, 0 AS has_carry FROM feq UNION ALL SELECT asset_class, 1, 0 FROM ffi UNION ALL SELECT asset_class, 0, CASE WHEN carry IS NULL THEN 0 ELSE 1 END FROM fbo) GROUP BY asset_class")
def union_missing_columns(spark, d):
    return base.feature_table(spark, d).groupBy("asset_class").agg(
        F.count(F.lit(1)).alias("n"), F.count("cap_rate").alias("n_cap_rate"), F.count("carry").alias("n_carry"))


@query("p14_risk_free_rate", "risk_free_rate:8",
       "SELECT CASE WHEN banxico_rate > 1 THEN banxico_rate / 100 ELSE banxico_rate END AS risk_free_rate FROM mac WHERE date = (SELECT MAX(date) FROM mac WHERE banxico_rate IS NOT NULL)")
def risk_free_rate(spark, d):
    return quality.last_policy_rate(warehouse.macro(spark, d))


@query("p15_searchable_keys", "source trial_id param", """
SELECT CASE WHEN trial_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, trial_id, p AS param
FROM (SELECT DISTINCT user_id % 20 AS trial_id FROM events) CROSS JOIN (SELECT unnest(['bl_tau', 'mv_risk_aversion']) AS p)""")
def searchable_keys(spark, d):
    asked = ["bl_tau", "mv_risk_aversion", "max_position"]
    return quality.searchable_parameters(_trial_params(spark, d), asked, REGULATED_KEYS)


# ------------------------------------------------------------------ features


@query("f01_equity_features", "date ticker price:4 momentum_63:6 momentum_126:6 volatility_63:6 pe_ratio:8 roe:9 ebitda_growth:6 usd_mxn:6 industrial_production_yoy:6 value_score:8",
       "SELECT *, -0.5 * pe_ratio - 0.5 * pb_ratio AS value_score FROM feq")
def equity_features(spark, d):
    x = base.feature_inputs(spark, d)
    return features.equity_features(x["panel"], x["fundamentals"], x["macro"], x["universe"])


@query("f02_fibra_features", "date ticker momentum_63:6 volatility_63:6 cap_rate:9 ltv:9 value_score:9 quality_score:9 macro_exposure:6", """
SELECT *, cap_rate AS value_score, ffo_yield - vacancy_rate - 0.15 * ltv AS quality_score,
  0.5 * COALESCE(exports_yoy, 0) - 0.2 * COALESCE(banxico_rate, 0) + 0.2 * COALESCE(inflation_yoy, 0) AS macro_exposure FROM ffi""")
def fibra_features(spark, d):
    x = base.feature_inputs(spark, d)
    return features.fibra_features(x["panel"], x["fibra_reports"], x["macro"], x["universe"])


@query("f03_fixed_income_features", "date ticker dv01:6 carry:6 banxico_sensitivity:6 volatility:6 value_score:8 quality_score:9 macro_exposure:6 liquidity_score:2", """
SELECT *, COALESCE(dv01, 0) AS volatility, COALESCE(carry, 0) AS value_score, -credit_spread - 0.02 * duration AS quality_score,
  -duration * COALESCE(banxico_sensitivity, 0) AS macro_exposure, 1.0 AS liquidity_score FROM fbo""")
def fixed_income_features(spark, d):
    return features.fixed_income_features(warehouse.bonds(spark, d), warehouse.macro(spark, d))


@query("f04_etf_features", "date ticker momentum_63:6 value_score:8 quality_score:9 macro_exposure:6", """
SELECT s.date, s.ticker, momentum_63, 0.0 AS value_score, 0.0 AS quality_score, COALESCE(industrial_production_yoy, 0) + 0.5 * COALESCE(exports_yoy, 0) AS macro_exposure
FROM sigok s ASOF LEFT JOIN mac m ON s.date >= m.date
UNION ALL SELECT date, ticker, NULL, COALESCE(carry, 0), -credit_spread - 0.02 * duration, -duration * COALESCE(banxico_sensitivity, 0) FROM fbo""")
def etf_features(spark, d):
    x = base.feature_inputs(spark, d)
    government = x["bonds"].select("ticker").distinct().withColumns({"asset_class": F.lit("fixed_income"), "investable": F.lit(True)})
    return features.etf_features(x["panel"], x["macro"], x["universe"].unionByName(government, allowMissingColumns=True), x["bonds"])


@query("f05_signal_matrix", "date ticker asset_class value_score:9 quality_score:9 macro_exposure:6",
       "SELECT * FROM fm")
def signal_matrix(spark, d):
    return features.signal_matrix(**base.feature_inputs(spark, d))


@query("f06_composite_score", "date ticker composite_score:6", "SELECT * FROM scored")
def composite_score(spark, d):
    return features.score_cross_section(base.feature_table(spark, d))


@query("f07_adtv_scores", "method ticker adtv:4 liquidity_score:6", """
WITH v AS (SELECT ticker, (SELECT MAX(pos) FROM bdays) - pos AS age, price * volume AS x FROM pan WHERE price IS NOT NULL AND pos > (SELECT MAX(pos) FROM bdays) - 252),
e AS (SELECT ticker, MIN(age) AS a0, MAX(age) AS a1 FROM v GROUP BY ticker),
a AS (SELECT 'ewma' AS method, v.ticker, CASE WHEN COUNT(*) >= 60 THEN SUM(x * pow(0.97, age - a0) * CASE WHEN age = a1 THEN 1 ELSE 0.03 END) END AS adtv FROM v JOIN e ON v.ticker = e.ticker GROUP BY v.ticker
  UNION ALL SELECT 'uniform', ticker, AVG(x) FROM v GROUP BY ticker)
SELECT method, ticker, adtv, (adtv - MIN(adtv) OVER (PARTITION BY method)) / (MAX(adtv) OVER (PARTITION BY method) - MIN(adtv) OVER (PARTITION BY method)) AS liquidity_score FROM a""")
def adtv_scores(spark, d):
    p = warehouse.price_panel(spark, d)
    one = lambda m: quality.adtv_scores(p, method=m).withColumn("method", F.lit(m))
    return one("ewma").unionByName(one("uniform"))


@query("f08_rebalance_dates", "date", "SELECT date FROM mends")
def rebalance_dates(spark, d):
    return features.month_end_dates(warehouse.price_panel(spark, d))


@query("f09_training_dates", "asset_class date", "SELECT asset_class, MAX(date) AS date FROM fm GROUP BY asset_class, date_trunc('month', date)")
def training_dates(spark, d):
    return base.feature_table(spark, d).groupBy("asset_class", F.trunc("date", "MM").alias("m")).agg(F.max("date").alias("date"))


@query("f10_bonds_from_yields", "date ticker price:6 ytm:6 duration:6", """
SELECT date, ticker, CASE WHEN y <= 0 THEN 100 ELSE 100 * c * (1 - pow(1 + y, -n)) / y + 100 * pow(1 + y, -n) END AS price, y AS ytm, dur AS duration FROM (
  SELECT date, t.ticker, t.n, t.c, t.dur, banxico_rate AS y FROM macro_lv CROSS JOIN
    (VALUES ('CETES28', 28 / 365.0::DOUBLE, 0.0, 28 / 365.0::DOUBLE), ('MBONO3Y', 3.0, 0.075, 2.7), ('MBONO10Y', 10.0, 0.085, 7.5)) t(ticker, n, c, dur))""")
def bonds_from_yields(spark, d):
    m = warehouse.macro_levels(spark, d)
    series = F.explode(F.array(F.lit("SF43936"), F.lit("SF43773"), F.lit("SF43775")))
    return payloads.bonds_from_yields(m.select("date", (F.col("banxico_rate") * 100.0).alias("value"), series.alias("series_id")))


@query("f11_year_on_year", "date industrial_production_yoy:6 exports_yoy:6 inflation_yoy:6 us_ip_yoy:6", "SELECT * FROM mac")
def year_on_year(spark, d):
    m = warehouse.macro_levels(spark, d)
    for level, out in (("activity_level", "industrial_production_yoy"), ("exports_level", "exports_yoy"),
                       ("inflation_level", "inflation_yoy"), ("us_ip_level", "us_ip_yoy")):
        m = payloads.yoy(m, level, out)
    return m
