"""Allocation views: forecasts, macro rules, blending."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import MACRO_SECTOR_RULES
from ..functions import windows as W
from .joins import asof_join


def forecast_views(forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean forecast per ticker; confidence .30 to .70 by absolute size (.50 when all equal)."""
    keys = list(keys)
    means = forecasts.groupBy(*keys, "ticker").agg(F.avg("expected_return").alias("view"))
    w = Window.partitionBy(*(keys or [F.lit(1)]))  # one row per listed name
    size, low, high = F.abs("view"), F.min(F.abs("view")).over(w), F.max(F.abs("view")).over(w)
    scaled = F.lit(0.30) + F.lit(0.40) * (size - low) / F.nullif(high - low, F.lit(0.0))
    return means.withColumn("confidence", F.when(high - low > 1e-9, scaled).otherwise(F.lit(0.50)))


def macro_signals(macro: DataFrame, asof: DataFrame | None = None, lag_rows: int = 21, min_periods: int = 24) -> DataFrame:
    """(date, signal, z): z-score of each macro signal against its earlier history.

    ``lag_rows`` counts macro rows (months).  ``asof`` restricts the dates returned.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("date")  # months of one macro history
    df = macro.withColumns({
        "banxico_rate_delta": W.diff("banxico_rate", w, lag_rows), "usd_mxn_mom": W.pct_change("usd_mxn", w, lag_rows)})
    names = [c for c in ("industrial_production_yoy", "exports_yoy", "us_ip_yoy", "inflation_yoy", "banxico_rate_delta", "usd_mxn_mom") if c in df.columns]
    scored = df.select("date", *[W.zscore_vs_history(c, w, min_periods).alias(c) for c in names])
    if asof is not None:
        scored = scored.join(asof.select("date"), "date", "left_semi")
    return scored.unpivot("date", names, "signal", "z")


def macro_views(macro: DataFrame, universe: DataFrame, confidence: float = 0.20, max_magnitude: float = 0.015,
                rules: Mapping[str, Mapping[str, float]] = MACRO_SECTOR_RULES, latest_only: bool = True) -> DataFrame:
    """Sector rule views plus a currency view for names with over 40 % dollar revenue."""
    spark = macro.sparkSession
    signals = macro_signals(macro)
    if latest_only:
        signals = signals.where(F.col("date") == macro.agg(F.max("date")).scalar())
    push = signals.withColumn("magnitude", F.lit(max_magnitude) * F.tanh("z"))
    table = spark.createDataFrame([(s, sec, float(x)) for s, m in rules.items() for sec, x in m.items()], "signal string, sector string, sign double")
    sector = push.join(F.broadcast(table), "signal").groupBy("date", "sector").agg(F.sum(F.col("sign") * F.col("magnitude")).alias("v"))
    by_sector = universe.select("ticker", "sector").join(sector, "sector").where(F.abs("v") > 1e-9).select("date", "ticker", "v")
    fx = push.where(F.col("signal") == "usd_mxn_mom").select("date", F.col("magnitude").alias("fx"))
    exposed = universe.where(F.col("usd_exposure") > 0.4).select("ticker", ((F.col("usd_exposure") - F.lit(0.4)) / F.lit(0.6)).alias("k"))
    # the currency magnitude is one row per date: it rides along as an array, not a cross join
    series = fx.agg(F.collect_list(F.struct("date", "fx")).alias("s"))
    by_fx = exposed.withColumn("p", F.explode(series.scalar())).select(F.col("p.date").alias("date"), "ticker", (F.col("k") * F.col("p.fx")).alias("v"))
    both = by_sector.unionByName(by_fx).groupBy("date", "ticker").agg(F.sum("v").alias("v"))
    m = float(max_magnitude)
    return both.select("date", "ticker", F.greatest(F.least("v", F.lit(m)), F.lit(-m)).alias("view"), F.lit(float(confidence)).alias("confidence"))


def views_in_force(dated: DataFrame, marks: DataFrame, dates: DataFrame) -> DataFrame:
    """For each of ``dates``, the views (date, ticker, ...) of the latest of ``marks`` (their dates) not after it."""
    known = marks.select("date").distinct().select("date", F.col("date").alias("_at"))
    held = asof_join(dates.select("date").distinct(), known, [], ["_at"])
    return held.where(F.col("_at").isNotNull()).join(dated.withColumnRenamed("date", "_at"), "_at").drop("_at")


def combine_views(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Confidence-weighted blend of (source, ticker, view, confidence); confidence is the maximum."""
    return rows.groupBy(*keys, "ticker").agg(
        (F.sum(F.col("view") * F.col("confidence")) / F.nullif(F.sum("confidence"), F.lit(0.0))).alias("view"),
        F.max("confidence").alias("confidence"), F.sum("confidence").alias("_c"),
    ).where(F.col("_c") > 1e-12).drop("_c")


def views_breakdown(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All views with their source; dated views keep their date."""
    dated = ["date"] if all("date" in df.columns for df in sources.values()) else []
    parts = [df.select(*dated, F.lit(name).alias("source"), F.col("ticker").alias("target"), F.col("view").alias("view_pct"), "confidence") for name, df in sources.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def market_weights(universe: DataFrame) -> DataFrame:
    total = universe.agg(F.sum("market_cap")).scalar()
    return universe.select("ticker", (F.col("market_cap") / (total + F.lit(1e-9))).alias("market_weight"))


def currency_adjusted(expected: DataFrame, universe: DataFrame, fx_return: float, hedge_ratio: float = 0.5) -> DataFrame:
    """Expected return plus unhedged dollar exposure x expected currency return."""
    exposure = universe.select("ticker", "usd_exposure")
    joined = expected.join(exposure, "ticker", "left")
    extra = F.coalesce("usd_exposure", F.lit(0.0)) * F.lit(1.0 - hedge_ratio) * F.lit(float(fx_return))
    return joined.withColumn("expected_return", F.col("expected_return") + extra).drop("usd_exposure")
