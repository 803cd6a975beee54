"""Filters, fills and data-quality rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import FORWARD_FILL_LIMIT, MIN_PRICE_HISTORY, PUBLICATION_LAG_DAYS
from ..functions import scalars as S
from ..functions import windows as W
from ..functions.quantiles import exact_quantile_scalar

RISKY = ("equity", "fibra")


def investable(universe: DataFrame, classes: Sequence[str] = RISKY) -> DataFrame:
    return universe.where(F.col("investable") & F.col("asset_class").isin(list(classes)))


def publication_lag(reports: DataFrame, days: int = PUBLICATION_LAG_DAYS) -> DataFrame:
    """Shift report dates to when they could be known; apply before any as-of join."""
    return reports.withColumn("date", F.date_add("date", days)) if days > 0 else reports


def fill_with_median(df: DataFrame, defaults: Mapping[str, float], allow_defaults: bool = True) -> DataFrame:
    """NULL / NaN / infinity -> column median, else the default, else left NULL."""
    for name, default in defaults.items():
        if name in df.columns:
            clean = S.finite(F.col(name))
            spare = F.lit(float(default)) if allow_defaults else F.lit(None).cast("double")
            df = df.withColumn(name, F.coalesce(clean, exact_quantile_scalar(df, clean, 0.5), spare))
    return df


def percent_to_decimal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide a rate column by 100 when the median of its absolute value exceeds 1."""
    source = df
    for name in columns:
        if name in df.columns:
            scale = exact_quantile_scalar(source, F.abs(F.col(name)), 0.5)
            df = df.withColumn(name, F.when(scale > 1.0, F.col(name) / F.lit(100.0)).otherwise(F.col(name)))
    return df


def price_history(panel: DataFrame, min_history: int = MIN_PRICE_HISTORY, stale_rows: int = FORWARD_FILL_LIMIT) -> DataFrame:
    """Per ticker: price count, last priced date, and whether the ticker is usable.

    A ticker needs ``min_history`` prices and one within ``stale_rows`` weekdays of the end.
    """
    end = panel.agg(F.max("date")).scalar()
    stats = panel.where(F.col("price").isNotNull()).groupBy("ticker").agg(
        F.count("price").alias("n_prices"), F.max("date").alias("last_price_date"))
    age = S.business_day_index(end) - S.business_day_index("last_price_date")
    return stats.withColumn("usable", (F.col("n_prices") >= min_history) & (age <= stale_rows))


def usable_panel(panel: DataFrame, **rules) -> DataFrame:
    return panel.join(price_history(panel, **rules).where("usable"), "ticker", "left_semi")


def liquidity_floor(universe: DataFrame, q: float = 0.20) -> Column:
    """Liquidity quantile of the risky sleeves, as a scalar subquery."""
    return exact_quantile_scalar(universe.where(F.col("asset_class").isin(*RISKY)), "liquidity_score", q)


def drop_illiquid(universe: DataFrame, q: float = 0.20) -> DataFrame:
    """Remove risky tickers under the quantile; other classes are exempt."""
    floor = F.coalesce(liquidity_floor(universe, q), F.lit(0.0))
    illiquid = F.col("asset_class").isin(*RISKY) & (F.col("liquidity_score") < floor)
    return universe.where(~F.coalesce(illiquid, F.lit(False)))


def last_policy_rate(macro: DataFrame, default: float = 0.02) -> DataFrame:
    """One row: the latest known policy rate, percent turned to decimal."""
    rate = F.coalesce(F.max_by("banxico_rate", F.when(F.col("banxico_rate").isNotNull(), F.col("date"))), F.lit(default))
    return macro.agg(rate.alias("rate")).select(
        F.when(F.col("rate") > 1.0, F.col("rate") / F.lit(100.0)).otherwise(F.col("rate")).alias("risk_free_rate"))


def searchable_parameters(params: DataFrame, allowed: Sequence[str], fixed: Sequence[str]) -> DataFrame:
    """Keep searchable keys; keys fixed by regulation never pass, whatever is asked."""
    return params.where(F.col("param").isin(list(allowed)) & ~F.col("param").isin(list(fixed)))


def minmax_score(df: DataFrame, value: str, out: str) -> DataFrame:
    """Min-max over the cross-section; a flat cross-section scores 1."""
    low, high = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    return df.withColumn(out, F.when(high - low < 1e-9, F.lit(1.0)).otherwise((F.col(value) - low) / F.nullif(high - low, F.lit(0.0))))


def adtv_scores(panel: DataFrame, window: int = 252, method: str = "ewma", decay: float = 0.97, min_periods: int = 60) -> DataFrame:
    """Traded-value liquidity score per ticker from the last ``window`` calendar rows.

    Only the value at the last row is needed, so the recursive average is one weighted
    sum per ticker: weight (1-decay) * decay^age, with decay^age for the oldest row.
    """
    end = panel.agg(F.max("date")).scalar()
    age = S.business_day_index(end) - S.business_day_index("date")
    traded = S.finite(F.col("price") * F.col("volume"))
    recent = panel.where(age < window).select("ticker", age.alias("age"), traded.alias("traded"))
    recent = recent.where(F.col("traded").isNotNull())
    if method == "ewma":
        # Decay runs from a ticker's own last value, the oldest value keeps the full remainder.
        own = Window.partitionBy("ticker")
        aged = recent.withColumn("oldest", F.max("age").over(own)).withColumn("newest", F.min("age").over(own))
        lag = F.col("age") - F.col("newest")
        weight = F.pow(F.lit(decay), lag) * F.when(F.col("age") == F.col("oldest"), F.lit(1.0)).otherwise(F.lit(1.0 - decay))
        stats = aged.groupBy("ticker").agg(
            F.sum(weight * F.col("traded")).alias("adtv"), F.count(F.lit(1)).alias("n"))
        stats = stats.withColumn("adtv", F.when(F.col("n") >= min_periods, F.col("adtv"))).drop("n")
    else:
        stats = recent.groupBy("ticker").agg(F.avg("traded").alias("adtv"))
    return minmax_score(stats, "adtv", "liquidity_score")
