"""Star-schema tables -> research tables.

The raw fact table is read once: a single shuffle join with the product dimension,
pre-aggregated to one row per (date, ticker).  Prices and quarterly fundamentals both come
from those daily sums, so the raw data is never scanned twice.  The daily table is staged in
the shared folder, and every later operator reads that columnar copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..session import stage_once
from . import panel
from .payloads import yoy


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def daily_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker) sums of the fact table: one shuffle join, then a partial/final aggregate."""
    items = read(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        F.col("l_shipdate").cast("date").alias("date"),
    )
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    return items.join(parts, items.l_partkey == parts.p_partkey).groupBy("date", "ticker").agg(
        F.sum("l_extendedprice").alias("ext_sum"),
        F.sum("l_quantity").alias("qty_sum"),
        F.sum("l_discount").alias("disc_sum"),
        F.sum("l_tax").alias("tax_sum"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned_n"),
        F.count(F.lit(1)).alias("n"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_once(spark, sf_dir, "cells", lambda: daily_cells(spark, sf_dir))


def prices_from_cells(daily: DataFrame) -> DataFrame:
    """Observed cells with a return-like index price (log unit price, centred and damped)."""
    raw = daily.select("date", "ticker", (F.col("ext_sum") / F.col("qty_sum")).alias("raw_price"),
                       F.col("qty_sum").alias("volume"))
    whole = Window.partitionBy("ticker")
    up_to = whole.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    step = F.lit(0.01) * (F.ln("raw_price") - F.avg(F.ln("raw_price")).over(whole))
    return (raw.withColumn("step", step)
            .withColumn("price", F.lit(100.0) * F.exp(F.sum("step").over(up_to))).drop("step"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed cells (gaps where nothing traded): date, ticker, raw_price, volume, price."""
    return stage_once(spark, sf_dir, "prices", lambda: prices_from_cells(cells(spark, sf_dir)))


def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense business-day panel: date, ticker, price (filled up to 5 rows), volume."""
    def build():
        observed = prices(spark, sf_dir).select("date", "ticker", "price", "volume")
        dense = panel.dense_prices(observed)
        return dense.withColumn("volume", F.coalesce("volume", F.lit(0.0))).select("date", "ticker", "price", "volume")
    return stage_once(spark, sf_dir, "panel", build)


def _brand_number() -> F.Column:
    return F.substring("p_brand", 7, 4).cast("int")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ticker; ``liquidity_score`` is the min-max rank of traded value."""
    def build():
        k = _brand_number()
        sector = (F.when(k % 5 == 0, "FIBRA").when(k % 5 == 1, "Logistics")
                  .when(k % 5 == 2, "Infrastructure").otherwise("Industrial"))
        base = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("market_cap"))
        base = base.select(
            F.col("p_brand").alias("ticker"), F.concat(F.lit("Name "), "p_brand").alias("name"), sector.alias("sector"),
            F.when(k % 5 == 0, "fibra").otherwise("equity").alias("asset_class"), F.lit(True).alias("investable"),
            (k % 10 / F.lit(10.0)).alias("usd_exposure"), "market_cap",
            F.concat(F.lit("ISS"), (k % 12).cast("string")).alias("issuer_id"),
            F.when(k % 16 == 0, F.lit(0.04)).alias("max_position_override"),
        )
        traded = prices(spark, sf_dir).groupBy("ticker").agg(F.avg(F.col("price") * F.col("volume")).alias("traded"))
        low, high = traded.agg(F.min("traded")).scalar(), traded.agg(F.max("traded")).scalar()
        scored = traded.select("ticker", ((F.col("traded") - low) / F.nullif(high - low, F.lit(0.0))).alias("liquidity_score"))
        return base.join(scored, "ticker", "left")
    return stage_once(spark, sf_dir, "universe", build)


def quarterly(daily: DataFrame) -> DataFrame:
    """Quarter sums per ticker, dated at the month-end of the last cell in the quarter."""
    return daily.groupBy("ticker", F.trunc("date", "quarter").alias("q")).agg(
        F.last_day(F.max("date")).alias("date"),
        *[F.sum(c).alias(c) for c in ("qty_sum", "disc_sum", "tax_sum", "returned_n", "n")],
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quarterly(cells(spark, sf_dir))
    n = F.col("n").cast("double")
    return q.select(
        "date", "ticker", (F.col("qty_sum") / n).alias("pe_ratio"),
        (F.lit(1.0) + F.lit(10.0) * F.col("disc_sum") / n).alias("pb_ratio"),
        (F.lit(3.0) * F.col("tax_sum") / n).alias("roe"), (F.col("disc_sum") / n).alias("profit_margin"),
        (F.lit(8.0) * F.col("returned_n") / n).alias("net_debt_to_ebitda"),
        F.lit(None).cast("double").alias("ebitda_growth"), (F.col("tax_sum") / n).alias("capex_to_sales"),
    )


def fibra_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quarterly(cells(spark, sf_dir))
    n = F.col("n").cast("double")
    return q.select(
        "date", "ticker", (F.lit(1.5) * F.col("disc_sum") / n).alias("cap_rate"),
        (F.lit(1.5) * F.col("tax_sum") / n).alias("ffo_yield"), (F.col("tax_sum") / n).alias("dividend_yield"),
        (F.lit(0.5) * F.col("returned_n") / n).alias("ltv"), (F.lit(0.5) * F.col("disc_sum") / n).alias("vacancy_rate"),
    )


def macro_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly level series from orders (one aggregate, no window)."""
    orders = read(spark, sf_dir, "orders")
    flag = lambda digit, hit: F.when(F.col("o_orderpriority").startswith(digit), F.lit(hit)).otherwise(F.lit(0.0))
    return orders.groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("date")).agg(
        F.count(F.lit(1)).cast("double").alias("activity_level"), F.sum("o_totalprice").alias("exports_level"),
        (F.avg("o_totalprice") / F.lit(10000.0)).alias("usd_mxn"), F.avg(flag("1", 0.2)).alias("banxico_rate"),
        F.avg(flag("2", 0.2)).alias("us_fed_rate"), F.avg("o_totalprice").alias("inflation_level"),
        F.sum(flag("3", 1.0)).alias("us_ip_level"), F.max("o_totalprice").alias("sp500"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        df = macro_levels(spark, sf_dir)
        for level, out in (("activity_level", "industrial_production_yoy"), ("exports_level", "exports_yoy"),
                           ("inflation_level", "inflation_yoy"), ("us_ip_level", "us_ip_yoy")):
            df = yoy(df, level, out)
        return df.select("date", F.col("activity_level").alias("IMAI"), "industrial_production_yoy", "exports_yoy",
                         "usd_mxn", "banxico_rate", "inflation_yoy", "us_ip_yoy", "us_fed_rate", "sp500")
    return stage_once(spark, sf_dir, "macro", build)


def bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly government-style bonds, one per order status."""
    orders = read(spark, sf_dir, "orders")
    years = F.when(F.col("status") == "F", 3.0).when(F.col("status") == "O", 5.0).otherwise(10.0)
    monthly = orders.groupBy(F.col("o_orderstatus").alias("status"),
                             F.last_day(F.col("o_orderdate").cast("date")).alias("date")).agg(
        (F.avg("o_totalprice") / F.lit(3000000.0)).alias("ytm"),
        (F.avg(F.when(F.col("o_orderpriority").startswith("1"), F.lit(0.05)).otherwise(F.lit(0.0)))).alias("credit_spread"),
    ).withColumn("years", years)
    return monthly.select(
        "date", F.concat(F.lit("BOND_"), "status").alias("ticker"), F.lit("fixed_income").alias("asset_class"),
        S.bond_price("ytm", F.lit(0.075), "years").alias("price"), "ytm",
        (F.col("years") * F.lit(0.9)).alias("duration"), "credit_spread",
    )
