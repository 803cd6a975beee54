"""Landed API payloads (JSON text) -> rows, and the month-end macro merge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import BOND_SERIES, BOND_TERMS, MACRO_COLUMNS
from ..functions import scalars as S
from ..functions import windows as W
from .panel import business_days, conform, date_bounds, table_schema

SERIES_SCHEMA = (
    "struct<bmx:struct<series:array<struct<idSerie:string,datos:array<struct<fecha:string,dato:string>>>>>>"
)
OBSERVATION_SCHEMA = "struct<Series:array<struct<OBSERVATIONS:array<struct<TIME_PERIOD:string,OBS_VALUE:string>>>>>"


def series_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Nested series payload with day-first dates and numbers as text -> (series_id, date, value)."""
    parsed = payloads.select(F.from_json(F.col(column), SERIES_SCHEMA).alias("j"))
    series = parsed.select(F.explode("j.bmx.series").alias("s"))
    points = series.select(F.col("s.idSerie").alias("series_id"), F.explode("s.datos").alias("p"))
    return points.select(
        "series_id",
        F.expr("try_to_date(p.fecha, 'dd/MM/yyyy')").alias("date"),
        F.regexp_replace("p.dato", ",", "").try_cast("double").alias("value"),
    )


def observation_rows(payloads: DataFrame, column: str = "payload", key: str = "indicator") -> DataFrame:
    """Single-series observation payload -> (indicator, date, value); periods are yyyy/MM or yyyy-MM."""
    parsed = payloads.select(key, F.from_json(F.col(column), OBSERVATION_SCHEMA).alias("j"))
    points = parsed.select(key, F.explode(F.get(F.col("j.Series"), F.lit(0))["OBSERVATIONS"]).alias("p"))
    period = F.regexp_replace(F.substring("p.TIME_PERIOD", 1, 7), "/", "-")
    return points.select(
        key,
        F.expr("try_to_date(substr(regexp_replace(p.TIME_PERIOD, '/', '-'), 1, 7), 'yyyy-MM')").alias("date"),
        F.col("p.OBS_VALUE").try_cast("double").alias("value"),
    ).where(period.isNotNull())


def month_last(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Last non-NULL observation of each month, labelled with the calendar month-end."""
    return (rows.where(F.col(value).isNotNull()).groupBy(*keys, F.last_day("date").alias("date_end"))
            .agg(F.max_by(value, "date").alias(value)).withColumnRenamed("date_end", "date"))


def month_rows_pivot(rows: DataFrame, names: Mapping[str, str], key: str) -> DataFrame:
    """Named series -> one month-end row with a column per canonical name."""
    monthly = month_last(rows.where(F.col(key).isin(list(names))), [key])
    wide = monthly.groupBy("date").pivot(key, list(names)).agg(F.max("value"))
    return wide.withColumnsRenamed(dict(names))


def yoy(df: DataFrame, level: str, out: str, lag_rows: int = 12, keys: Sequence[str] = ()) -> DataFrame:
    """Row-lagged growth of a monthly level series.

    Without keys the table is one macro series: its size is the number of months, so a
    single-partition window is bounded by the calendar.
    """
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("date")
    return df.withColumn(out, W.pct_change(level, w, lag_rows))


def merge_macro(sources: Sequence[DataFrame], start=None, end=None,
                prefer: Sequence[tuple[str, str]] = (("usd_mxn", "usd_mxn_banxico"),)) -> DataFrame:
    """Left-join month-end sources on a month calendar; fill preferred columns from fallbacks."""
    dates = sources[0].select("date")
    for extra in sources[1:]:
        dates = dates.unionByName(extra.select("date"))
    low, high = date_bounds(dates, start, end)
    one = sources[0].sparkSession.range(1)
    merged = business_days(one, low, high, "month").drop("id")
    for source in sources:
        merged = merged.join(source, "date", "left")
    for target, fallback in prefer:
        if fallback in merged.columns:
            base = F.col(target) if target in merged.columns else F.lit(None).cast("double")
            merged = merged.withColumn(target, F.coalesce(base, fallback)).drop(fallback)
    return conform(merged, table_schema(MACRO_COLUMNS, ("date",)))


def bonds_from_yields(rows: DataFrame) -> DataFrame:
    """Yield series (percent) -> priced month-end bond rows."""
    spark = rows.sparkSession
    terms = spark.createDataFrame(
        [(sid, name, float(BOND_TERMS[name]["maturity"]), float(BOND_TERMS[name]["duration"]),
          float(BOND_TERMS[name]["coupon_rate"])) for sid, name in BOND_SERIES.items()],
        "series_id string, ticker string, maturity double, duration double, coupon_rate double",
    )
    monthly = month_last(rows, ["series_id"])
    priced = monthly.join(F.broadcast(terms), "series_id").withColumn("ytm", F.col("value") / F.lit(100.0))
    return priced.select(
        "date", "ticker", F.lit("fixed_income").alias("asset_class"),
        S.bond_price("ytm", "coupon_rate", "maturity").alias("price"), "ytm", "duration",
        F.lit(0.0).alias("credit_spread"),
    )
