"""Provider plug-ins: objects that hand out conformed tables, found by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    BOND_COLUMNS, BOND_FIELDS, EQUITY_FUNDAMENTALS, FIBRA_FIELDS, FIBRA_FUNDAMENTALS,
    FUNDAMENTAL_FIELDS, MACRO_COLUMNS, MACRO_FIELDS,
)
from . import panel


class PanelProvider(Protocol):
    def prices(self, tickers, start, end) -> DataFrame: ...
    def volume(self, tickers, start, end) -> DataFrame: ...
    def fundamentals(self, tickers, start, end) -> DataFrame: ...
    def fibra_fundamentals(self, tickers, start, end) -> DataFrame: ...
    def bonds(self, tickers, start, end) -> DataFrame: ...
    def macro(self, start, end) -> DataFrame: ...
    def market_caps(self, tickers) -> DataFrame: ...


class LandedFiles:
    """Parquet landing folder: wide prices/volume, EAV or wide side tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def prices(self, tickers=None, start=None, end=None) -> DataFrame:
        return panel.wide_price_scan(self._read("prices"), tickers, start, end)

    def volume(self, tickers=None, start=None, end=None) -> DataFrame:
        return panel.wide_volume_scan(self._read("volume"), tickers, start, end)

    def _side_table(self, name, fields, columns, tickers, start, end) -> DataFrame:
        df = self._read(name)
        if {"field", "value"} <= set(df.columns):
            df = panel.eav_pivot(df, list(fields), start, end, tickers)
        else:
            df = panel.between_dates(df.withColumn("date", F.col("date").cast("date")), start, end)
            if tickers is not None:
                df = df.where(F.col("ticker").isin(list(tickers)))
        return panel.conform(panel.rename_fields(df, fields), panel.table_schema(columns))

    def fundamentals(self, tickers=None, start=None, end=None) -> DataFrame:
        return self._side_table("fundamentals", FUNDAMENTAL_FIELDS, EQUITY_FUNDAMENTALS, tickers, start, end)

    def fibra_fundamentals(self, tickers=None, start=None, end=None) -> DataFrame:
        return self._side_table("fibra_fundamentals", FIBRA_FIELDS, FIBRA_FUNDAMENTALS, tickers, start, end)

    def bonds(self, tickers=None, start=None, end=None) -> DataFrame:
        table = self._side_table("bonds", BOND_FIELDS, BOND_COLUMNS, tickers, start, end)
        return table.withColumn("asset_class", F.coalesce("asset_class", F.lit("fixed_income")))

    def macro(self, start=None, end=None) -> DataFrame:
        df = self._read("macro")
        if {"field", "value", "ticker"} <= set(df.columns):
            rows = df.select("date", F.col("ticker").alias("field"), "value")
            df = panel.rename_fields(panel.eav_pivot(rows, list(MACRO_FIELDS), start, end, keys=("date",)), MACRO_FIELDS)
        else:
            df = panel.between_dates(df.withColumn("date", F.col("date").cast("date")), start, end)
        return panel.conform(df, panel.table_schema(MACRO_COLUMNS, ("date",)))

    def market_caps(self, tickers=None) -> DataFrame:
        caps = self._read("market_caps").select("ticker", F.col("market_cap_mxn").try_cast("double").alias("market_cap"))
        return caps if tickers is None else caps.where(F.col("ticker").isin(list(tickers)))


_factories: dict[str, Callable[..., PanelProvider]] = {"landed": LandedFiles}


def register_provider(name: str, factory: Callable[..., PanelProvider]) -> None:
    _factories[name] = factory


def get_provider(name: str, *args, **kwargs) -> PanelProvider:
    if name not in _factories:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(_factories)}")
    return _factories[name](*args, **kwargs)
