"""Long-panel scans: wide and EAV landings, calendars, schema repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..constants import FORWARD_FILL_LIMIT
from ..functions import scalars as S
from ..functions import windows as W

PRICE_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()),
    T.StructField("price", T.DoubleType()),
])


def table_schema(columns: Sequence[str], keys: Sequence[str] = ("date", "ticker")) -> T.StructType:
    kinds = {"date": T.DateType(), "ticker": T.StringType(), "asset_class": T.StringType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in [*keys, *columns]])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select exactly ``schema``: coerce what exists (bad text -> NULL), add what is missing."""
    out = []
    for field in schema.fields:
        if field.name not in df.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif isinstance(field.dataType, T.DoubleType):
            out.append(S.finite(F.col(field.name).try_cast("double")).alias(field.name))
        else:
            out.append(F.col(field.name).try_cast(field.dataType).alias(field.name))
    return df.select(*out)


def between_dates(df: DataFrame, start: str | None, end: str | None, column: str = "date") -> DataFrame:
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("date"))
    return df


def unpivot_panel(wide: DataFrame, value: str, tickers: Sequence[str] | None = None,
                  start: str | None = None, end: str | None = None) -> DataFrame:
    """Wide date x ticker landing -> long rows; slicing happens before the unpivot."""
    columns = [c for c in wide.columns if c != "date" and (tickers is None or c in set(tickers))]
    cells = between_dates(wide.select(F.col("date").cast("date").alias("date"), *[F.col(f"`{c}`") for c in columns]), start, end)
    numeric = cells.select("date", *[S.finite(F.col(f"`{c}`").try_cast("double")).alias(c) for c in columns])
    return numeric.unpivot("date", [F.col(f"`{c}`") for c in columns], "ticker", value)


def wide_price_scan(wide: DataFrame, tickers=None, start=None, end=None, limit: int = FORWARD_FILL_LIMIT) -> DataFrame:
    long = unpivot_panel(wide, "price", tickers, start, end)
    return limited_fill(long, "price", limit)


def wide_volume_scan(wide: DataFrame, tickers=None, start=None, end=None) -> DataFrame:
    long = unpivot_panel(wide, "volume", tickers, start, end)
    return long.withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def limited_fill(df: DataFrame, value: str, limit: int | None, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date")
    return df.withColumn(value, W.forward_fill(value, w, limit))


def business_days(keys: DataFrame, start: Column, end: Column, every: str = "day") -> DataFrame:
    """One row per key and weekday (or month-end) between two dates.

    Rows come from ``explode(sequence)`` on each key row, so no join is needed.
    """
    if every == "month":
        firsts = F.explode(F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month")))
        return keys.withColumn("date", firsts).withColumn("date", F.last_day("date"))
    grid = keys.withColumn("date", F.explode(F.sequence(start, end, F.expr("interval 1 day"))))
    return grid.where(S.is_business_day("date"))


def date_bounds(df: DataFrame, start: str | None = None, end: str | None = None) -> tuple[Column, Column]:
    """First and last date as scalar subqueries unless fixed by the caller."""
    low = F.lit(start).cast("date") if start else df.agg(F.min("date")).scalar()
    high = F.lit(end).cast("date") if end else df.agg(F.max("date")).scalar()
    return low, high


def on_calendar(df: DataFrame, keys: Sequence[str] = ("ticker",), start: str | None = None,
                end: str | None = None, every: str = "day") -> DataFrame:
    """Reindex each key onto the full calendar; gaps show as NULL."""
    low, high = date_bounds(df, start, end)
    grid = business_days(df.select(*keys).distinct(), low, high, every)
    return grid.join(df, [*keys, "date"], "left")


def dense_prices(cells: DataFrame, start=None, end=None, limit: int = FORWARD_FILL_LIMIT) -> DataFrame:
    """Observed cells -> business-day panel, forward filled up to ``limit`` rows."""
    return limited_fill(on_calendar(cells, ("ticker",), start, end), "price", limit)


def eav_pivot(eav: DataFrame, fields: Sequence[str], start=None, end=None, tickers: Sequence[str] | None = None,
              keys: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """(date, ticker, field, value) -> one column per field.

    Duplicate cells have no row order on a cluster, so the smallest value is kept.

    The field list is given, so the pivot needs no extra pass to find distinct values and
    aggregates in one partial/final step.
    """
    rows = between_dates(eav.withColumn("date", F.col("date").cast("date")), start, end)
    if tickers is not None:
        rows = rows.where(F.col("ticker").isin(list(tickers)))
    numeric = rows.withColumn("value", S.finite(F.col("value").try_cast("double")))
    return numeric.groupBy(*keys).pivot("field", list(fields)).agg(F.min("value"))


def rename_fields(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def vendor_long(df: DataFrame, mapping: Mapping[str, str] | None = None, value: str = "value") -> DataFrame:
    """Vendor landing (long with a security column, or already wide) -> (date, ticker, value)."""
    date_col = next(c for c in df.columns if c.lower() == "date")
    security = next((c for c in df.columns if c.lower() in ("security", "ticker", "name")), None)
    if security is None:
        long = unpivot_panel(df.withColumnRenamed(date_col, "date"), value)
    else:
        others = [c for c in df.columns if c.lower() not in (security.lower(), "date", "field")]
        source = next((c for c in others if c.lower() == "value"), others[0])
        long = df.select(
            F.col(date_col).cast("date").alias("date"), F.trim(F.col(security)).alias("ticker"),
            S.finite(F.col(source).try_cast("double")).alias(value),
        )
    if mapping:
        lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        long = long.withColumn("ticker", F.coalesce(F.try_element_at(lookup, F.col("ticker")), F.col("ticker")))
    return long


def resolve_symbols(tickers: DataFrame, ticker_map: DataFrame, provider: str, suffix: str,
                    prefix_marks: Sequence[str] = (), contains_marks: Sequence[str] = ()) -> DataFrame:
    """Canonical ticker -> provider symbol.

    ``ticker_map`` rows: (canonical, provider, symbol, qualified).  A row with a NULL symbol
    drops the ticker; no row falls back to the canonical name.  The suffix is added unless
    the symbol is qualified already.
    """
    entries = ticker_map.where(F.col("provider") == provider).select(
        F.col("canonical").alias("ticker"), "symbol", F.coalesce("qualified", F.lit(False)).alias("qualified"),
        F.lit(True).alias("mapped"),
    )
    joined = tickers.select("ticker").join(entries, "ticker", "left")
    raw = F.trim(F.coalesce("symbol", "ticker"))
    done = F.coalesce(F.col("qualified"), F.lit(False)) | raw.endswith(suffix)
    for mark in prefix_marks:
        done = done | raw.startswith(mark)
    for mark in contains_marks:
        done = done | raw.contains(mark)
    kept = joined.where(~(F.coalesce("mapped", F.lit(False)) & F.col("symbol").isNull()))
    return kept.select("ticker", F.when(done | (F.lit(suffix) == ""), raw).otherwise(F.concat(raw, F.lit(suffix))).alias("symbol"))


def month_end_fill(reports: DataFrame, columns: Sequence[str], start=None, end=None) -> DataFrame:
    """Sparse reports -> month-end rows carrying the latest report (last duplicate wins)."""
    from ..operators.joins import asof_join

    latest = reports.groupBy("ticker", "date").agg(*[F.max_by(c, F.struct(*columns)).alias(c) for c in columns])
    low, high = date_bounds(reports, start, end)
    grid = business_days(reports.select("ticker").distinct(), low, high, "month")
    return asof_join(grid, latest, ["ticker"], columns)


def first_available(df: DataFrame, candidates: Sequence[str], out: str) -> DataFrame:
    """First non-empty among candidate fields, in order."""
    return df.withColumn(out, F.coalesce(*[S.finite(F.col(c)) for c in candidates]))


def source_fallback(primary: DataFrame, fallback: DataFrame, value: str = "price") -> DataFrame:
    """Per ticker: rows of ``fallback`` where ``primary`` has no usable value at all."""
    usable = primary.where(F.col(value).isNotNull())
    have = usable.select("ticker").distinct()
    return usable.unionByName(fallback.where(F.col(value).isNotNull()).join(have, "ticker", "left_anti"), allowMissingColumns=True)


def union_by_priority(sources: Sequence[DataFrame], value: str = "price") -> DataFrame:
    """Union of long sources; per (date, ticker) the first source with a value wins."""
    tagged = [s.select("date", "ticker", value).withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    union = tagged[0]
    for extra in tagged[1:]:
        union = union.unionByName(extra)
    return (union.where(F.col(value).isNotNull()).groupBy("date", "ticker")
            .agg(F.min_by(value, "_rank").alias(value)))


def read_index_folder(spark: SparkSession, folder: str, start=None, end=None) -> DataFrame:
    """One folder of (date, price) CSV files per ticker, named ``ticker=...`` -> dense business-day rows; tickers come from the folder names."""
    rows = spark.read.schema("date DATE, price DOUBLE, ticker STRING").option("header", True).csv(folder)
    return dense_prices(rows.select("date", "ticker", "price"), start, end)


def read_index_csv(spark: SparkSession, paths: Mapping[str, str], start=None, end=None) -> DataFrame:
    """One (date, price) CSV per ticker -> dense business-day rows."""
    schema = "date DATE, price DOUBLE"
    parts = [spark.read.schema(schema).option("header", True).csv(path).withColumn("ticker", F.lit(name))
             for name, path in paths.items()]
    union = parts[0]
    for extra in parts[1:]:
        union = union.unionByName(extra)
    return dense_prices(union.select("date", "ticker", "price"), start, end)
