"""Point-in-time and interval joins as plain equi-joins.

Backward as-of joins turn the *right* side into validity intervals ``[date, next date)`` with
one ``lead`` per key, spread each interval over the calendar months it touches and
equi-join on (keys, month).  The (large) left side is neither sorted nor windowed, a small
right side is broadcast by the planner after its size is known, and a hot key on the left is
split by the planner's skew-join rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAR = "2262-01-01"


def validity_intervals(right: DataFrame, keys: Sequence[str], date: str = "date", payload: Sequence[str] = ()) -> DataFrame:
    """Each row valid from its date until the next row of its key; the last duplicate wins."""
    tie = [F.col(c).asc_nulls_first() for c in payload]
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.col(date).asc(), *tie)
    ends = right.where(F.col(date).isNotNull()).withColumn("_until", F.lead(date).over(w))
    return ends.where(F.col("_until").isNull() | (F.col("_until") > F.col(date)))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str],
              date: str = "date", horizon: Column | None = None) -> DataFrame:
    """Left rows plus the ``columns`` of the latest right row with ``right.date <= left.date``.

    The whole matched row is taken: a NULL inside it stays NULL.  ``horizon`` is the last
    left date; by default a scalar subquery over the left table.
    """
    if horizon is None:
        horizon = left.agg(F.max(date)).scalar()
    right = right.select(*keys, F.col(date).alias("_from"), *columns)
    spans = validity_intervals(right, keys, "_from", columns)
    last = F.coalesce(F.date_sub("_until", 1), horizon)
    months = F.explode(F.sequence(F.trunc("_from", "MM"), F.trunc(last, "MM"), F.expr("interval 1 month")))
    spread = spans.where(F.col("_from") <= last).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], months.alias("_month"), "_from",
        F.coalesce("_until", F.lit(FAR).cast("date")).alias("_until"),
        *[F.col(c).alias(f"_r_{c}") for c in columns],
    )
    cond = (F.trunc(left[date], "MM") == spread["_month"]) & (left[date] >= spread["_from"]) & (left[date] < spread["_until"])
    for k in keys:
        cond = cond & (left[k] == spread[f"_k_{k}"])
    kept = [c for c in left.columns if c not in set(columns)]
    return left.join(spread, cond, "left").select(
        *[left[c] for c in kept], *[spread[f"_r_{c}"].alias(c) for c in columns],
    )


def asof_by_window(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], date: str = "date") -> DataFrame:
    """As-of join by union and ``last(struct)``; useful when both sides share a sort already."""
    payload = F.struct(*columns)
    a = left.withColumn("_src", F.lit(1)).withColumn("_row", F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType))
    b = right.select(*keys, date, F.lit(0).alias("_src"), payload.alias("_row"))
    w = Window.partitionBy(*keys).orderBy(date, "_src").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_hit", F.last("_row", ignorenulls=True).over(w))
    kept = [c for c in left.columns if c not in set(columns)]
    return both.where(F.col("_src") == 1).select(*kept, *[F.col(f"_hit.{c}").alias(c) for c in columns])


def hold_spans(weights: DataFrame, horizon: Column) -> DataFrame:
    """(strategy_id, rebalance_date, until): each strategy holds a book until its own next one."""
    w = Window.partitionBy("strategy_id").orderBy("date")  # one row per book date of a strategy
    spans = weights.select("strategy_id", "date").distinct().withColumn("until", F.coalesce(F.lead("date").over(w), horizon))
    return spans.where(F.col("until") > F.col("date")).withColumnRenamed("date", "rebalance_date")


def hold_days(spans: DataFrame) -> DataFrame:
    """Every weekday of each (..., rebalance_date, until): new weights earn from the day after their
    rebalance through the next rebalance day."""
    days = F.explode(F.sequence(F.date_add("rebalance_date", 1), F.col("until"), F.expr("interval 1 day")))
    return spans.withColumn("date", days).where(F.weekday("date") < 5)


def windows_of_dates(dates: DataFrame, asof: DataFrame, rows: int, pos: str = "pos") -> DataFrame:
    """(date, as-of date) pairs where the date is one of the last ``rows`` trading rows.

    Each as-of date explodes its own row positions and equi-joins on the position.
    """
    wanted = asof.select(F.col("date").alias("as_of"), F.col(pos).alias("_end")).withColumn(
        pos, F.explode(F.sequence(F.col("_end") - (rows - 1), F.col("_end"))))
    return wanted.join(dates.select("date", pos), pos).select(
        "as_of", "date", (F.col("_end") - F.col(pos)).alias("age"))


def label_intervals(df: DataFrame, spans: DataFrame, start: str, end: str, labels: Sequence[str], date: str = "date") -> DataFrame:
    """Attach every span label whose closed interval holds the row's date (spans may overlap).

    Spans are expanded to days, so this is a hash join on the date.
    """
    days = spans.select(*labels, F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias(date))
    return df.join(days, date)


def combine_first(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Union of keys; left values first, gaps from the right."""
    joined = left.alias("l").join(right.alias("r"), list(keys), "full")
    return joined.select(*keys, *[F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in columns])


def lookup_or_self(df: DataFrame, lookup: DataFrame, key: str, value: str, own: str) -> DataFrame:
    """Replace ``own`` by the mapped value where the key is known."""
    mapped = lookup.select(key, F.col(value).alias("_mapped"))
    return df.join(mapped, key, "left").withColumn(own, F.coalesce("_mapped", own)).drop("_mapped")


def keep_tickers(df: DataFrame, chosen: DataFrame) -> DataFrame:
    return df.join(chosen.select("ticker"), "ticker", "left_semi")


def drop_tickers(df: DataFrame, excluded: DataFrame) -> DataFrame:
    return df.join(excluded.select("ticker"), "ticker", "left_anti")
