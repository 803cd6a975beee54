"""Set-oriented walk-forward back-test over (strategy, date, ticker) weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions import windows as W
from ..sources.panel import business_days, date_bounds
from .joins import hold_days, hold_spans


def top_n(scores: DataFrame, value: str, n: int, strategy: str, descending: bool = True) -> DataFrame:
    """Equal weights on the best ``n`` names of each date; ties break on the ticker."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    w = Window.partitionBy("date").orderBy(order, "ticker")
    picked = scores.where(F.col(value).isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    size = F.count(F.lit(1)).over(Window.partitionBy("date"))
    return picked.select(F.lit(strategy).alias("strategy_id"), "date", "ticker", (F.lit(1.0) / size).alias("weight"))


def even_book(scores: DataFrame, value: str, strategy: str) -> DataFrame:
    """Equal weights on every name of a date that has a ``value``."""
    size = F.count(F.lit(1)).over(Window.partitionBy("date"))
    return scores.where(F.col(value).isNotNull()).select(F.lit(strategy).alias("strategy_id"), "date", "ticker", (F.lit(1.0) / size).alias("weight"))


def carry_forward(weights: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Give every strategy a book on every rebalance date: missing books repeat the last one.

    Only the (strategy, date) skeleton is windowed; weight rows are copied by equi-join.
    """
    have = weights.select("strategy_id", F.col("date").alias("book_date")).distinct()
    first = have.groupBy("strategy_id").agg(F.min("book_date").alias("_first"))
    w = Window.partitionBy("strategy_id").orderBy("book_date")
    spans = have.withColumn("_next", F.lead("book_date").over(w))
    # rebalance dates are a short list, so the range condition runs on skeleton rows only
    slots = rebalances.select("date").distinct()
    months = F.explode(F.sequence(F.trunc("book_date", "MM"), F.trunc(F.coalesce("_next", slots.agg(F.max("date")).scalar()), "MM"), F.expr("interval 1 month")))
    spread = spans.where(F.coalesce(F.col("_next"), slots.agg(F.max("date")).scalar()) >= F.col("book_date")).withColumn("_m", months)
    owned = slots.withColumn("_m", F.trunc("date", "MM")).join(spread, "_m").where(
        (F.col("date") >= F.col("book_date")) & (F.col("_next").isNull() | (F.col("date") < F.col("_next"))))
    books = weights.withColumnRenamed("date", "book_date")
    return owned.select("strategy_id", "book_date", "date").join(books, ["strategy_id", "book_date"]).drop("book_date")


def turnover(weights: DataFrame) -> DataFrame:
    """Sum of absolute weight changes per rebalance; a missing ticker counts as zero.

    Each weight is counted once as current and once as previous of the next book, so no
    per-ticker window or outer self-join is needed.
    """
    w = Window.partitionBy("strategy_id").orderBy("date")
    nexts = weights.select("strategy_id", "date").distinct().withColumn("_next", F.lead("date").over(w)).where(F.col("_next").isNotNull())
    now = weights.select("strategy_id", "date", "ticker", F.col("weight").alias("delta"))
    before = weights.join(nexts, ["strategy_id", "date"]).select(
        "strategy_id", F.col("_next").alias("date"), "ticker", (-F.col("weight")).alias("delta"))
    return (now.unionByName(before).groupBy("strategy_id", "date", "ticker").agg(F.sum("delta").alias("delta"))
            .groupBy("strategy_id", "date").agg(F.sum(F.abs("delta")).alias("turnover")))


def gross_returns(weights: DataFrame, returns: DataFrame, horizon: Column | None = None) -> DataFrame:
    """Daily sum of weight x return.

    Returns are tagged with the spans that hold their date and meet the books on (span, ticker).
    Strategies that rebalance on the same dates share spans, so returns are copied once per
    schedule; the strategy x date x ticker rows only exist between that join and the map-side aggregate.
    """
    if horizon is None:
        horizon = returns.agg(F.max("date")).scalar()
    spans = hold_spans(weights, horizon)
    tagged = returns.select("date", "ticker", "ret").join(hold_days(spans.select("rebalance_date", "until").distinct()), "date")
    books = weights.select("strategy_id", F.col("date").alias("rebalance_date"), "ticker", "weight").join(spans, ["strategy_id", "rebalance_date"])
    return tagged.join(books, ["rebalance_date", "until", "ticker"]).groupBy("strategy_id", "date").agg(
        F.sum(F.col("weight") * F.col("ret")).alias("gross_ret"))


def strategy_returns(weights: DataFrame, returns: DataFrame, cost: float = 0.001) -> DataFrame:
    """(strategy, date): net return and turnover on every trading day (0 before the first book)."""
    low, high = date_bounds(returns)
    days = business_days(weights.select("strategy_id").distinct(), low, high)
    gross = gross_returns(weights, returns, high)
    traded = turnover(weights)
    return (days.join(gross, ["strategy_id", "date"], "left").join(traded, ["strategy_id", "date"], "left")
            .select("strategy_id", "date", F.coalesce("turnover", F.lit(0.0)).alias("turnover"),
                    (F.coalesce("gross_ret", F.lit(0.0)) - F.lit(cost) * F.coalesce("turnover", F.lit(0.0))).alias("ret")))


def final_weights(weights: DataFrame) -> DataFrame:
    """The last book with any weight, per strategy."""
    gross = weights.groupBy("strategy_id", "date").agg(F.sum(F.abs("weight")).alias("_g")).where(F.col("_g") > 1e-9)
    last = gross.groupBy("strategy_id").agg(F.max("date").alias("date"))
    return weights.join(last, ["strategy_id", "date"])


def first_weights(weights: DataFrame) -> DataFrame:
    gross = weights.groupBy("strategy_id", "date").agg(F.sum(F.abs("weight")).alias("_g")).where(F.col("_g") > 1e-9)
    first = gross.groupBy("strategy_id").agg(F.min("date").alias("date"))
    return weights.join(first, ["strategy_id", "date"])


def drop_small_trades(weights: DataFrame, band: float = 0.0005) -> DataFrame:
    """No-trade band: a change under ``band`` keeps the previous weight.

    Path dependent, so each (strategy, ticker) folds its ordered targets; the fold length is
    the number of rebalances.
    """
    slots = weights.select("strategy_id", "date").distinct()
    names = weights.select("strategy_id", "ticker").distinct()
    series = slots.groupBy("strategy_id").agg(F.sort_array(F.collect_set("date")).alias("dates"))
    targets = weights.groupBy("strategy_id", "ticker").agg(
        F.map_from_entries(F.collect_list(F.struct("date", "weight"))).alias("targets"))
    folded = targets.join(series, "strategy_id")
    start = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("path"))

    def step(acc, day):
        target = F.coalesce(F.try_element_at(F.col("targets"), day), F.lit(0.0))
        kept = F.when(F.abs(target - acc["last"]) >= band, target).otherwise(acc["last"])
        return F.struct(kept.alias("last"), F.concat(acc["path"], F.array(kept)).alias("path"))

    path = F.aggregate("dates", start, step, lambda acc: acc["path"])
    rows = folded.withColumn("_row", F.explode(F.arrays_zip(F.col("dates"), path.alias("path"))))
    return rows.select("strategy_id", F.col("_row.dates").alias("date"), "ticker", F.col("_row.path").alias("weight")).where(F.col("weight") != 0.0)


def metric_pack(series: DataFrame, risk_free: float = 0.02, keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """Sharpe, Sortino, drawdown, Calmar, CVaR, return, volatility, turnover in one shuffle.

    The series window and the final aggregate share the partitioning by key.
    """
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("date")
    rf = risk_free / 252.0
    df = series.withColumn("_wealth", W.wealth("ret", ordered))
    df = df.withColumn("_peak", F.max("_wealth").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_var", F.percentile("ret", F.lit(0.05)).over(whole))
    below = F.when(F.col("ret") < rf, F.pow(F.col("ret") - F.lit(rf), F.lit(2.0)))
    df = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"), F.avg("ret").alias("_mean"), F.stddev_pop("ret").alias("_sd"),
        F.stddev_samp("ret").alias("_sd1"),
        F.when(F.count(below) > 1, F.sqrt(F.avg(below))).otherwise(F.lit(0.0)).alias("_down"),
        F.min(F.col("_wealth") / F.col("_peak") - F.lit(1.0)).alias("max_drawdown"),
        F.avg(F.when(F.col("ret") <= F.col("_var") + W.TIE, F.col("ret"))).alias("cvar_95"),
        (F.avg("turnover") if "turnover" in series.columns else F.lit(None).cast("double")).alias("turnover"),
    )
    year = F.sqrt(F.lit(252.0))
    annual = F.exp(F.col("_mean") * F.lit(252.0)) - F.lit(1.0)
    return df.select(
        *keys, "n_obs",
        (year * (F.col("_mean") - F.lit(rf)) / (F.col("_sd") + F.lit(1e-9))).alias("sharpe"),
        ((F.col("_mean") - F.lit(rf)) / (F.col("_down") + F.lit(1e-9)) * year).alias("sortino"),
        "max_drawdown", (annual / F.greatest(F.abs("max_drawdown"), F.lit(1e-9))).alias("calmar"), "cvar_95",
        annual.alias("annualized_return"), (F.col("_sd1") * year).alias("annualized_vol"), "turnover",
    )


def compare_methods(metrics: DataFrame, baseline: str, current: str) -> DataFrame:
    """One row: current against baseline, with annualised cost saved in basis points."""
    pick = lambda c, s: F.max(F.when(F.col("strategy_id") == s, F.col(c)))
    names = ["sharpe", "sortino", "max_drawdown", "annualized_return", "annualized_vol", "turnover"]
    wide = metrics.agg(*[pick(c, baseline).alias(f"{c}_before") for c in names], *[pick(c, current).alias(f"{c}_after") for c in names])
    saved = (F.col("turnover_before") - F.col("turnover_after")) * F.lit(252.0 * 10000.0 * 0.001)
    return wide.withColumn("cost_saved_bps", saved)
