"""Long/short books, leverage, currency hedge and the full overlay back-test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import STRUCTURE_SCENARIOS
from ..functions import scalars as S
from ..functions import windows as W
from ..session import stage
from ..sources.panel import business_days, date_bounds
from . import backtest
from .joins import asof_join


def pick_sides(signals: DataFrame, top_n: int, bottom_n: int, sector_neutral: bool = False) -> DataFrame:
    """Best and worst names per date (or date and sector), total order by (forecast, ticker).

    Sector-neutral books skip sectors with fewer than top + bottom names.  Otherwise a name
    may sit on both sides when a date has few names; ``overlap`` marks that.
    """
    group = ["date", "sector"] if sector_neutral else ["date"]
    best = Window.partitionBy(*group).orderBy(F.col("expected_return").desc(), F.col("ticker").asc())
    worst = Window.partitionBy(*group).orderBy(F.col("expected_return").asc(), F.col("ticker").desc())
    df = signals.select("date", "ticker", "sector", "expected_return").withColumns({
        "_up": F.row_number().over(best), "_dn": F.row_number().over(worst), "_size": F.count(F.lit(1)).over(Window.partitionBy(*group))})
    if sector_neutral:
        df = df.where(F.col("_size") >= top_n + bottom_n)
    long, short = F.col("_up") <= top_n, F.col("_dn") <= bottom_n
    sides = F.array_compact(F.array(F.when(long, F.lit("long")), F.when(short, F.lit("short"))))
    return df.select("date", "ticker", "sector", "expected_return", (long & short).alias("overlap"), F.explode(sides).alias("side"))


def long_short(signals: DataFrame, top_n: int = 5, bottom_n: int = 5, sector_neutral: bool = True, net_target: float = 0.0,
               gross_target: float = 1.0, weight_by_signal: bool = True) -> DataFrame:
    """(date, ticker, side, raw_weight, net_weight, sector): sides scaled to their budgets."""
    net = min(max(float(net_target), -gross_target), gross_target)
    gross = max(float(gross_target), 1e-6)
    picked = pick_sides(signals, top_n, bottom_n, sector_neutral)
    sign = F.when(F.col("side") == "long", F.lit(1.0)).otherwise(F.lit(-1.0))
    strength = F.greatest(sign * F.col("expected_return"), F.lit(0.0))
    group = Window.partitionBy("date", "side", *(["sector"] if sector_neutral else []))
    if weight_by_signal:
        strength = F.when(F.sum(strength).over(group) <= 1e-9, F.lit(1.0)).otherwise(strength)
    else:
        strength = F.lit(1.0)
    book = picked.withColumn("raw_weight", sign * strength)
    total = F.sum(F.abs("raw_weight")).over(Window.partitionBy("date", "side"))
    budget = F.when(F.col("side") == "long", F.lit(0.5 * (gross + net))).otherwise(F.lit(0.5 * (gross - net)))
    scaled = book.withColumn("_t", total).withColumn(
        "net_weight", F.when(F.col("_t") > 0, F.col("raw_weight") * budget / F.nullif(F.col("_t"), F.lit(0.0))).otherwise(F.lit(0.0)))
    return scaled.drop("_t")


def dynamic_leverage(series: DataFrame, max_leverage: float = 1.5, cvar_limit: float = 0.02, min_leverage: float = 1.0,
                     alpha: float = 0.95, window: int = 63, keys=("strategy_id",), ret: str = "ret", cap: str | None = None) -> DataFrame:
    """Leverage from the rolling tail mean of earlier rows, smoothed over five days and clipped.

    ``cap`` names a per-row maximum column that replaces ``max_leverage``.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    top = F.col(cap) if cap else F.lit(float(max_leverage))
    low = F.lit(float(min_leverage))
    df = series.withColumn("_cvar", F.abs(W.rolling_cvar_prior(ret, w, window, alpha)))
    limit = float(cvar_limit)
    scale = F.greatest(F.lit(0.0), F.lit(1.0) - (F.col("_cvar") - limit) / F.lit(limit))
    inside = (F.lit(limit) - F.col("_cvar")) / F.lit(limit * 0.5)
    target = (F.when(F.col("_cvar").isNull(), F.lit(1.0)).when(F.col("_cvar") > limit, low + (top - low) * scale)
              .when(F.col("_cvar") <= limit * 0.5, top).otherwise(low + (top - low) * inside))
    df = df.withColumn("_target", target)
    smooth = W.ewma_adjusted("_target", w, 2.0 / 6.0)
    return df.withColumn("leverage", F.least(F.greatest(smooth, low), top)).drop("_cvar", "_target")


def hedge_ratio(macro: DataFrame, dates: DataFrame, max_hedge: float = 0.95, min_hedge: float = 0.10,
                currency_vol: float | None = None, momentum_rows: int = 21) -> DataFrame:
    """Currency hedge ratio per signal date from carry and momentum z-scores.

    Macro values are taken as of each date, so month-ends off the trading calendar still count.
    One row per signal date: the window is bounded by the calendar.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    columns = [c for c in ("banxico_rate", "us_fed_rate", "usd_mxn") if c in macro.columns]
    df = asof_join(dates.select("date").distinct(), macro, [], columns)
    foreign = F.col("us_fed_rate") if "us_fed_rate" in columns else F.lit(5.25)
    df = df.withColumns({"rate_differential": F.col("banxico_rate") - foreign,
                         "mxn_momentum": W.log_ratio(F.col("usd_mxn"), F.lag("usd_mxn", momentum_rows).over(w))})
    df = df.withColumn("fx_signal_score", F.lit(-0.6) * W.expanding_zscore_floor("rate_differential", w) + F.lit(0.4) * W.expanding_zscore_floor("mxn_momentum", w))
    ratio = F.lit(min_hedge) + F.lit(max_hedge - min_hedge) * S.sigmoid(S.clip("fx_signal_score", -3.0, 3.0) / F.lit(3.0) * F.lit(6.0))
    # an unknown score leaves the ratio unknown (least/greatest would skip the NULL)
    ratio = F.when(F.col("fx_signal_score").isNotNull(), ratio)
    if currency_vol is not None and currency_vol > 0:
        boost = 0.05 * min(max((currency_vol - 0.15) / 0.10, -1.0), 1.0)
        ratio = F.when(ratio.isNotNull(), S.clip(ratio + F.lit(boost), min_hedge, max_hedge))
    return df.select("date", ratio.alias("hedge_ratio"), "fx_signal_score", "rate_differential", "mxn_momentum")


def currency_pnl(hedges: DataFrame, macro: DataFrame, calendar: DataFrame, mean_exposure) -> DataFrame:
    """exposure x (1 - yesterday's hedge) x today's currency return, per trading day."""
    daily = asof_join(calendar.select("date").distinct(), hedges, [], ["hedge_ratio"])
    daily = asof_join(daily, macro, [], ["usd_mxn"])
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    held = F.coalesce(F.lag(F.coalesce("hedge_ratio", F.lit(0.5))).over(w), F.lit(0.5))
    move = F.coalesce(W.log_ratio(F.col("usd_mxn"), F.lag("usd_mxn").over(w)), F.lit(0.0))
    return daily.select("date", F.coalesce("hedge_ratio", F.lit(0.5)).alias("hedge_ratio"), (mean_exposure * (F.lit(1.0) - held) * move).alias("fx_pnl"))


def tail_hedge(params: DataFrame, protection: float = 0.99, cost_bps: float = 30.0) -> DataFrame:
    """Cost and benefit of a tail hedge from extreme-value parameters (shape k, loc, scale)."""
    k, loc, scale = F.col("shape"), F.col("loc"), F.col("scale")

    def quantile(p):
        y = -F.ln(F.lit(p))
        return loc + scale * F.when(F.abs(k) < 1e-9, -F.ln(y)).otherwise((F.lit(1.0) - F.pow(y, k)) / k)

    loss, var95 = -quantile(1.0 - protection), -quantile(1.0 - 0.95)
    payoff = F.greatest(F.lit(0.0), loss - var95)
    drag = F.lit(cost_bps / 10000.0)
    return params.withColumns({"unhedged_loss": loss, "hedge_payoff": payoff, "daily_cost_drag": drag,
                               "net_benefit": payoff - drag, "recommended": payoff - drag > 0})


def notional_flag(hedges: DataFrame, cap: float = 0.15, warn: float = 0.12) -> DataFrame:
    top = F.max(F.abs("hedge_ratio"))
    return hedges.agg(top.alias("max_hedge")).withColumn(
        "status", F.when(F.col("max_hedge") > cap, "exceeded").when(F.col("max_hedge") > warn, "approaching").otherwise("ok"))


def scenario_books(signals: DataFrame, scenarios=STRUCTURE_SCENARIOS) -> DataFrame:
    """Books of every structural scenario with its leverage cap, in one pass over the signals.

    Ranks by date and by (date, sector) are computed once; each row then explodes into the
    scenarios that pick it.  A long-only scenario is scaled to 1 (leverage is applied later);
    long/short ones carry their own net and gross budgets.
    """
    ranks = {}
    for tag, group in (("d", ["date"]), ("s", ["date", "sector"])):
        best = Window.partitionBy(*group).orderBy(F.col("expected_return").desc(), F.col("ticker").asc())
        worst = Window.partitionBy(*group).orderBy(F.col("expected_return").asc(), F.col("ticker").desc())
        ranks.update({f"_up_{tag}": F.row_number().over(best), f"_dn_{tag}": F.row_number().over(worst),
                      f"_n_{tag}": F.count(F.lit(1)).over(Window.partitionBy(*group))})
    ranked = signals.select("date", "ticker", "sector", "expected_return").withColumns(ranks)
    picks = []
    for key, _label, top, bottom, neutral, net, gross, cap, _mode in scenarios:
        tag = "s" if neutral else "d"
        net, gross = (net, gross) if bottom > 0 else (1.0, 1.0)
        allowed = (F.col(f"_n_{tag}") >= top + bottom) if neutral else F.lit(True)
        for side, rank, n, budget in (("long", f"_up_{tag}", top, 0.5 * (gross + net)), ("short", f"_dn_{tag}", bottom, 0.5 * (gross - net))):
            if n > 0:
                picks.append(F.when(allowed & (F.col(rank) <= n), F.struct(
                    F.lit(key).alias("strategy_id"), F.lit(float(cap)).alias("cap"), F.lit(1.0 if side == "long" else -1.0).alias("sign"),
                    F.lit(float(budget)).alias("budget"), (F.col("sector") if neutral else F.lit("")).alias("pool"))))
    rows = ranked.select("date", "ticker", "expected_return", F.explode(F.array_compact(F.array(*picks))).alias("p")).select("date", "ticker", "expected_return", "p.*")
    rows = rows.withColumn("_s", F.greatest(F.col("sign") * F.col("expected_return"), F.lit(0.0)))
    pool = Window.partitionBy("strategy_id", "date", "sign", "pool")
    rows = rows.withColumn("_raw", F.when(F.sum("_s").over(pool) <= 1e-9, F.lit(1.0)).otherwise(F.col("_s")))
    total = F.sum("_raw").over(Window.partitionBy("strategy_id", "date", "sign"))
    net_weight = F.col("sign") * F.coalesce(F.try_divide(F.col("_raw") * F.col("budget"), total), F.lit(0.0))
    return rows.withColumn("_w", net_weight).groupBy("strategy_id", "date", "ticker").agg(F.sum("_w").alias("weight"), F.max("cap").alias("cap"))


def overlay_backtest(books: DataFrame, returns: DataFrame, macro: DataFrame, universe: DataFrame, signal_dates: DataFrame,
                     max_leverage: float = 1.5, cvar_limit: float = 0.02, cost: float = 0.0015, borrow_bps: float = 150.0,
                     leverage_bps: float = 5.0, trade_band: float = 0.0005, currency_vol: float | None = None) -> DataFrame:
    """Daily decomposition of every book: base, leverage, currency and each cost, then ``ret``.

    ``books`` rows: (strategy_id, date, ticker, weight, cap).  All books run in one job.
    """
    books = stage(books, "scenario_books")
    caps = books.groupBy("strategy_id").agg(F.least(F.max("cap"), F.lit(float(max_leverage))).alias("cap"))
    # the accepted books feed six places below: write them once
    weights = stage(backtest.drop_small_trades(books.select("strategy_id", "date", "ticker", "weight"), trade_band), "overlay_books")
    low, high = date_bounds(returns)
    shorts = weights.select("strategy_id", "date", "ticker", F.least("weight", F.lit(0.0)).alias("weight"))
    gross = backtest.gross_returns(weights, returns, high)
    held = backtest.hold_days(backtest.hold_spans(weights, high)).select("strategy_id", "rebalance_date", "date")
    short_size = shorts.groupBy("strategy_id", F.col("date").alias("rebalance_date")).agg(F.sum(F.abs("weight")).alias("short"))
    days = business_days(weights.select("strategy_id").distinct(), low, high).join(caps, "strategy_id")
    df = (days.join(gross, ["strategy_id", "date"], "left").join(backtest.turnover(weights), ["strategy_id", "date"], "left")
          .join(held, ["strategy_id", "date"], "left").join(short_size, ["strategy_id", "rebalance_date"], "left"))
    df = df.select("strategy_id", "date", "cap", F.coalesce("gross_ret", F.lit(0.0)).alias("base_ret"),
                   F.coalesce("turnover", F.lit(0.0)).alias("turnover"), F.coalesce("short", F.lit(0.0)).alias("short"))
    df = dynamic_leverage(df, max_leverage, cvar_limit, 0.8, ret="base_ret", cap="cap")
    exposure = universe.agg(F.avg("usd_exposure")).scalar()
    hedges = hedge_ratio(macro, signal_dates, currency_vol=currency_vol)
    fx = currency_pnl(hedges, macro, returns.select("date"), exposure)
    w = Window.partitionBy("strategy_id").orderBy("date")
    df = df.join(fx.select("date", "hedge_ratio", "fx_pnl"), "date", "left").withColumns({
        "leveraged_ret": F.col("base_ret") * F.col("leverage"),
        "trade_cost": F.col("turnover") * F.lit(2.0 * cost),
        "borrow_cost": F.col("short") * F.lit(borrow_bps / 10000.0 / 252.0),
        "leverage_cost": F.coalesce(F.abs(F.col("leverage") - F.lag("leverage").over(w)), F.lit(0.0)) * F.lit(leverage_bps / 10000.0),
    })
    net = F.col("leveraged_ret") + F.coalesce("fx_pnl", F.lit(0.0)) - F.col("trade_cost") - F.col("borrow_cost") - F.col("leverage_cost")
    return df.withColumn("ret", net)
