"""Risk measures over return series keyed by strategy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import FALLBACK_STRESS_WINDOWS
from ..functions import scalars as S
from ..functions import windows as W
from .joins import asof_join

KEYS = ("strategy_id",)


def sharpe(series: DataFrame, risk_free: float = 0.02, keys: Sequence[str] = KEYS) -> DataFrame:
    value = F.sqrt(F.lit(252.0)) * (F.avg("ret") - F.lit(risk_free / 252.0)) / (F.stddev_pop("ret") + F.lit(1e-9))
    return series.groupBy(*keys).agg(value.alias("sharpe"))


def sortino(series: DataFrame, required: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    below = F.when(F.col("ret") < required, F.pow(F.col("ret") - F.lit(required), F.lit(2.0)))
    down = F.when(F.count(below) > 1, F.sqrt(F.avg(below))).otherwise(F.lit(0.0))
    return series.groupBy(*keys).agg(
        ((F.avg("ret") - F.lit(required)) / (down + F.lit(1e-9)) * F.sqrt(F.lit(252.0))).alias("sortino"))


def drawdowns(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Wealth, running peak and drawdown per row."""
    w = Window.partitionBy(*keys).orderBy("date")
    df = series.withColumn("wealth", W.wealth("ret", w))
    df = df.withColumn("peak", F.max("wealth").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("drawdown", F.col("wealth") / F.col("peak") - F.lit(1.0))


def max_drawdown(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return drawdowns(series, keys).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def value_at_risk(series: DataFrame, alpha: float = 0.95, keys: Sequence[str] = KEYS) -> DataFrame:
    """Historical VaR (exact quantile of a calendar-bounded series) and expected shortfall."""
    level = F.percentile("ret", F.lit(1.0 - alpha)).over(Window.partitionBy(*keys))
    tagged = series.withColumn("_level", level)
    return tagged.groupBy(*keys).agg(
        F.first("_level").alias("var"), F.avg(F.when(F.col("ret") <= F.col("_level") + W.TIE, F.col("ret"))).alias("cvar"))


def annualised(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return series.groupBy(*keys).agg(
        (F.exp(F.avg("ret") * F.lit(252.0)) - F.lit(1.0)).alias("annualized_return"),
        (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("annualized_vol"))


def realised_volatility(series: DataFrame, method: str = "ewma", span: int = 21, keys: Sequence[str] = KEYS) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date")
    sd = (W.ewma_stddev("ret", w, span, max(span // 2, 10)) if method == "ewma" else W.rolling_stddev("ret", w, span))
    return series.withColumn("realized_vol", sd * F.sqrt(F.lit(252.0)))


def stress_test(series: DataFrame, exposures: DataFrame, risk_free: float = 0.02, shock_days: int = 5,
                spacing: int = 126, keys: Sequence[str] = KEYS) -> DataFrame:
    """Deterministic scenarios: ``exposures`` rows (keys, scenario, shock, exposure).

    shock x exposure / n is added on the first ``n`` rows of every ``spacing`` rows; all
    scenarios of all strategies run in one pass.
    """
    n = max(int(shock_days), 1)
    every = max(int(spacing), n)
    keys = list(keys)
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("date")) - 1
    placed = series.withColumn("_hit", F.pmod(pos, F.lit(every)) < n)
    per_key = exposures.groupBy(*keys).agg(F.collect_list(F.struct("scenario", (F.col("shock") * F.col("exposure") / F.lit(float(n))).alias("daily"))).alias("_s"))
    rows = placed.join(per_key, keys).withColumn("_x", F.explode("_s"))
    shocked = rows.select(*keys, "date", F.col("_x.scenario").alias("scenario"),
                          (F.col("ret") + F.when(F.col("_hit"), F.col("_x.daily")).otherwise(F.lit(0.0))).alias("ret"))
    group = [*keys, "scenario"]
    return drawdowns(shocked, group).groupBy(*group).agg(
        F.avg("ret").alias("mean_return"), F.stddev_pop("ret").alias("volatility"),
        (F.sqrt(F.lit(252.0)) * (F.avg("ret") - F.lit(risk_free / 252.0)) / (F.stddev_pop("ret") + F.lit(1e-9))).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"))


def fixed_weight_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """History of today's book: (strategy, date) sum of normalised weight x return."""
    total = F.sum("weight").over(Window.partitionBy("strategy_id"))
    normal = weights.select("strategy_id", "ticker", (F.col("weight") / F.greatest(total, F.lit(1e-9))).alias("weight"))
    return returns.select("date", "ticker", "ret").join(normal, "ticker").groupBy("strategy_id", "date").agg(
        F.sum(F.col("weight") * F.col("ret")).alias("ret"))


def stress_masks(calendar: DataFrame, macro: DataFrame, span: int = 21) -> DataFrame:
    """(scenario, date, pos) rows where a macro stress is active on a trading day.

    ``calendar`` holds one row per trading date, so this window is bounded by the calendar.
    """
    wanted = [c for c in ("banxico_rate", "usd_mxn", "sp500", "us_ip_yoy", "exports_yoy") if c in macro.columns]
    daily = asof_join(calendar, macro, [], wanted)
    w = Window.orderBy("date")
    get = lambda c: F.col(c) if c in wanted else F.lit(None).cast("double")
    daily = daily.withColumns({
        "rate_delta": W.diff(get("banxico_rate"), w, span), "fx_mom": W.pct_change(get("usd_mxn"), w, span),
        "equity_mom": W.pct_change(get("sp500"), w, span), "ip": get("us_ip_yoy"),
    })
    trade = (F.col("fx_mom") > 0.04) & (F.col("ip") < 1.0)
    if "exports_yoy" in wanted:
        trade = trade & (F.col("exports_yoy") < 0.0)
    rules = {
        "banxico_shock": F.abs("rate_delta") > 0.01,
        "peso_depreciation": F.col("fx_mom") > 0.05,
        "us_slowdown": (F.col("ip") < 0.0) & (F.col("equity_mom") < -0.08),
        "tmec_disruption": trade,
    }
    active = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return daily.select("date", F.explode(active).alias("scenario"), S.business_day_index("date").alias("pos"))


def thin_positions(masks: DataFrame, last_pos: Column, span: int, min_len: int) -> DataFrame:
    """Greedy spacing per scenario: keep an active day at least max(span/2, 5) rows after the last kept one.

    The fold runs over one scenario's active days (bounded by the calendar).
    """
    gap = max(span // 2, 5)
    days = masks.groupBy("scenario").agg(F.sort_array(F.collect_set("pos")).alias("days")).withColumn("_last", last_pos)
    start = F.struct(F.lit(-10**6).alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(acc, p):
        ok = (p - acc["last"] >= gap) & (F.least(p + (span - 1), F.col("_last")) - p + 1 >= min_len)
        return F.struct(F.when(ok, p).otherwise(acc["last"]).alias("last"),
                        F.when(ok, F.concat(acc["kept"], F.array(p))).otherwise(acc["kept"]).alias("kept"))

    return days.select("scenario", F.explode(F.aggregate("days", start, step, lambda a: a["kept"])).alias("start_pos"))


def stress_windows(book: DataFrame, macro: DataFrame, span: int = 21) -> DataFrame:
    """Window P&L of each book under each scenario: (strategy, scenario, label, pnl, start).

    Windows are days after active macro days; scenarios with fewer than three windows also
    use well-known crisis periods.
    """
    calendar = book.select("date").distinct()
    last_pos = S.business_day_index(book.agg(F.max("date")).scalar())
    kept = thin_positions(stress_masks(calendar, macro, span), last_pos, span, span // 2)
    days = kept.withColumn("pos", F.explode(F.sequence(F.col("start_pos"), F.col("start_pos") + (span - 1))))
    placed = book.withColumn("pos", S.business_day_index("date"))
    found = placed.join(days, "pos").groupBy("strategy_id", "scenario", F.col("start_pos").cast("string").alias("_id")).agg(
        F.sum("ret").alias("_r"), F.min("date").alias("start"), F.max("date").alias("end"))
    found = found.withColumn("label", F.concat(F.col("start").cast("string"), F.lit(" to "), F.col("end").cast("string")))
    spark = book.sparkSession
    fixed = spark.createDataFrame(FALLBACK_STRESS_WINDOWS, "first string, final string, label string").select(
        "label", F.explode(F.sequence(F.col("first").cast("date"), F.col("final").cast("date"), F.expr("interval 1 day"))).alias("date"))
    crises = book.join(F.broadcast(fixed), "date").groupBy("strategy_id", "label").agg(
        F.sum("ret").alias("_r"), F.count(F.lit(1)).alias("_n"), F.min("date").alias("start")).where(F.col("_n") >= span // 2)
    counts = kept.groupBy("scenario").agg(F.count(F.lit(1)).alias("_k"))
    names = spark.createDataFrame([("banxico_shock",), ("peso_depreciation",), ("us_slowdown",), ("tmec_disruption",)], "scenario string")
    sparse = names.join(counts, "scenario", "left").where(F.coalesce("_k", F.lit(0)) < 3).agg(F.collect_list("scenario").alias("s"))
    # at most four names, carried as one scalar array: no cross join
    extra = crises.withColumn("scenario", F.explode(sparse.scalar()))
    cols = ["strategy_id", "scenario", "label", "start", (F.exp("_r") - F.lit(1.0)).alias("pnl")]
    return found.select(*cols).unionByName(extra.select(*cols))


def stress_distribution(windows: DataFrame, n_reps: int = 5000, seed: int = 42) -> DataFrame:
    """Resampled P&L percentiles, tail mean and worst window per (strategy, scenario).

    A scenario has at most calendar / spacing windows, so its P&L list rides in the row and
    each draw is an array lookup at a hashed index: no join, no shuffle of the draws.
    """
    group = ["strategy_id", "scenario"]
    lists = windows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_windows"), F.sort_array(F.collect_list(F.struct("start", "label", "pnl"))).alias("_w"),
        F.min_by("label", F.struct("pnl", "start", "label")).alias("worst_window"))
    draws = lists.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_reps - 1))))
    pick = F.floor(S.hash_uniform(seed, 11, F.col("rep"), F.lit(0)) * F.col("n_windows")).cast("int")
    draws = draws.select(*group, "n_windows", "worst_window", F.get("_w", pick)["pnl"].alias("pnl"))
    tail = F.percentile("pnl", F.lit(0.05)).over(Window.partitionBy(*group))
    cut = draws.withColumn("_p5", tail)
    q = lambda p: F.percentile("pnl", F.lit(p))
    return cut.groupBy(*group).agg(
        F.first("n_windows").alias("n_windows"), F.avg("pnl").alias("mean"), F.first("_p5").alias("p5"), q(0.25).alias("p25"),
        q(0.5).alias("p50"), q(0.75).alias("p75"), q(0.95).alias("p95"), F.stddev_samp("pnl").alias("std"),
        F.avg(F.when(F.col("pnl") <= F.col("_p5") + W.TIE, F.col("pnl"))).alias("cvar_95"), F.first("worst_window").alias("worst_window"))


def scenario_exposures(final_book: DataFrame, universe: DataFrame, shocks: Mapping[str, float], sectors: Sequence[str]) -> DataFrame:
    """(strategy, scenario, shock, exposure) from the final weights, with clipped formulas."""
    dims = universe.select("ticker", "sector", "asset_class", "usd_exposure")
    w = F.col("weight")
    sums = final_book.join(dims, "ticker", "left").groupBy("strategy_id").agg(
        F.sum(w * F.coalesce("usd_exposure", F.lit(0.0))).alias("usd"),
        F.sum(F.when(F.col("asset_class") == "fixed_income", w).otherwise(F.lit(0.0))).alias("fi"),
        F.sum(F.when(F.col("sector").isin(list(sectors)), w).otherwise(F.lit(0.0))).alias("ind"))
    usd, fi, ind = F.col("usd"), F.col("fi"), F.col("ind")
    values = {
        "banxico_shock": S.clip(fi * 3.0 + (F.lit(1.0) - fi) * 0.25, 0.15, 0.75),
        "peso_depreciation": S.clip(F.lit(1.0) - usd, 0.20, 0.85),
        "us_slowdown": S.clip(usd * 1.2, 0.15, 0.80),
        "tmec_disruption": S.clip((ind * 0.6 + usd * 0.4) * 1.3, 0.20, 0.85),
    }
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("scenario"), F.lit(float(shocks[k])).alias("shock"), v.alias("exposure")) for k, v in values.items()]))
    return sums.select("strategy_id", rows.alias("r")).select("strategy_id", "r.scenario", "r.shock", "r.exposure")


def monte_carlo_var(law: DataFrame, alpha: float = 0.95, n_sim: int = 10000, horizon: int = 1, seed: int = 42) -> DataFrame:
    """Simulated VaR for rows (strategy, mu, sigma) of a portfolio's daily law.

    A portfolio of jointly normal assets is normal with mean w'mu and variance w'Sw, so the
    draws are made for the portfolio itself; correlation is already inside ``sigma``.
    """
    draws = law.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_sim - 1))))
    z = S.box_muller(S.hash_uniform(seed, 21, F.col("rep"), F.lit(0)), S.hash_uniform(seed, 22, F.col("rep"), F.lit(0)))
    sim = F.col("mu") * horizon + F.col("sigma") * F.sqrt(F.lit(float(horizon))) * z
    return draws.select("strategy_id", sim.alias("x")).groupBy("strategy_id").agg(
        F.percentile("x", F.lit(1.0 - alpha)).alias("mc_var"), F.count(F.lit(1)).alias("n_sim"))


def empirical_dynamic_var(series: DataFrame, alpha: float = 0.95, window: int = 252, keys: Sequence[str] = KEYS) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date")
    return series.withColumn("dynamic_var", W.rolling_quantile("ret", w, window, 1.0 - alpha))


def scaled_dynamic_var(sigmas: DataFrame, alpha: float = 0.95, keys: Sequence[str] = KEYS) -> DataFrame:
    """sigma_t x empirical quantile of standardised returns, for rows (keys, date, ret, sigma)."""
    std = F.try_divide("ret", "sigma")
    z = F.percentile(std, F.lit(1.0 - alpha)).over(Window.partitionBy(*keys))
    return sigmas.withColumn("z_alpha", z).withColumn("dynamic_var", F.col("sigma") * F.col("z_alpha"))
