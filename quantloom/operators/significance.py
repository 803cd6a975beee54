"""Alpha against benchmarks and rank information coefficients of signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SIGNAL_COLUMNS
from ..functions import scalars as S
from ..functions import windows as W
from .features import forward_return
from .resampling import bootstrap_metrics, bootstrap_pairs, summarise


def align(fund: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Common dates of each strategy with each benchmark, both values known."""
    b = benchmark.select("benchmark", "date", F.col("ret").alias("bench")).where(F.col("bench").isNotNull())
    return fund.select("strategy_id", "date", "ret").where(F.col("ret").isNotNull()).join(b, "date")


def pair_points(pairs: DataFrame, risk_free: float = 0.04, keys=("strategy_id", "benchmark")) -> DataFrame:
    """beta, Jensen alpha, information ratio and tracking error in one aggregate."""
    diff = F.col("ret") - F.col("bench")
    s = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mf"), F.avg("bench").alias("mb"),
        F.covar_samp("ret", "bench").alias("cov"), F.var_samp("bench").alias("vb"), F.avg(diff).alias("md"), F.stddev_pop(diff).alias("sd"))
    beta = F.when(F.col("n") < 20, F.lit(1.0)).otherwise(F.col("cov") / (F.col("vb") + F.lit(1e-12)))
    annual = lambda m: F.exp(F.col(m) * F.lit(252.0)) - F.lit(1.0)
    year = F.sqrt(F.lit(252.0))
    return s.withColumn("beta", beta).select(
        *keys, "n", "beta",
        (annual("mf") - (F.lit(risk_free) + F.col("beta") * (annual("mb") - F.lit(risk_free)))).alias("alpha_annualized"),
        (year * F.col("md") / (F.col("sd") + F.lit(1e-9))).alias("information_ratio"), (F.col("sd") * year).alias("tracking_error"))


def alpha_significance(fund: DataFrame, benchmark: DataFrame, n_reps: int = 5000, block: float = 20, seed: int = 42,
                       confidence: float = 0.95, risk_free: float = 0.04) -> DataFrame:
    keys = ["strategy_id", "benchmark"]
    pairs = align(fund, benchmark)
    points = pair_points(pairs, risk_free).where(F.col("n") >= 20)
    long = points.unpivot([*keys, "n", "beta"], ["alpha_annualized", "information_ratio", "tracking_error"], "metric", "point")
    draws = bootstrap_pairs(pairs, keys, n_reps, block, seed, risk_free)
    out = summarise(draws, long.select(*keys, "metric", "point"), keys, confidence)
    out = out.withColumn("p_value", F.when(F.col("metric") != "tracking_error", F.col("p_value")))
    return out.join(long.select(*keys, "metric", F.round("beta", 3).alias("beta")), [*keys, "metric"])


def signal_ic(features: DataFrame, rebalances: DataFrame | None = None, signals: Sequence[str] = SIGNAL_COLUMNS,
              horizon: int = 21, min_names: int = 4) -> DataFrame:
    """(signal, date, ic): Spearman correlation of each signal with the forward return.

    Without given dates the last row of each ticker's month is used.  Signals are unpivoted,
    ranks are windows by (signal, date), and one ``corr`` per group finishes.
    """
    present = [c for c in signals if c in features.columns]
    labelled = forward_return(features.where(F.col("price").isNotNull()), horizon)
    if rebalances is not None:
        rows = labelled.join(rebalances.select("date").distinct(), "date", "left_semi")
    else:
        last = features.groupBy(F.trunc("date", "MM").alias("_m"), "ticker").agg(F.max("date").alias("date"))
        rows = labelled.join(last.select("date", "ticker"), ["date", "ticker"], "left_semi")
    long = rows.select("date", "ticker", "forward_return", *present).unpivot(["date", "ticker", "forward_return"], present, "signal", "x")
    known = long.where(F.col("x").isNotNull() & F.col("forward_return").isNotNull())
    group = ["signal", "date"]
    ranked = known.withColumns({"rx": W.average_rank("x", group), "ry": W.average_rank("forward_return", group)})
    ic = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        S.correlation("rx", "ry").alias("ic"))
    return ic.where((F.col("n") >= min_names) & F.col("ic").isNotNull()).select("signal", "date", "ic", "n")


def ic_points(ic: DataFrame) -> DataFrame:
    return ic.groupBy("signal").agg(
        F.count(F.lit(1)).alias("n_periods"), F.avg("ic").alias("ic_mean"),
        (F.avg("ic") / (F.stddev_samp("ic") + F.lit(1e-9)) * F.sqrt(F.count(F.lit(1)).cast("double"))).alias("ic_t_stat"),
    ).where(F.col("n_periods") >= 4)


def ic_diagnostics(ic: DataFrame, n_reps: int = 5000, block: float = 6, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    points = ic_points(ic)
    series = ic.join(points.select("signal"), "signal", "left_semi").select("signal", "date", F.col("ic").alias("ret"))
    draws = bootstrap_metrics(series, ["signal"], ["mean"], n_reps, block, seed)
    stats = summarise(draws, points.select("signal", F.lit("mean").alias("metric"), F.col("ic_mean").alias("point")), ["signal"], confidence)
    return points.join(stats.select("signal", "ci_low", "ci_high", "p_value"), "signal").withColumn("significant", F.col("p_value") < 0.05)
