"""Report-ready tables (data only)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import REPORT_BUCKETS
from ..functions import scalars as S
from ..functions import windows as W
from .backtest import final_weights, first_weights
from .ranks import codes


def weights_by(weights: DataFrame, universe: DataFrame, group: str) -> DataFrame:
    return weights.join(universe.select("ticker", group), "ticker").groupBy("strategy_id", "date", group).agg(F.sum("weight").alias("weight"))


def composition(universe: DataFrame, groups: Sequence[str]) -> DataFrame:
    total = universe.agg(F.count(F.lit(1))).scalar()
    return universe.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


def monthly_turnover(series: DataFrame) -> DataFrame:
    monthly = series.groupBy("strategy_id", S.month_start("date").alias("month")).agg(F.sum("turnover").alias("turnover"))
    return monthly.withColumn("mean_turnover", F.avg("turnover").over(Window.partitionBy("strategy_id")))


def top_by_mean_weight(weights: DataFrame, n: int = 8) -> DataFrame:
    """Largest mean weights; dates without the name count as zero."""
    books = weights.groupBy("strategy_id").agg(F.count_distinct("date").alias("_k"))
    means = weights.groupBy("strategy_id", "ticker").agg(F.sum("weight").alias("_s")).join(books, "strategy_id")
    means = means.withColumn("mean_weight", F.col("_s") / F.col("_k"))
    w = Window.partitionBy("strategy_id").orderBy(F.round("mean_weight", 9).desc(), "ticker")
    return means.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).select("strategy_id", "ticker", "mean_weight")


def top_trials(trials: DataFrame, n: int = 10) -> DataFrame:
    return trials.orderBy(F.col("value").desc(), "trial_id").limit(n)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlations in a single aggregate over the columns (no row pairs)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[S.correlation(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("left_feature"), F.lit(b).alias("right_feature"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]))
    return one.select(rows.alias("r")).select("r.*")


def feature_vs_forecast(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    one = df.agg(*[S.correlation(c, target).alias(c) for c in columns])
    return one.unpivot([], list(columns), "feature", "corr").where(F.col("corr").isNotNull())


def return_histogram(series: DataFrame, bins: int = 60) -> DataFrame:
    """Equal-width bins over each series' own range; the maximum falls in the last bin."""
    whole = Window.partitionBy("strategy_id")
    low, high = F.min("ret").over(whole), F.max("ret").over(whole)
    bin_ = F.least(F.floor((F.col("ret") - low) / F.nullif(high - low, F.lit(0.0)) * F.lit(bins)), F.lit(bins - 1))
    return series.withColumn("bin", F.coalesce(bin_, F.lit(0)).cast("long")).groupBy("strategy_id", "bin").agg(F.count(F.lit(1)).alias("n"))


def monthly_dispersion(df: DataFrame, value: str, months: int = 12) -> DataFrame:
    """Box statistics per month for the last months that have data."""
    rows = df.where(F.col(value).isNotNull()).withColumn("month", S.month_start("date"))
    last = rows.select("month").distinct().orderBy(F.col("month").desc()).limit(months)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = rows.join(last, "month", "left_semi").groupBy("month").agg(F.count(F.lit(1)).alias("n"), q.alias("_q"), F.min(value).alias("low"), F.max(value).alias("high"))
    return stats.select("month", "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "low", "high")


def anchor_table(weights: DataFrame, universe: DataFrame, targets: DataFrame, band: float = 0.15, tol: float = 1e-3) -> DataFrame:
    """Bucket weights of the first and last books against targets, with the binding side of the band."""
    mapping = universe.sparkSession.createDataFrame([(s, b) for b, group in REPORT_BUCKETS.items() for s in group], "sector string, bucket string")
    sectors = universe.select("ticker", "sector").join(F.broadcast(mapping), "sector")
    bucketed = lambda book, name: book.join(sectors, "ticker").groupBy("strategy_id", "bucket").agg(F.sum("weight").alias(name))
    both = bucketed(first_weights(weights), "first_weight").join(bucketed(final_weights(weights), "last_weight"), ["strategy_id", "bucket"], "full")
    goal = targets.select(F.col("sector").alias("bucket"), F.col("weight").alias("target_weight"))
    df = both.join(goal, "bucket", "left").fillna(0.0, subset=["first_weight", "last_weight", "target_weight"])
    low, high = F.greatest(F.col("target_weight") - band, F.lit(0.0)), F.least(F.col("target_weight") + band, F.lit(1.0))
    flag = F.when(F.abs(F.col("last_weight") - low) <= tol, "lower").when(F.abs(F.col("last_weight") - high) <= tol, "upper").otherwise("free")
    return df.select("strategy_id", "bucket", "target_weight", "first_weight", "last_weight",
                     (F.col("last_weight") - F.col("target_weight")).alias("gap"), (F.col("last_weight") - F.col("first_weight")).alias("drift"), flag.alias("binding"))


def best_flags(metrics: DataFrame, key: str, higher: Mapping[str, bool]) -> DataFrame:
    """Long metric table with a flag on the best value of each metric."""
    long = metrics.unpivot(key, list(higher), "metric", "value").where(F.col("value").isNotNull())
    up = F.col("metric").isin([m for m, good in higher.items() if good])
    w = Window.partitionBy("metric")
    best = F.when(up, F.max("value").over(w)).otherwise(F.min("value").over(w))
    return long.withColumn("is_best", F.abs(F.col("value") - best) < 1e-9)


def pairwise_delta(metrics: DataFrame, key: str, base: str, other: str, names: Sequence[str]) -> DataFrame:
    long = metrics.where(F.col(key).isin(base, other)).unpivot(key, list(names), "metric", "value")
    pick = lambda k: F.max(F.when(F.col(key) == k, F.col("value")))
    return long.groupBy("metric").agg(pick(base).alias("base_value"), pick(other).alias("other_value")).withColumn("delta", F.col("other_value") - F.col("base_value"))


def period_growth(series: DataFrame, start: str, end: str) -> DataFrame:
    """Total return and CAGR (365.25-day years) of each wealth curve inside a date window."""
    w = Window.partitionBy("strategy_id").orderBy("date")
    curve = series.withColumn("wealth", W.wealth("ret", w)).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    s = curve.groupBy("strategy_id").agg(
        F.min_by("wealth", "date").alias("v0"), F.max_by("wealth", "date").alias("v1"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    years = F.date_diff("last_date", "first_date") / F.lit(365.25)
    return s.withColumns({"total_return": F.col("v1") / F.col("v0") - F.lit(1.0),
                          "cagr": F.pow(F.col("v1") / F.col("v0"), F.lit(1.0) / F.nullif(years, F.lit(0.0))) - F.lit(1.0)})


def trial_convergence(trials: DataFrame) -> DataFrame:
    """Best value so far over trials; the trial table is bounded by the search budget."""
    w = Window.partitionBy("source").orderBy("trial_id")
    return trials.withColumn("best_so_far", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def parallel_coordinates(trials: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Categories as dense codes from 0, numeric gaps filled with the column median."""
    middle = trials.agg(*[F.median(c).alias(c) for c in numeric])
    out = trials.withColumns({c: F.coalesce(c, middle.select(c).scalar()) for c in numeric})
    for c in categorical:
        out = codes(out, c)
    return out
