"""Deflated Sharpe ratio and probability of back-test overfitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import EULER_MASCHERONI
from ..functions import scalars as S
from .ranks import row_numbers


def moments(series: DataFrame, keys=("strategy_id",)) -> DataFrame:
    """n, mean, sample sd and moments of z = (x - mean) / sample sd, from one two-level pass."""
    keys = list(keys)
    stats = series.where(F.col("ret").isNotNull()).withColumns({
        "_m": F.avg("ret").over(Window.partitionBy(*keys)), "_s": F.stddev_samp("ret").over(Window.partitionBy(*keys))})
    z = (F.col("ret") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    return stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"), F.first("_m").alias("mean"), F.first("_s").alias("sd"),
        F.avg(F.pow(z, F.lit(3.0))).alias("skew"), F.avg(F.pow(z, F.lit(4.0))).alias("kurtosis"))


def expected_max_sharpe(n_trials: Column) -> Column:
    """Expected best of n standard normal draws; 0 for a single trial."""
    inv = F.lit(1.0) / n_trials
    z1 = S.normal_quantile(F.lit(1.0) - inv)
    z2 = S.normal_quantile(F.lit(1.0) - inv * F.lit(0.36787944117144233))
    value = F.lit(1.0 - EULER_MASCHERONI) * z1 + F.lit(EULER_MASCHERONI) * z2
    return F.when(n_trials <= 1, F.lit(0.0)).otherwise(value)


def deflated_sharpe(series: DataFrame, n_trials: int, trial_variance: Column | None = None, annual: int = 252, keys=("strategy_id",)) -> DataFrame:
    """P(true Sharpe > expected best of N by chance); NULL under 30 rows or zero variance."""
    df = moments(series, keys).where((F.col("n_obs") >= 30) & (F.col("sd") > 0)).withColumn("sr", F.col("mean") / F.col("sd"))
    n1 = (F.col("n_obs") - 1).cast("double")
    var = (F.lit(1.0) - F.col("skew") * F.col("sr") + (F.col("kurtosis") - 1.0) / 4.0 * F.col("sr") * F.col("sr")) / n1
    v = F.coalesce(trial_variance, F.lit(1.0) / n1) if trial_variance is not None else F.lit(1.0) / n1
    df = df.withColumns({"_var": var, "sr0": F.sqrt(F.greatest(v, F.lit(0.0))) * expected_max_sharpe(F.lit(float(n_trials)))})
    p = F.when(F.col("_var") > 0, S.normal_cdf((F.col("sr") - F.col("sr0")) / F.sqrt("_var")))
    year = F.sqrt(F.lit(float(annual)))
    return df.select(*keys, "n_obs", F.col("sr").alias("sharpe_observed"), (F.col("sr") * year).alias("sharpe_annualized"),
                     F.col("sr0").alias("expected_max_sharpe"), (F.col("sr0") * year).alias("expected_max_sharpe_annual"),
                     p.alias("dsr_p_value"), "skew", "kurtosis")


def chunk_means(matrix: DataFrame, n_chunks: int) -> DataFrame:
    """(trial_id, chunk, metric): row labels cut into contiguous equal chunks.

    ``matrix`` rows: (row_id, trial_id, metric); distinct row labels are bounded by the calendar.
    """
    labels = row_numbers(matrix.select("row_id").distinct(), ["row_id"], "_i")
    numbered = labels.withColumns({"_i": F.col("_i") - 1, "_n": labels.agg(F.count(F.lit(1))).scalar()})
    # chunk c holds rows with floor(c*n/S) <= i < floor((c+1)*n/S)
    guess = F.floor((F.col("_i") + 1) * F.lit(n_chunks) / F.col("_n"))
    edge = lambda c: F.floor(c * F.col("_n") / F.lit(n_chunks))
    chunk = F.when(edge(guess) <= F.col("_i"), guess).otherwise(guess - 1)
    chunk = F.least(chunk, F.lit(n_chunks - 1)).cast("int")
    return matrix.join(numbered.select("row_id", chunk.alias("chunk")), "row_id").groupBy("trial_id", "chunk").agg(F.avg("metric").alias("metric"))


def overfitting_probability(matrix: DataFrame, n_chunks: int = 14) -> DataFrame:
    """Combinatorially symmetric cross-validation over chunk means.

    The chunk count falls to the number of rows, then to an even number; fewer than two chunks or four
    trials give no probability.  A trial without a value in some chunk has no defined performance in
    the splits, which need all chunks of all trials: the query then fails instead of leaving it out.

    Each trial is one row holding its chunk means; the C(S, S/2) splits are exploded from it,
    so trials x splits rows are built map-side and only per-split aggregates shuffle: first the
    in-sample winner, then its rank among out-of-sample values by counting.
    """
    size = matrix.agg(F.count_distinct("row_id").alias("rows"), F.count_distinct("trial_id").alias("trials")).first()
    s = min(int(n_chunks), size["rows"])
    s -= s % 2
    half = s // 2
    if s < 2 or size["trials"] < 4:
        return matrix.sparkSession.range(1).select(F.lit(None).cast("double").alias("pbo"), F.lit(None).cast("double").alias("median_logit"),
                                                   F.lit(0).cast("long").alias("n_splits"), F.lit(size["trials"]).cast("long").alias("n_trials"))
    trials = chunk_means(matrix, s).groupBy("trial_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("chunk", "metric"))), lambda x: x["metric"]).alias("m"))
    whole = F.raise_error(F.concat(F.lit("trial without a value in some chunk: "), F.col("trial_id").cast("string"))).cast("array<double>")
    trials = trials.withColumn("m", F.when(F.size("m") == s, F.col("m")).otherwise(whole))
    masks = F.filter(F.sequence(F.lit(0), F.lit(2 ** s - 1)), lambda x: F.bit_count(x) == half)
    bits = matrix.sparkSession.range(1).select(masks.alias("masks"))
    rows = trials.withColumn("split", F.explode(bits.scalar()))
    inside = sum((F.col("m")[i] * F.shiftright(F.col("split"), i).bitwiseAND(F.lit(1)) for i in range(s)), F.lit(0.0))
    total = sum((F.col("m")[i] for i in range(s)), F.lit(0.0))
    perf = rows.select("trial_id", "split", (inside / half).alias("is_perf"), ((total - inside) / half).alias("oos_perf"))
    best = perf.groupBy("split").agg(F.max_by("oos_perf", F.struct("is_perf", -F.col("trial_id"))).alias("best_oos"))
    ranks = perf.join(best, "split").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_trials"),
        (F.count_if(F.col("oos_perf") < F.col("best_oos")) + (F.count_if(F.col("oos_perf") == F.col("best_oos")) + 1) / F.lit(2.0)).alias("rank"))
    lam = S.logit(F.col("rank") / (F.col("n_trials") + 1))
    return ranks.select(lam.alias("lam"), "n_trials").agg(
        F.avg((F.col("lam") < 0).cast("double")).alias("pbo"), F.median("lam").alias("median_logit"),
        F.count(F.lit(1)).alias("n_splits"), F.max("n_trials").alias("n_trials"))


def verdicts(p: Column, pbo: Column) -> tuple[Column, Column]:
    """Bucket labels for the deflated Sharpe probability and for PBO."""
    dsr = F.when(p >= 0.95, "robust").when(p >= 0.75, "probable").when(p >= 0.50, "marginal").otherwise("possible overfitting")
    over = F.when(pbo < 0.20, "low").when(pbo < 0.50, "acceptable").otherwise("high")
    return F.when(p.isNotNull(), dsr), F.when(pbo.isNotNull(), over)
