"""Stationary block bootstrap over many series at once.

A series at day grain is bounded by the calendar, so it travels as one array.  Each
(series, chunk of replicates) row is an independent unit of work that Spark spreads over the
cluster; inside a task NumPy draws the circular geometric blocks for the whole chunk.  The
replicate x position grid never leaves the task, and draws depend only on their coordinates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions.windows import TIE
from ..session import spread

CHUNK = 250


def series_arrays(series: DataFrame, keys: Sequence[str], values: Sequence[str], fill: float | None = None) -> DataFrame:
    """One row per series with date-ordered arrays; rows with a missing value are dropped or filled."""
    clean = series.select(*keys, "date", *[S.finite(F.col(v)).alias(v) for v in values])
    clean = clean.fillna(fill, subset=list(values)) if fill is not None else clean.dropna(subset=list(values))
    packed = clean.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", *values))).alias("_p"))
    return packed.select(*keys, *[F.col(f"_p.{v}").alias(v) for v in values], F.size("_p").alias("n"))


def block_indices(seed: int, reps: np.ndarray, n: int, block: float) -> np.ndarray:
    """Source positions (len(reps) x n): a new block starts with probability 1/block."""
    pos = np.arange(n, dtype=np.int64)
    fresh = S.hash_uniform_np(seed, 1, reps[:, None], pos[None, :]) < 1.0 / block
    fresh[:, 0] = True
    starts = np.floor(S.hash_uniform_np(seed, 2, reps[:, None], pos[None, :]) * n).astype(np.int64)
    opened = np.maximum.accumulate(np.where(fresh, pos[None, :], 0), axis=1)
    return (np.take_along_axis(starts, opened, axis=1) + pos[None, :] - opened) % n


def _sharpe(x, rf):
    return np.sqrt(252.0) * (x.mean(1) - rf / 252.0) / (x.std(1) + 1e-9)


def _sortino(x, rf):
    mar = rf / 252.0
    short = np.where(x < mar, x - mar, 0.0)
    k = (x < mar).sum(1)
    down = np.where(k > 1, np.sqrt((short ** 2).sum(1) / np.maximum(k, 1)), 0.0)
    return (x.mean(1) - mar) / (down + 1e-9) * np.sqrt(252.0)


def _cvar(x, rf):
    level = np.quantile(x, 0.05, axis=1)[:, None]
    hit = x <= level + TIE
    return np.where(hit, x, 0.0).sum(1) / np.maximum(hit.sum(1), 1)


def _drawdown(x, rf):
    wealth = np.exp(np.cumsum(x, axis=1))
    return (wealth / np.maximum.accumulate(wealth, axis=1) - 1.0).min(1)


METRICS: dict[str, Callable] = {
    "sharpe": _sharpe,
    "sortino": _sortino,
    "cvar_95": _cvar,
    "max_drawdown": _drawdown,
    "cagr": lambda x, rf: np.exp(x.mean(1) * 252.0) - 1.0,
    "mean": lambda x, rf: x.mean(1),
}


def _pair_beta(f, b):
    fc, bc = f - f.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    n = f.shape[1]
    if n < 20:
        return np.ones(f.shape[0])
    return (fc * bc).sum(1) / (n - 1) / ((bc * bc).sum(1) / (n - 1) + 1e-12)


def _pair_alpha(f, b, rf):
    annual = lambda x: np.exp(x.mean(1) * 252.0) - 1.0
    return annual(f) - (rf + _pair_beta(f, b) * (annual(b) - rf))


PAIR_METRICS: dict[str, Callable] = {
    "alpha_annualized": _pair_alpha,
    "information_ratio": lambda f, b, rf: np.sqrt(252.0) * (f - b).mean(1) / ((f - b).std(1) + 1e-9),
    "tracking_error": lambda f, b, rf: (f - b).std(1) * np.sqrt(252.0),
}


def _chunks(arrays: DataFrame, n_reps: int) -> DataFrame:
    """One row per (series, replicate chunk), spread evenly: a single long job list, no hot key."""
    jobs = arrays.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(n_reps - 1), F.lit(CHUNK))))
    return spread(jobs, *[c for c in arrays.columns if c not in ("ret", "bench", "n")], "_first")


def _metric_rows(arrays, keys, values, compute, names, n_reps, block, seed) -> DataFrame:
    key_fields = [arrays.schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField("rep", T.IntegerType()), T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])
    fixed_block = None if isinstance(block, str) else max(float(block), 2.0)

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                data = [np.asarray(row[v], dtype=np.float64) for v in values]
                size = fixed_block if fixed_block is not None else max(float(row[block]), 2.0)
                reps = np.arange(row["_first"], min(row["_first"] + CHUNK, n_reps), dtype=np.int64)
                where = block_indices(seed, reps, len(data[0]), size)
                samples = [d[where] for d in data]
                for name in names:
                    out = pd.DataFrame({"rep": reps.astype(np.int32), "metric": name, "value": compute[name](*samples)})
                    for k in keys:
                        out[k] = row[k]
                    yield out[[f.name for f in schema.fields]]

    usable = arrays.where(F.col("n") >= 5)
    return _chunks(usable, n_reps).mapInPandas(run, schema)


def bootstrap_metrics(series: DataFrame, keys=("strategy_id",), metrics: Sequence[str] = ("sharpe", "sortino", "cvar_95", "max_drawdown", "cagr"),
                      n_reps: int = 5000, block: float = 20, seed: int = 42, risk_free: float = 0.02, custom: dict[str, Callable] | None = None) -> DataFrame:
    """(keys, rep, metric, value) for every replicate; ``custom`` maps a name to fn(matrix)->vector."""
    keys = list(keys)
    table = {k: (lambda x, fn=METRICS[k]: fn(x, risk_free)) for k in metrics if k in METRICS}
    table.update(custom or {})
    return _metric_rows(series_arrays(series, keys, ["ret"]), keys, ["ret"], table, list(table), n_reps, block, seed)


def bootstrap_pairs(pairs: DataFrame, keys, n_reps: int = 5000, block: float | str = 20, seed: int = 42, risk_free: float = 0.04,
                    metrics: Sequence[str] = tuple(PAIR_METRICS), custom: dict[str, Callable] | None = None) -> DataFrame:
    """Same indices for both series of a pair (columns ``ret`` and ``bench``)."""
    keys = list(keys)
    table = {k: (lambda f, b, fn=PAIR_METRICS[k]: fn(f, b, risk_free)) for k in metrics if k in PAIR_METRICS}
    table.update(custom or {})
    return _metric_rows(series_arrays(pairs, keys, ["ret", "bench"]), keys, ["ret", "bench"], table, list(table), n_reps, block, seed)


def summarise(distribution: DataFrame, points: DataFrame, keys, confidence: float = 0.95) -> DataFrame:
    """Percentile interval, standard error and sign p-value; ``points`` rows (keys, metric, point)."""
    keys = list(keys)
    tail = (1.0 - confidence) / 2.0
    joined = distribution.join(points, [*keys, "metric"])
    against = F.when(F.col("point") > 0, F.col("value") <= 0.0).otherwise(F.col("value") >= 0.0)
    stats = joined.groupBy(*keys, "metric").agg(
        F.first("point").alias("point"), F.percentile("value", F.lit(tail)).alias("ci_low"),
        F.percentile("value", F.lit(1.0 - tail)).alias("ci_high"), F.stddev_samp("value").alias("se"),
        F.avg(against.cast("double")).alias("_p"), F.count("value").alias("n_reps"))
    return stats.withColumn("p_value", F.when(F.abs("point") < 1e-12, F.lit(1.0)).otherwise(F.col("_p"))).drop("_p")


def bootstrap_paths(series: DataFrame, keys=("strategy_id",), n_paths: int = 1000, block: float = 20, seed: int = 42) -> DataFrame:
    """(keys, path_id, pos, ret): resampled return paths."""
    keys = list(keys)
    arrays = series_arrays(series, keys, ["ret"], fill=0.0)
    size = max(float(block), 2.0)
    schema = T.StructType([*[arrays.schema[k] for k in keys], T.StructField("path_id", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("ret", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                data = np.asarray(row["ret"], dtype=np.float64)
                reps = np.arange(row["_first"], min(row["_first"] + CHUNK, n_paths), dtype=np.int64)
                sample = data[block_indices(seed, reps, len(data), size)]
                out = pd.DataFrame({"path_id": np.repeat(reps, len(data)).astype(np.int32),
                                    "pos": np.tile(np.arange(len(data), dtype=np.int32), len(reps)), "ret": sample.ravel()})
                for k in keys:
                    out[k] = row[k]
                yield out[[f.name for f in schema.fields]]

    return _chunks(arrays, n_paths).mapInPandas(run, schema)


def fan_chart(paths: DataFrame, keys=("strategy_id",)) -> DataFrame:
    """Quantiles of the wealth paths per position."""
    from pyspark.sql.window import Window

    keys = list(keys)
    w = Window.partitionBy(*keys, "path_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    wealth = paths.withColumn("wealth", F.exp(F.sum("ret").over(w)))
    q = F.percentile("wealth", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    rows = wealth.groupBy(*keys, "pos").agg(q.alias("_q"))
    return rows.select(*keys, "pos", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p05", "p25", "median", "p75", "p95"))])


def optimal_block_length(series: DataFrame, keys=("strategy_id",), value: str = "ret") -> DataFrame:
    """Automatic block length for the stationary bootstrap (Politis-White with the 2009 correction).

    Lag sums are array expressions on the series row: about sqrt(n) lags, no self-join.
    """
    keys = list(keys)
    arrays = series_arrays(series, keys, [value])
    mean = F.aggregate(value, F.lit(0.0), lambda a, x: a + x) / F.col("n")
    df = arrays.withColumn("_mean", mean).withColumn("e", F.transform(value, lambda x: x - F.col("_mean")))
    df = df.withColumn("kn", F.greatest(F.lit(5), F.floor(F.log10("n")).cast("int")))
    df = df.withColumn("mmax", F.ceil(F.sqrt("n")).cast("int") + F.col("kn"))
    df = df.where(F.col("n") > F.col("mmax") + 1)
    df = df.withColumn("sq", F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    lags = F.sequence(F.lit(0), F.col("mmax"))
    n = F.col("n")
    df = df.withColumn("cross", F.transform(lags, lambda k: total(F.zip_with(F.slice("e", k + 1, n - k), F.slice("e", F.lit(1), n - k), lambda a, b: a * b))))
    df = df.withColumn("acorr", F.transform(lags, lambda k: F.abs(F.get("cross", k)) / F.sqrt(
        total(F.transform(F.slice("e", k + 2, n), lambda x: x * x)) * total(F.transform(F.slice("e", F.lit(1), n - k - 1), lambda x: x * x)))))
    cv = F.lit(2.0) * F.sqrt(F.log10("n") / n)
    df = df.withColumn("cv", cv)
    quiet = F.filter(F.sequence(F.col("kn"), F.col("mmax")), lambda i: F.forall(F.slice("acorr", i - F.col("kn") + 1, F.col("kn")), lambda x: x < F.col("cv")))
    df = df.withColumn("opt", F.get(quiet, F.lit(0)) - F.col("kn"))
    df = df.withColumn("m", F.when(F.col("opt").isNull(), F.col("mmax")).otherwise(F.least(F.lit(2) * F.greatest("opt", F.lit(1)), F.col("mmax"))))
    lam = lambda k: F.when(k / F.col("m") <= 0.5, F.lit(1.0)).otherwise(F.lit(2.0) * (F.lit(1.0) - k / F.col("m")))
    inner = F.sequence(F.lit(1), F.col("m"))
    acv = lambda k: F.get("cross", k) / n
    df = df.withColumn("g", total(F.transform(inner, lambda k: F.lit(2.0) * lam(k) * k * acv(k))))
    df = df.withColumn("lr", acv(F.lit(0)) + total(F.transform(inner, lambda k: F.lit(2.0) * lam(k) * acv(k))))
    raw = F.pow(F.lit(2.0) * F.col("g") * F.col("g") / (F.lit(2.0) * F.col("lr") * F.col("lr")) * n, F.lit(1.0 / 3.0))
    bound = F.ceil(F.least(F.lit(3.0) * F.sqrt("n"), n / F.lit(3.0)))
    df = df.withColumn("block_raw", F.least(raw, bound.cast("double")))
    return df.select(*keys, "n", "m", "block_raw", F.least(F.greatest(F.round("block_raw").cast("int"), F.lit(5)), F.lit(60)).alias("block"))
