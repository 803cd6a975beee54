"""Conditional volatility by grid likelihood.

GARCH and GJR-GARCH(1,1) with variance targeting (omega follows from the sample variance), and EGARCH(1,1), a recursion of log variances, likewise
targeted.  A small grid of persistence parameters is enough, and every (series, window) is an independent row.  The recursion over time is the only
sequential part; all grid points, and all windows of equal length of a batch, advance together.  Where no point of a model has a finite likelihood, GARCH takes
its place and the fit says so.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions import windows as W
from ..session import spread
from .resampling import series_arrays

# Grid of persistence parameters (a stationary subset is kept).
ALPHAS = [0.0, 0.02, 0.04, 0.06, 0.08, 0.10, 0.15]
GAMMAS = [0.0, 0.04, 0.08, 0.12, 0.20]
BETAS = [0.50, 0.60, 0.70, 0.80, 0.85, 0.88, 0.90, 0.92, 0.94]


def grid(gammas=GAMMAS) -> np.ndarray:
    points = [(a, g, b) for a in ALPHAS for g in gammas for b in BETAS if a + g / 2.0 + b < 0.999]
    return np.asarray(points)


LOG_ALPHAS = [0.0, 0.02, 0.05, 0.08, 0.12, 0.16, 0.20, 0.30, 0.40]
LOG_BETAS = [0.50, 0.70, 0.80, 0.85, 0.90, 0.94, 0.96, 0.98, 0.99]
#: Mean absolute value of a standard normal.
NORMAL_SIZE = float(np.sqrt(2.0 / np.pi))
#: Fewest rows of a series for a conditional model, and fewest standardised returns for their quantile.
FEWEST_ROWS, FEWEST_RESIDUALS = 60, 30

#: Cells of the state arrays that windows times grid points may take.
CELLS = 1 << 20


def fit_windows(windows: list[np.ndarray], points: np.ndarray, model: str = "GJR") -> np.ndarray:
    """(omega, alpha, gamma, beta, nll, next variance, mean, variance) of the best grid point of each window; windows of equal length share one loop over time.

    NaN where a window is empty or no point has a finite likelihood.
    """
    out = np.full((len(windows), 8), np.nan)
    lengths: dict[int, list[int]] = {}
    for k, x in enumerate(windows):
        lengths.setdefault(len(x), []).append(k)
    a, g, b = points.T
    for n, which in lengths.items():
        together = max(CELLS // len(points), 1)
        for some in (which[at:at + together] for at in range(0, len(which), together)):
            if not n:
                continue
            x = np.stack([windows[k] for k in some])
            mean = x.mean(axis=1)
            e = x - mean[:, None]
            var = np.maximum((e * e).mean(axis=1), 1e-16)[:, None]
            logs = model == "EGARCH"
            omega = np.log(var) * (1.0 - b) if logs else var * (1.0 - a - g / 2.0 - b)
            h, nll = np.repeat(var, len(points), axis=1), np.zeros((len(some), len(points)))
            with np.errstate(all="ignore"):
                for t in range(n):
                    sq = (e[:, t] ** 2)[:, None]
                    nll += np.log(h) + sq / h
                    if logs:
                        size = np.abs(e[:, t])[:, None] / np.sqrt(h)
                        h = np.exp(omega + a * (size - NORMAL_SIZE) + b * np.log(h))
                    else:
                        h = omega + (a + g * (e[:, t] < 0)[:, None]) * sq + b * h
            nll = np.where(np.isfinite(nll) & np.isfinite(h), nll, np.inf)
            i = np.argmin(nll, axis=1)
            row = np.arange(len(some))
            found = np.column_stack((omega[row, i], a[i], g[i], b[i], 0.5 * nll[row, i] + 0.5 * n * np.log(2 * np.pi), h[row, i], mean, var[:, 0]))
            out[some] = np.where(np.isfinite(nll[row, i])[:, None], found, np.nan)
    return out


NUMBERS = ("omega", "alpha", "gamma", "beta", "nll", "next_var", "mean", "var")
PARAMS = T.StructType([*(T.StructField(n, T.DoubleType()) for n in NUMBERS), T.StructField("model", T.StringType()), T.StructField("fallback", T.BooleanType())])


def model_grid(model: str) -> np.ndarray:
    if model == "EGARCH":
        return np.asarray([(a, 0.0, b) for a in LOG_ALPHAS for b in LOG_BETAS])
    if model not in ("GARCH", "GJR"):
        raise ValueError(f"no volatility model {model!r}; use GARCH, GJR or EGARCH")
    return grid() if model == "GJR" else grid([0.0])


def _fit_udf(model: str):
    points, plain = model_grid(model), model_grid("GARCH")

    @F.pandas_udf(PARAMS)
    def fit(windows: pd.Series) -> pd.DataFrame:
        arrays = [np.asarray(x, dtype=np.float64) for x in windows]
        found = fit_windows(arrays, points, model)
        failed = np.isnan(found[:, 4])
        if failed.any():
            found[failed] = fit_windows([x for x, f in zip(arrays, failed) if f], plain, "GARCH")
        out = pd.DataFrame(found, columns=list(NUMBERS))
        out["model"], out["fallback"] = np.where(failed, "GARCH", model), failed
        return out

    return fit


def fit_series(series: DataFrame, model: str = "GJR", keys=("strategy_id",)) -> DataFrame:
    """One fit per series over its whole history."""
    arrays = series_arrays(series, list(keys), ["ret"])
    fitted = spread(arrays, *keys).select(*keys, "n", _fit_udf(model)("ret").alias("_f"))
    return fitted.select(*keys, "n", "_f.*")


def forecast(fits: DataFrame, horizon: int = 21) -> DataFrame:
    """Annualised volatility over the horizon: the mean of the variances to which the next one reverts, in closed form; EGARCH reverts in logarithms."""
    persistence = F.col("alpha") + F.col("gamma") / 2.0 + F.col("beta")
    long_run = F.col("omega") / (F.lit(1.0) - persistence)
    decay = (F.lit(1.0) - F.pow(persistence, F.lit(float(horizon)))) / ((F.lit(1.0) - persistence) * F.lit(float(horizon)))
    level = F.col("omega") / (F.lit(1.0) - F.col("beta"))
    steps = F.sequence(F.lit(0), F.lit(horizon - 1))
    logs = F.aggregate(steps, F.lit(0.0), lambda s, k: s + F.exp(level + (F.ln("next_var") - level) * F.pow(F.col("beta"), k.cast("double")))) / F.lit(float(horizon))
    mean_var = F.when(F.col("model") == "EGARCH", logs).otherwise(long_run + (F.col("next_var") - long_run) * decay)
    return fits.withColumn("annual_vol", F.sqrt(F.greatest(mean_var, F.lit(0.0)) * F.lit(252.0)))


def conditional_sigma(series: DataFrame, model: str = "GJR", keys=("strategy_id",)) -> DataFrame:
    """(keys, date, ret, residual, sigma): in-sample conditional volatility under the fitted parameters.

    One ordered pass over each series carries the variance; nothing but the row at hand is held.
    """
    keys = list(keys)
    fits = fit_series(series, model, keys)
    names = ("omega", "alpha", "gamma", "beta", "mean", "var", "model")
    rows = series.where(F.col("ret").isNotNull()).select(*keys, "date", "ret").join(fits.select(*keys, *names), keys)
    made = T.StructType([*(series.schema[k] for k in keys), *(T.StructField(n, T.DateType() if n == "date" else T.DoubleType()) for n in ("date", "ret", "residual", "sigma"))])
    arrow = to_arrow_schema(made)

    def walk(batches):
        now, h = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                if key != now:
                    now, h = key, r["var"]
                e = r["ret"] - r["mean"]
                out.append((*key, r["date"], r["ret"], e, math.sqrt(h)))
                if r["model"] == "EGARCH":
                    h = math.exp(r["omega"] + r["alpha"] * (abs(e) / math.sqrt(h) - NORMAL_SIZE) + r["beta"] * math.log(h))
                else:
                    h = r["omega"] + (r["alpha"] + (r["gamma"] if e < 0 else 0.0)) * e * e + r["beta"] * h
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "date").mapInArrow(walk, made)


def dynamic_var(series: DataFrame, alpha: float = 0.95, model: str = "GJR", keys=("strategy_id",)) -> DataFrame:
    """(keys, date, sigma, dynamic_var): conditional volatility times the quantile of the standardised residuals.

    A series of under ``FEWEST_ROWS`` returns has no model: its value is the quantile of up to 252 trailing returns, from 20 on.  Under ``FEWEST_RESIDUALS``
    residuals, returns over their standard deviation take their place.
    """
    keys = list(keys)
    known = series.where(F.col("ret").isNotNull()).select(*keys, "date", "ret")
    whole = Window.partitionBy(*keys)
    counted = known.withColumn("_n", F.count(F.lit(1)).over(whole))
    trailing = whole.orderBy("date").rowsBetween(-251, 0)
    short = counted.where(F.col("_n") < FEWEST_ROWS).withColumn("dynamic_var", F.when(F.count("ret").over(trailing) >= 20, F.percentile("ret", F.lit(1.0 - alpha)).over(trailing)))
    short = short.select(*keys, "date", F.lit(None).cast("double").alias("sigma"), "dynamic_var")
    long = conditional_sigma(counted.where(F.col("_n") >= FEWEST_ROWS).drop("_n"), model, keys)
    std = F.try_divide("residual", "sigma")
    usual = F.col("ret") / (F.stddev_pop("ret").over(whole) + F.lit(1e-9))
    z = F.when(F.count(std).over(whole) >= FEWEST_RESIDUALS, F.percentile(std, F.lit(1.0 - alpha)).over(whole)).otherwise(F.percentile("_u", F.lit(1.0 - alpha)).over(whole))
    long = long.withColumn("_u", usual).select(*keys, "date", "sigma", (F.col("sigma") * z).alias("dynamic_var"))
    return long.unionByName(short)


def rolling_forecast(series: DataFrame, horizon: int = 21, lookback: int = 252, refit_every: int = 5, model: str = "GJR", keys=("strategy_id",)) -> DataFrame:
    """Refit every k rows on the trailing window, winsorised and clamped, then held until the next fit."""
    keys = list(keys)
    lb, every = max(int(lookback), 100), max(int(refit_every), 1)
    w = Window.partitionBy(*keys).orderBy("date")
    known = series.where(F.col("ret").isNotNull()).select(*keys, "date", "ret")
    pos = known.withColumn("_pos", F.row_number().over(w) - 1)
    # only refit rows keep their window array
    due = (F.col("_pos") >= lb) & (F.pmod(F.col("_pos") - lb, F.lit(every)) == 0)
    frames = pos.withColumn("_x", F.collect_list("ret").over(w.rowsBetween(-lb, -1))).where(due)
    sorted_x = F.array_sort("_x")

    def at(q):
        h = (F.size("_x") - 1) * F.lit(q)
        lo = F.floor(h).cast("int")
        a, b = F.get("_s", lo), F.get("_s", F.least(lo + 1, F.size("_x") - 1))
        return a + (b - a) * (h - lo)

    frames = frames.withColumn("_s", sorted_x)
    frames = frames.withColumns({"_lo": at(0.01), "_hi": at(0.99)})
    clipped = F.transform("_x", lambda v: F.least(F.greatest(v, F.col("_lo")), F.col("_hi")))
    fitted = spread(frames, *keys, "date").withColumn("_f", _fit_udf(model)(clipped)).select(*keys, "date", "_x", "_f.*")
    mean = F.aggregate("_x", F.lit(0.0), lambda a, v: a + v) / F.size("_x")
    fitted = fitted.withColumn("_m", mean)
    real = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, v: a + (v - F.col("_m")) * (v - F.col("_m"))) / F.size("_x") * F.lit(252.0))
    vol = forecast(fitted.withColumn("_real", real), horizon)
    clamped = F.when(F.col("_real") > 1e-9, F.least(F.greatest("annual_vol", F.col("_real") * 0.6), F.col("_real") * 1.6)).otherwise(F.col("annual_vol"))
    points = vol.select(*keys, "date", clamped.alias("_g"))
    return known.join(points, [*keys, "date"], "left").withColumn("garch_vol", W.forward_fill("_g", w)).drop("_g", "ret")
