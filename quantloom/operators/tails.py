"""Extreme-value tail by probability-weighted moments: three ordered sums, closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import TIE


# Lanczos coefficients (g = 7, n = 9) for the gamma function.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def gamma_one_plus(k: Column) -> Column:
    """Gamma(1 + k) for k > -1 as a column expression."""
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        total = total + F.lit(c) / (k + F.lit(float(i)))
    t = k + F.lit(7.5)
    return F.sqrt(F.lit(6.283185307179586)) * F.pow(t, k + F.lit(0.5)) * F.exp(-t) * total


def gev_cdf(x: Column, k: Column, loc: Column, scale: Column) -> Column:
    y = F.lit(1.0) - k * (x - loc) / scale
    inside = F.exp(-F.pow(F.when(y > 0, y), F.lit(1.0) / F.nullif(k, F.lit(0.0))))
    flat = F.exp(-F.exp(-(x - loc) / scale))
    return F.when(F.abs(k) < 1e-9, flat).when(y <= 0, F.when(k > 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(inside)


def gev_quantile(p, k: Column, loc: Column, scale: Column) -> Column:
    y = -F.ln(p if isinstance(p, Column) else F.lit(float(p)))
    return loc + scale * F.when(F.abs(k) < 1e-9, -F.ln(y)).otherwise((F.lit(1.0) - F.pow(y, k)) / F.nullif(k, F.lit(0.0)))


def gev_fit(series: DataFrame, keys=("strategy_id",)) -> DataFrame:
    """(keys, n_tail, shape, loc, scale, ks) of the losses of each series."""
    keys = list(keys)
    losses = series.where(F.col("ret") < 0).select(*keys, "date", (-F.col("ret")).alias("x"))
    order = Window.partitionBy(*keys).orderBy("x", "date")
    ranked = losses.withColumns({"i": F.row_number().over(order).cast("double"), "n": F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("double")})
    w1 = (F.col("i") - 1) / F.nullif(F.col("n") - 1, F.lit(0.0))
    w2 = w1 * (F.col("i") - 2) / F.nullif(F.col("n") - 2, F.lit(0.0))
    pwm = ranked.groupBy(*keys).agg(
        F.first("n").cast("long").alias("n_tail"), F.avg("x").alias("b0"), F.avg(F.col("x") * w1).alias("b1"), F.avg(F.col("x") * w2).alias("b2"))
    c = (F.lit(2.0) * F.col("b1") - F.col("b0")) / F.nullif(F.lit(3.0) * F.col("b2") - F.col("b0"), F.lit(0.0)) - F.lit(0.6309297535714574)
    df = pwm.withColumn("_c", c)
    df = df.withColumn("shape", F.lit(7.859) * F.col("_c") + F.lit(2.9554) * F.col("_c") * F.col("_c"))
    df = df.withColumn("_g", gamma_one_plus(F.col("shape")))
    spread = F.nullif(F.col("_g") * (F.lit(1.0) - F.pow(F.lit(2.0), -F.col("shape"))), F.lit(0.0))
    df = df.withColumn("scale", (F.lit(2.0) * F.col("b1") - F.col("b0")) * F.col("shape") / spread)
    df = df.withColumn("loc", F.col("b0") + F.col("scale") * (F.col("_g") - 1) / F.nullif(F.col("shape"), F.lit(0.0)))
    params = df.select(*keys, "n_tail", "shape", "loc", "scale")
    cdf = gev_cdf(F.col("x"), F.col("shape"), F.col("loc"), F.col("scale"))
    gap = F.greatest(F.col("i") / F.col("n") - F.col("_f"), F.col("_f") - (F.col("i") - 1) / F.col("n"))
    ks = ranked.join(params, keys).withColumn("_f", cdf).groupBy(*keys).agg(F.max(gap).alias("ks"))
    return params.join(ks, keys)


def ks_pvalue(ks: Column, n: Column, terms: int = 20) -> Column:
    """Asymptotic Kolmogorov p-value."""
    root = F.sqrt(n.cast("double"))
    lam = (root + F.lit(0.12) + F.lit(0.11) / root) * ks
    total = F.lit(0.0)
    for j in range(1, terms + 1):
        total = total + F.lit(2.0 * (-1) ** (j - 1)) * F.exp(F.lit(-2.0 * j * j) * lam * lam)
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def gev_var(series: DataFrame, alpha: float = 0.95, keys=("strategy_id",), points: int = 1000) -> DataFrame:
    """(keys, method, var, cvar) as negative returns.

    The fit is used with at least 20 losses and a KS p-value of .05 or more, otherwise the
    empirical quantile.  The tail mean is a trapezoid sum of x dF up to the .9999 quantile.
    """
    keys = list(keys)
    fits = gev_fit(series, keys)
    k, loc, scale = F.col("shape"), F.col("loc"), F.col("scale")
    fits = fits.withColumns({"_p": ks_pvalue(F.col("ks"), F.col("n_tail")), "_v": gev_quantile(alpha, k, loc, scale), "_top": gev_quantile(0.9999, k, loc, scale)})
    step = (F.col("_top") - F.col("_v")) / F.lit(float(points - 1))
    grid = fits.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("_x", F.col("_v") + step * F.col("_j"))
    y = F.lit(1.0) - k * (F.col("_x") - loc) / scale
    t = F.when(F.abs(k) < 1e-9, F.exp(-(F.col("_x") - loc) / scale)).otherwise(F.pow(F.greatest(y, F.lit(1e-300)), F.lit(1.0) / F.nullif(k, F.lit(0.0))))
    density = F.pow(t, F.lit(1.0) - k) * F.exp(-t) / scale
    edge = F.when((F.col("_j") == 0) | (F.col("_j") == points - 1), F.lit(0.5)).otherwise(F.lit(1.0))
    area = grid.groupBy(*keys).agg(F.sum(edge * F.col("_x") * density * step).alias("_area"))
    level = F.percentile("ret", F.lit(1.0 - alpha)).over(Window.partitionBy(*keys))
    empirical = series.withColumn("_l", level).groupBy(*keys).agg(
        F.first("_l").alias("_ev"), F.avg(F.when(F.col("ret") <= F.col("_l") + TIE, F.col("ret"))).alias("_ec"))
    out = empirical.join(fits, keys, "left").join(area, keys, "left")
    good = (F.col("n_tail") >= 20) & (F.col("_p") >= 0.05)
    good = F.coalesce(good, F.lit(False))
    return out.select(*keys, F.when(good, "gev").otherwise("empirical").alias("method"),
                      F.when(good, -F.col("_v")).otherwise(F.col("_ev")).alias("gev_var"),
                      F.when(good, -F.col("_area") / F.lit(1.0 - alpha)).otherwise(F.col("_ec")).alias("gev_cvar"))
