"""Row-frame window expressions over one series.

``w`` is always a ``Window.partitionBy(<series keys>).orderBy(<date>)``.  Series are at
day grain and unique per key, so a window group is bounded by the calendar length.
Frames are ROWS frames: windows count observations, not calendar days.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ALL_PRECEDING = Window.unboundedPreceding
TIE = 1e-12  # returns this close to a quantile count as equal to it


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def forward_fill(c, w: WindowSpec, limit: int | None = None) -> Column:
    start = ALL_PRECEDING if limit is None else -limit
    return F.last(col(c), ignorenulls=True).over(w.rowsBetween(start, 0))


def log_ratio(now: Column, before: Column) -> Column:
    """ln(now / before); NULL where the ratio is missing or not positive."""
    return F.when((before > 0) & (now > 0), F.ln(now / before))


def log_return(price, w: WindowSpec) -> Column:
    p = col(price)
    return F.coalesce(log_ratio(p, F.lag(p).over(w)), F.lit(0.0))


def skip_momentum(price, w: WindowSpec, window: int, skip: int) -> Column:
    p = col(price)
    return log_ratio(F.lag(p, skip).over(w), F.lag(p, window + skip).over(w))


def full_frame(value: Column, counted: Column, frame: WindowSpec, size: int) -> Column:
    """``value`` only where the frame holds ``size`` observations."""
    return F.when(F.count(counted).over(frame) >= size, value)


def lagged_volatility(ret, w: WindowSpec, window: int = 63) -> Column:
    frame = w.rowsBetween(-window, -1)
    r = col(ret)
    return full_frame(F.stddev_samp(r).over(frame), r, frame, window)


def rolling_stddev(ret, w: WindowSpec, window: int) -> Column:
    frame = w.rowsBetween(1 - window, 0)
    r = col(ret)
    return full_frame(F.stddev_samp(r).over(frame), r, frame, window)


def rolling_mean(x, w: WindowSpec, window: int) -> Column:
    frame = w.rowsBetween(1 - window, 0)
    c = col(x)
    return full_frame(F.avg(c).over(frame), c, frame, window)


def rolling_sharpe(ret, w: WindowSpec, window: int = 63) -> Column:
    return rolling_mean(ret, w, window) / F.nullif(rolling_stddev(ret, w, window), F.lit(0.0)) * F.sqrt(F.lit(252.0))


def rolling_quantile(x, w: WindowSpec, window: int, q: float) -> Column:
    frame = w.rowsBetween(1 - window, 0)
    c = col(x)
    return full_frame(F.percentile(c, F.lit(q)).over(frame), c, frame, window)


def expanding_zscore(x, w: WindowSpec, min_periods: int = 3) -> Column:
    """(x - mean) / (population sd + 1e-9) over all rows so far; NULL when sd is 0."""
    frame = w.rowsBetween(ALL_PRECEDING, 0)
    c = col(x)
    sd = F.nullif(F.stddev_pop(c).over(frame), F.lit(0.0)) + F.lit(1e-9)
    return full_frame((c - F.avg(c).over(frame)) / sd, c, frame, min_periods)


def expanding_zscore_floor(x, w: WindowSpec) -> Column:
    """(x - mean) / max(population sd, 1e-9) over all rows so far."""
    frame = w.rowsBetween(ALL_PRECEDING, 0)
    c = col(x)
    return (c - F.avg(c).over(frame)) / F.greatest(F.stddev_pop(c).over(frame), F.lit(1e-9))


def zscore_vs_history(x, w: WindowSpec, min_periods: int = 24) -> Column:
    """z of the current row against strictly earlier rows (sample sd); 0 when undefined."""
    prior = w.rowsBetween(ALL_PRECEDING, -1)
    c = col(x)
    sd = F.stddev_samp(c).over(prior)
    z = (c - F.avg(c).over(prior)) / sd
    ok = c.isNotNull() & (F.count(c).over(prior) >= min_periods - 1) & (sd > 1e-12)
    return F.when(ok, z).otherwise(F.lit(0.0))


def diff(x, w: WindowSpec, lag_rows: int) -> Column:
    return col(x) - F.lag(col(x), lag_rows).over(w)


def pct_change(x, w: WindowSpec, lag_rows: int) -> Column:
    return col(x) / F.nullif(F.lag(col(x), lag_rows).over(w), F.lit(0.0)) - F.lit(1.0)


def ewma(x, w: WindowSpec, alpha: float, lookback: int | None = None, min_periods: int = 1) -> Column:
    """Recursive EWMA (unadjusted) folded over a bounded frame.

    The lookback is where the dropped weight falls under 1e-13, so the fold is exact to
    double rounding.  NULLs before the first value are skipped by ``collect_list``; inner
    NULLs are not expected (series are filled at ingest).
    """
    if lookback is None:
        lookback = ewma_lookback(alpha)
    frame = w.rowsBetween(-lookback, 0)
    c = col(x)
    values = F.collect_list(c).over(frame)
    folded = F.aggregate(
        F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))),
        F.element_at(values, 1),
        lambda acc, v: acc * F.lit(1.0 - alpha) + v * F.lit(alpha),
    )
    n = F.count(c).over(w.rowsBetween(ALL_PRECEDING, 0))
    return F.when(c.isNotNull() & (n >= min_periods) & (F.size(values) > 0), folded)


def ewma_lookback(alpha: float) -> int:
    steps, weight = 0, 1.0
    while weight > 1e-13:
        weight *= 1.0 - alpha
        steps += 1
    return steps


def ewma_adjusted(x, w: WindowSpec, alpha: float) -> Column:
    """EWMA with normalised weights (adjusted form) over a bounded frame."""
    frame = w.rowsBetween(-ewma_lookback(alpha), 0)
    values = F.collect_list(col(x)).over(frame)
    start = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    return F.aggregate(
        values,
        start,
        lambda acc, v: F.struct(
            (acc["num"] * F.lit(1.0 - alpha) + v).alias("num"),
            (acc["den"] * F.lit(1.0 - alpha) + F.lit(1.0)).alias("den"),
        ),
        lambda acc: acc["num"] / acc["den"],
    )


def ewma_stddev(x, w: WindowSpec, span: int, min_periods: int) -> Column:
    """Bias-corrected EWMA standard deviation (unadjusted weights)."""
    alpha = 2.0 / (span + 1.0)
    frame = w.rowsBetween(-ewma_lookback(alpha), 0)
    c = col(x)
    values = F.collect_list(c).over(frame)
    # Weight of the first value decays by (1-a) each step, later values enter with a.
    start = F.struct(
        F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), F.lit(0.0).alias("w2"),
    )

    def step(acc, v):
        a = F.when(acc["n"] == 0, F.lit(1.0)).otherwise(F.lit(alpha))
        delta = v - acc["mean"]
        return F.struct(
            (acc["n"] + 1).alias("n"),
            (acc["mean"] + a * delta).alias("mean"),
            ((F.lit(1.0) - a) * (acc["m2"] + a * delta * delta)).alias("m2"),
            ((F.lit(1.0) - a) * (F.lit(1.0) - a) * acc["w2"] + a * a).alias("w2"),
        )

    var = F.aggregate(values, start, step, lambda acc: acc["m2"] / F.nullif(F.lit(1.0) - acc["w2"], F.lit(0.0)))
    n = F.count(c).over(w.rowsBetween(ALL_PRECEDING, 0))
    return F.when(n >= min_periods, F.sqrt(F.greatest(var, F.lit(0.0))))


def wealth(ret, w: WindowSpec) -> Column:
    return F.exp(F.sum(F.coalesce(col(ret), F.lit(0.0))).over(w.rowsBetween(ALL_PRECEDING, 0)))


def rolling_cvar_prior(x, w: WindowSpec, window: int, alpha: float) -> Column:
    """Mean of the tail (<= lower quantile) of the previous ``window`` rows."""
    frame = w.rowsBetween(-window, -1)
    c = col(x)
    level = F.percentile(c, F.lit(1.0 - alpha)).over(frame)
    tail = F.filter(F.collect_list(c).over(frame), lambda v: v <= level + F.lit(TIE))
    mean = F.aggregate(tail, F.lit(0.0), lambda acc, v: acc + v) / F.nullif(F.size(tail), F.lit(0))
    return full_frame(mean, c, frame, window)


def percent_rank_average(x, group, descending: bool = True) -> Column:
    """Average-tie percentile rank of non-NULL values inside ``group``.

    One window spec (one sort) gives both ends of a tie run: ``rank`` is the first
    position and a RANGE count up to the current row is the last.
    """
    c = col(x)
    order = c.desc_nulls_last() if descending else c.asc_nulls_last()
    keys = group if isinstance(group, (list, tuple)) else [group]
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.rank().over(w)
    last = F.count(c).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.count(c).over(Window.partitionBy(*keys))
    return F.when(c.isNotNull(), (first + last) / F.lit(2.0) / total)


def average_rank(x, group) -> Column:
    c = col(x)
    keys = group if isinstance(group, (list, tuple)) else [group]
    w = Window.partitionBy(*keys).orderBy(c.asc_nulls_last())
    first = F.rank().over(w)
    last = F.count(c).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(c.isNotNull(), (first + last) / F.lit(2.0))


def cross_zscore(x, group) -> Column:
    c = col(x)
    keys = group if isinstance(group, (list, tuple)) else [group]
    w = Window.partitionBy(*keys)
    return (c - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + F.lit(1e-9))
