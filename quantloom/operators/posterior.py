"""Expected returns blended from market equilibrium and views, on a factored covariance.

With Sigma = (1 - s) Z'Z / T + s mu I, each view adds one rank-one term to a T x T matrix of window rows; no matrix of names by names,
nor of names by views, is formed.  A date's names, their window returns and views are one packed row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .covariance import window_returns
from .joins import asof_join
from .optimise import _intensity, _paths


def blend(z: np.ndarray, market: np.ndarray, view: np.ndarray, confidence: np.ndarray, risk_aversion: float, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """Prior and posterior of one date from centred window returns; a name without a view has NaN."""
    rows = len(z)
    s, mu = _intensity(z)
    times = lambda x: (1 - s) / rows * (z.T @ (z @ x)) + s * mu * x
    prior = risk_aversion * times(market)
    seen = np.flatnonzero(~np.isnan(view))
    if not len(seen):
        return prior, prior
    noise = tau * s * mu + tau / np.maximum(confidence[seen], 1e-6) + 1e-6
    part = np.sqrt(tau * (1 - s) / rows) * z[:, seen]
    miss = (view[seen] - prior[seen]) / noise
    inner = np.eye(rows) + (part / noise) @ part.T
    weight = np.zeros(len(view))
    weight[seen] = miss - part.T @ np.linalg.solve(inner, part @ miss) / noise
    return prior, prior + tau * times(weight)


def black_litterman(returns: DataFrame, asof: DataFrame, market: DataFrame, views: DataFrame, risk_aversion: float = 2.5, tau: float = 0.05, window: int = 63) -> DataFrame:
    """(as_of, ticker, prior, posterior) of every name with returns in the window before each date of ``asof``.

    ``market``: (ticker, market_weight); ``views``: (as_of, ticker, view, confidence).  Names without weight or view count as 0 and as none.
    """
    cells = window_returns(returns, asof, window)
    paths = cells.groupBy("as_of", "ticker").agg(F.collect_list("age").alias("ages"), F.collect_list("ret").alias("rets"))
    named = paths.join(market.select("ticker", "market_weight"), "ticker", "left").join(views.select("as_of", "ticker", "view", "confidence"), ["as_of", "ticker"], "left")
    entry = F.struct("ticker", F.coalesce("market_weight", F.lit(0.0)).alias("market_weight"), "view", "confidence", F.size("ages").alias("n"), "ages", "rets")
    packed = named.groupBy("as_of").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    packed = packed.select("as_of", F.lit(int(window)).alias("window"), *[F.col(f"e.{c}").alias(c) for c in ("ticker", "market_weight", "view", "confidence", "n")], *[F.flatten(F.col(f"e.{c}")).alias(c) for c in ("ages", "rets")])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                raw = _paths(row)
                z = np.nan_to_num(raw - np.nanmean(raw, axis=0))
                number = lambda c: np.array([np.nan if x is None else x for x in row[c]], float)  # noqa: B023,E731
                prior, posterior = blend(z, number("market_weight"), number("view"), np.nan_to_num(number("confidence")), risk_aversion, tau)
                yield pa.RecordBatch.from_arrays([pa.array([row["as_of"]] * len(prior), pa.date32()), pa.array(row["ticker"], pa.string()), pa.array(prior), pa.array(posterior)], names=["as_of", "ticker", "prior", "posterior"])

    return spread(packed, "as_of").mapInArrow(run, "as_of date, ticker string, prior double, posterior double")


def black_litterman_trials(returns: DataFrame, market: DataFrame, views: DataFrame, trials: DataFrame, window: int = 63) -> DataFrame:
    """(trial_id, as_of, ticker, posterior): ``black_litterman`` under many settings.

    ``views``: (trial_id, as_of, ticker, view, confidence); ``trials``: (trial_id, bl_risk_aversion, bl_tau).  A date's window is centred once for all trials with views on it.
    """
    cells = window_returns(returns, views.select(F.col("as_of").alias("date")).distinct(), window)
    paths = cells.groupBy("as_of", "ticker").agg(F.collect_list("age").alias("ages"), F.collect_list("ret").alias("rets"))
    entry = F.struct("ticker", F.coalesce("market_weight", F.lit(0.0)).alias("market_weight"), F.size("ages").alias("n"), "ages", "rets")
    packed = paths.join(market.select("ticker", "market_weight"), "ticker", "left").groupBy("as_of").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    packed = packed.select("as_of", F.lit(int(window)).alias("window"), *[F.col(f"e.{c}").alias(c) for c in ("ticker", "market_weight", "n")], *[F.flatten(F.col(f"e.{c}")).alias(c) for c in ("ages", "rets")])
    asked = views.join(trials, "trial_id").groupBy("as_of", "trial_id", "bl_risk_aversion", "bl_tau").agg(F.collect_list("ticker").alias("names"), F.collect_list("view").alias("view"), F.collect_list("confidence").alias("confidence"))
    asked = asked.groupBy("as_of").agg(F.collect_list(F.struct("trial_id", "bl_risk_aversion", "bl_tau", "names", "view", "confidence")).alias("asked"))

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                raw = _paths(row)
                z = np.nan_to_num(raw - np.nanmean(raw, axis=0))
                market_weight = np.asarray(row["market_weight"], float)
                place = {t: i for i, t in enumerate(row["ticker"])}
                for one in row["asked"]:
                    view, confidence = np.full(len(place), np.nan), np.zeros(len(place))
                    for name, v, c in zip(one["names"], one["view"], one["confidence"]):
                        if name in place:
                            view[place[name]], confidence[place[name]] = v, c
                    found = blend(z, market_weight, view, confidence, one["bl_risk_aversion"], one["bl_tau"])[1]
                    yield pa.RecordBatch.from_arrays([pa.array([one["trial_id"]] * len(found), pa.int64()), pa.array([row["as_of"]] * len(found), pa.date32()), pa.array(row["ticker"], pa.string()), pa.array(found)],
                                                     names=["trial_id", "as_of", "ticker", "posterior"])

    return spread(packed.join(asked, "as_of"), "as_of").mapInArrow(run, "trial_id long, as_of date, ticker string, posterior double")


def currency_return(macro: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, fx_return): mean log change of the dollar over the history known at each date, 0 before it."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(F.lit(1)).orderBy("date")  # months of one macro history
    change = macro.select("date", F.ln(F.col("usd_mxn") / F.lag("usd_mxn").over(w)).alias("c"))
    known = change.select("date", F.avg("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("fx_return"))
    return asof_join(dates.select("date").distinct(), known, [], ["fx_return"]).select("date", F.coalesce("fx_return", F.lit(0.0)).alias("fx_return"))


def adjusted(blended: DataFrame, universe: DataFrame, currency: DataFrame, hedge_ratio: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """(as_of, ticker, expected_return): posterior plus unhedged dollar exposure times the expected currency return of the date."""
    extra = F.coalesce("usd_exposure", F.lit(0.0)) * (1.0 - hedge_ratio) * F.coalesce("fx_return", F.lit(0.0))
    joined = blended.join(universe.select("ticker", "usd_exposure"), "ticker", "left").join(currency.withColumnRenamed("date", "as_of"), "as_of", "left")
    return joined.select(*keys, "as_of", "ticker", (F.col("posterior") + extra).alias("expected_return"))
