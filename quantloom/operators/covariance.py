"""Shrunk covariances without pairing rows of a date.

Two forms are offered.  The *factored* form never builds a matrix: shrinkage intensity only
needs squared norms, and the variance of a book is the variance of its window returns plus a
ridge term.  The *tile* form emits the matrix itself as (asof, ticker_i, ticker_j, cov) rows:
tickers are cut into blocks, every (asof, block, block) tile is one dense product in a task,
and its rows are the result, nothing is paired and then thrown away.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..session import spread

BLOCK = 256


def window_returns(returns: DataFrame, asof: DataFrame, window: int) -> DataFrame:
    """(asof, age, date, ticker, ret): the last ``window`` calendar rows before each as-of date.

    Window membership is arithmetic on the business-day index; each as-of date explodes its
    own rows and equi-joins on that integer.
    """
    wanted = asof.select(F.col("date").alias("as_of"), S.business_day_index("date").alias("_end"))
    wanted = wanted.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(window - 1)))).select("as_of", "age", (F.col("_end") - F.col("age")).alias("_pos"))
    placed = returns.select("date", "ticker", F.coalesce("ret", F.lit(0.0)).alias("ret"), S.business_day_index("date").alias("_pos"))
    return placed.join(wanted, "_pos").drop("_pos")


def centred(windows: DataFrame) -> DataFrame:
    w = Window.partitionBy("as_of", "ticker")  # at most ``window`` rows
    return windows.withColumn("z", F.col("ret") - F.avg("ret").over(w))


def _tiles(cells: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """Sum over rows of weight x z_i x z_j for every ticker pair i <= j, as dense tiles.

    A cell is copied once per block (p / BLOCK copies), not once per partner ticker.
    """
    tickers = cells.select("ticker").distinct()
    n_blocks = F.greatest(F.ceil(tickers.agg(F.count(F.lit(1))).scalar() / F.lit(BLOCK)).cast("int"), F.lit(1))
    blocked = cells.withColumn("_b", F.pmod(F.xxhash64("ticker"), n_blocks).cast("int")).withColumn("_nb", n_blocks)
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("_nb") - 1), lambda o: F.struct(F.least(F.col("_b"), o).alias("bi"), F.greatest(F.col("_b"), o).alias("bj"))))
    copies = blocked.withColumn("_t", pairs).select(
        "as_of", F.col("_t.bi").alias("bi"), F.col("_t.bj").alias("bj"), "_b", "ticker", "age", F.col(value).alias("z"),
        (F.col(weight) if weight else F.lit(1.0)).alias("w"))

    def product(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asof, bi, bj = key
        rows = pdf.pivot_table(index="age", columns=["_b", "ticker"], values="z", aggfunc="sum", fill_value=0.0)
        w = pdf.groupby("age")["w"].first().reindex(rows.index).to_numpy()
        left = rows[bi] if bi in rows.columns.get_level_values(0) else rows.iloc[:, :0]
        right = rows[bj] if bj in rows.columns.get_level_values(0) else rows.iloc[:, :0]
        m = left.to_numpy().T @ (right.to_numpy() * w[:, None])
        li, ri = np.asarray(left.columns, dtype=object).ravel(), np.asarray(right.columns, dtype=object).ravel()
        a, b = np.repeat(li, len(ri)), np.tile(ri, len(li))
        out = pd.DataFrame({"as_of": asof, "ticker_i": a, "ticker_j": b, "s": m.ravel()})
        if bi == bj:
            return out[out.ticker_i <= out.ticker_j]
        swap = out.ticker_i > out.ticker_j
        out.loc[swap, ["ticker_i", "ticker_j"]] = out.loc[swap, ["ticker_j", "ticker_i"]].to_numpy()
        return out

    return spread(copies, "as_of", "bi", "bj").groupBy("as_of", "bi", "bj").applyInPandas(product, "as_of date, ticker_i string, ticker_j string, s double")


def shrinkage(cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """Ledoit-Wolf intensity per as-of date from centred cells and their cross sums.

    sum_ij sum_t (z_ti z_tj)^2 = sum_t (sum_i z_ti^2)^2, so only the squared sums need pairs.
    """
    per_row = cells.groupBy("as_of", "age").agg(F.sum(F.col("z") * F.col("z")).alias("q"), F.count(F.lit(1)).alias("p"))
    rows = per_row.groupBy("as_of").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("p").cast("double").alias("p"), F.sum(F.col("q") * F.col("q")).alias("b4"))
    twice = F.when(F.col("ticker_i") == F.col("ticker_j"), F.lit(1.0)).otherwise(F.lit(2.0))
    norms = tiles.groupBy("as_of").agg(
        F.sum(twice * F.col("s") * F.col("s")).alias("s2"), F.sum(F.when(F.col("ticker_i") == F.col("ticker_j"), F.col("s"))).alias("tr"))
    return _intensity(rows.join(norms, "as_of"))


def _intensity(df: DataFrame) -> DataFrame:
    n, p = F.col("n"), F.col("p")
    df = df.withColumns({"_delta_raw": F.col("s2") / (n * n), "trace": F.col("tr") / n})
    df = df.withColumn("mu", F.col("trace") / p)
    beta = (F.col("b4") / n - F.col("_delta_raw")) / (p * n)
    delta = (F.col("_delta_raw") - F.lit(2.0) * F.col("mu") * F.col("trace") + p * F.col("mu") * F.col("mu")) / p
    df = df.withColumns({"_beta": beta, "_delta": delta})
    shrink = F.when(F.least("_beta", "_delta") == 0, F.lit(0.0)).otherwise(F.least("_beta", "_delta") / F.nullif(F.col("_delta"), F.lit(0.0)))
    return df.select("as_of", "n", "p", "mu", F.coalesce(shrink, F.lit(0.0)).alias("shrinkage"))


def ledoit_wolf(returns: DataFrame, asof: DataFrame, window: int = 63, min_rows: int = 10) -> DataFrame:
    """(asof, ticker_i, ticker_j, cov): rolling shrunk covariance; few rows give average variance x identity."""
    cells = centred(window_returns(returns, asof, window))
    tiles = _tiles(cells, "z")
    k = shrinkage(cells, tiles)
    same = F.col("ticker_i") == F.col("ticker_j")
    full = (F.lit(1.0) - F.col("shrinkage")) * F.col("s") / F.col("n") + F.when(same, F.col("shrinkage") * F.col("mu")).otherwise(F.lit(0.0))
    flat = F.when(same, F.col("mu") * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0.0))).otherwise(F.lit(0.0))
    return tiles.join(k, "as_of").select("as_of", "ticker_i", "ticker_j", F.when(F.col("n") < min_rows, flat).otherwise(full).alias("cov"))


def ewma_ledoit_wolf(returns: DataFrame, asof: DataFrame, window: int = 252, decay: float = 0.94, min_rows: int = 60) -> DataFrame:
    """EWMA covariance (bias corrected) shrunk by the unweighted intensity toward trace/p x identity."""
    cells = centred(window_returns(returns, asof, window))
    k = shrinkage(cells, _tiles(cells, "z"))
    rows = cells.join(k.select("as_of", "n"), "as_of")
    oldest = F.col("age") == F.col("n").cast("int") - 1
    weight = F.pow(F.lit(decay), F.col("age")) * F.when(oldest, F.lit(1.0)).otherwise(F.lit(1.0 - decay))
    rows = rows.withColumn("w", weight)
    mean = F.sum(F.col("w") * F.col("ret")).over(Window.partitionBy("as_of", "ticker"))
    rows = rows.withColumn("zw", F.col("ret") - mean)
    per_date = rows.groupBy("as_of", "age").agg(F.first("w").alias("w")).groupBy("as_of").agg(F.sum(F.col("w") * F.col("w")).alias("w2"))
    tiles = _tiles(rows.select("as_of", "age", "ticker", "zw", "w"), "zw", "w").join(per_date, "as_of")
    raw = tiles.withColumn("c", F.col("s") / F.nullif(F.lit(1.0) - F.col("w2"), F.lit(0.0)))
    same = F.col("ticker_i") == F.col("ticker_j")
    trace = raw.groupBy("as_of").agg(F.sum(F.when(same, F.col("c"))).alias("tr"))
    joined = raw.join(trace, "as_of").join(k.where(F.col("n") >= min_rows), "as_of")
    target = F.when(same, F.col("shrinkage") * F.col("tr") / F.col("p")).otherwise(F.lit(0.0))
    return joined.select("as_of", "ticker_i", "ticker_j", ((F.lit(1.0) - F.col("shrinkage")) * F.col("c") + target).alias("cov"))


def correlation(cov: DataFrame) -> DataFrame:
    var = cov.where(F.col("ticker_i") == F.col("ticker_j")).select("as_of", F.col("ticker_i").alias("_t"), F.sqrt(F.greatest("cov", F.lit(0.0))).alias("_sd"))
    left = var.withColumnsRenamed({"_t": "ticker_i", "_sd": "sd_i"})
    right = var.withColumnsRenamed({"_t": "ticker_j", "_sd": "sd_j"})
    raw = F.col("cov") / (F.col("sd_i") * F.col("sd_j") + F.lit(1e-12))
    return cov.join(left, ["as_of", "ticker_i"]).join(right, ["as_of", "ticker_j"]).select(
        "as_of", "ticker_i", "ticker_j", F.least(F.greatest(raw, F.lit(-1.0)), F.lit(1.0)).alias("corr"))


def portfolio_law(book: DataFrame, returns: DataFrame) -> DataFrame:
    """(strategy, mu, sigma) of books under the shrunk covariance of all tickers, full history.

    Factored: sigma^2 = (1 - s) var(book returns) + s * mean variance * sum of squared weights.
    The squared Frobenius norm that sets ``s`` comes from the tile sums.
    """
    cells = returns.select(F.lit("1970-01-01").cast("date").alias("as_of"), S.business_day_index("date").alias("age"), "ticker",
                           (F.col("ret") - F.avg("ret").over(Window.partitionBy("ticker"))).alias("z"))
    k = shrinkage(cells, _tiles(cells, "z")).select("shrinkage", F.col("mu").alias("mean_var"))
    total = F.sum("weight").over(Window.partitionBy("strategy_id"))
    normal = book.select("strategy_id", "ticker", (F.col("weight") / F.greatest(total, F.lit(1e-9))).alias("w"))
    ridge = normal.groupBy("strategy_id").agg(F.sum(F.col("w") * F.col("w")).alias("w2"))
    daily = returns.join(normal, "ticker").groupBy("strategy_id", "date").agg(F.sum(F.col("w") * F.col("ret")).alias("r"))
    stats = daily.groupBy("strategy_id").agg(F.avg("r").alias("mu"), F.var_pop("r").alias("v")).join(ridge, "strategy_id")
    s, m = k.select("shrinkage").scalar(), k.select("mean_var").scalar()
    return stats.select("strategy_id", "mu", F.sqrt((F.lit(1.0) - s) * F.col("v") + s * m * F.col("w2")).alias("sigma"))
