"""Rules of allocation: bounds, caps, issuer groups, sector bands, checks, and scored candidate books.

Optimal books come from ``optimise``.  The candidates here are closed-form books and deterministic perturbations, feasible by
construction, scored as sums over (as-of, candidate) groups for all parameter trials of a search in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import ANCHOR_GROUPS, ISSUER_LIMIT, MAX_POSITION
from ..functions import scalars as S
from ..session import spread
from .covariance import centred, window_returns

# ------------------------------------------------------------------ bounds and checks


def sanitise_bounds(bounds: DataFrame, counts: DataFrame, max_position: float = MAX_POSITION, target: float = 1.0) -> DataFrame:
    """Make class bounds reachable: minimum at most n x cap, maximum at most the target, minima scaled to fit.

    ``bounds``: (asset_class, min_weight, max_weight); ``counts``: (asset_class, n).
    """
    df = bounds.join(counts, "asset_class", "left")
    reach = F.coalesce("n", F.lit(0)) * F.lit(max_position)
    low = F.when(F.col("min_weight") > reach + 1e-9, F.round(reach, 4)).otherwise(F.col("min_weight"))
    df = df.select("asset_class", low.alias("min_weight"), F.least("max_weight", F.lit(float(target))).alias("max_weight"))
    total = df.agg(F.sum("min_weight")).scalar()
    scale = F.when(total > target + 1e-9, F.lit(float(target)) / total).otherwise(F.lit(1.0))
    return df.withColumn("min_weight", F.col("min_weight") * scale)


def feasible_start(names: DataFrame, bounds: DataFrame, max_position: float = MAX_POSITION, min_position: float = 0.0,
                   target: float = 1.0) -> DataFrame:
    """(asof, ticker, weight): class midpoints spread evenly, scaled to the target, clipped once."""
    size = F.count(F.lit(1)).over(Window.partitionBy("as_of", "asset_class"))
    df = names.select("as_of", "ticker", "asset_class").withColumn("_n", size).join(bounds, "asset_class", "left")
    mid = (F.col("min_weight") + F.least(F.col("max_weight"), F.col("_n") * F.lit(max_position))) / F.lit(2.0)
    each = S.clip(mid / F.col("_n"), min_position, max_position)
    df = df.withColumn("_w", F.when(F.col("min_weight").isNotNull(), each).otherwise(F.lit(0.0)))
    whole = Window.partitionBy("as_of")
    total = F.sum("_w").over(whole)
    even = F.lit(float(target)) / F.count(F.lit(1)).over(whole)
    df = df.withColumn("_w1", F.when(total > 1e-9, F.col("_w") * F.lit(float(target)) / F.nullif(total, F.lit(0.0))).otherwise(even))
    over = F.max("_w1").over(whole) > max_position + 1e-9
    clipped = S.clip("_w1", min_position, max_position)
    df = df.withColumns({"_over": over, "_w2": F.when(over, clipped).otherwise(F.col("_w1"))})
    again = F.sum("_w2").over(whole)
    weight = F.when(F.col("_over") & (again > 1e-9), F.col("_w2") * F.lit(float(target)) / F.nullif(again, F.lit(0.0))).otherwise(F.col("_w2"))
    return df.select("as_of", "ticker", "asset_class", weight.alias("weight"))


def position_caps(universe: DataFrame, max_position: float = MAX_POSITION) -> DataFrame:
    """Per-ticker cap: the smaller of the general cap and the ticker's own."""
    return universe.select("ticker", F.least(F.lit(float(max_position)), F.coalesce("max_position_override", F.lit(float(max_position)))).alias("cap"))


def issuer_groups(universe: DataFrame) -> DataFrame:
    """Issuers with more than one ticker (single-ticker issuers are covered by the position cap)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("issuer_id"))
    return universe.select("ticker", "issuer_id", n.alias("n_tickers")).where(F.col("n_tickers") > 1)


def sector_bands(targets: DataFrame, universe: DataFrame, band: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """(bands, ticker map): anchor sectors grouped, normalised when above 1, with target +- band."""
    spark = universe.sparkSession
    table = spark.createDataFrame([(s, a) for a, group in ANCHOR_GROUPS.items() for s in group], "sector string, anchor string")
    grouped = targets.join(F.broadcast(table), "sector").groupBy("anchor").agg(F.sum("weight").alias("target"))
    total = grouped.agg(F.sum("target")).scalar()
    scaled = grouped.withColumn("target", F.col("target") / F.greatest(total, F.lit(1.0)))
    bands = scaled.select("anchor", "target", F.greatest(F.lit(0.0), F.col("target") - band).alias("min_weight"), F.least(F.lit(1.0), F.col("target") + band).alias("max_weight"))
    return bands, universe.select("ticker", "sector").join(F.broadcast(table), "sector").select("ticker", "anchor")


def violations(weights: DataFrame, universe: DataFrame, bounds: DataFrame, target: float = 1.0, max_position: float = MAX_POSITION,
               tol: float = 1e-4, keys: Sequence[str] = ("as_of",), anchor: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(keys, rule, item, amount) for every broken rule beyond the tolerance."""
    keys = list(keys)
    dims = position_caps(universe, max_position).join(universe.select("ticker", "asset_class", "issuer_id"), "ticker")
    df = weights.join(dims, "ticker", "left")
    w = F.col("weight")
    rows = []

    def add(frame, rule, item, amount):
        rows.append(frame.select(*keys, F.lit(rule).alias("rule"), item.cast("string").alias("item"), amount.alias("amount")))

    add(df, "position_cap", F.col("ticker"), w - F.coalesce("cap", F.lit(float(max_position))))
    add(df, "position_floor", F.col("ticker"), -w)
    add(df.groupBy(*keys).agg(F.abs(F.sum("weight") - F.lit(float(target))).alias("a")), "target_sum", F.lit("total"), F.col("a"))
    classes = df.groupBy(*keys, "asset_class").agg(F.sum("weight").alias("s")).join(bounds, "asset_class")
    add(classes, "class_min", F.col("asset_class"), F.least("min_weight", "max_weight") - F.col("s"))
    add(classes, "class_max", F.col("asset_class"), F.col("s") - F.col("max_weight"))
    issuers = weights.join(issuer_groups(universe), "ticker").groupBy(*keys, "issuer_id").agg(F.sum(F.abs("weight")).alias("s"))
    add(issuers, "issuer_limit", F.col("issuer_id"), F.col("s") - F.lit(ISSUER_LIMIT))
    if anchor is not None:
        bands, mapping = anchor
        sectors = weights.join(mapping, "ticker").groupBy(*keys, "anchor").agg(F.sum("weight").alias("s")).join(bands, "anchor")
        add(sectors, "sector_min", F.col("anchor"), F.col("min_weight") - F.col("s"))
        add(sectors, "sector_max", F.col("anchor"), F.col("s") - F.col("max_weight"))
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    return out.where(F.col("amount") > tol)


# ------------------------------------------------------------------ candidates


def candidate_books(names: DataFrame, universe: DataFrame, bounds: DataFrame, target: float = 0.9, n_random: int = 16,
                    max_position: float = MAX_POSITION, seed: int = 42, rounds: int = 6) -> DataFrame:
    """(asof, cand, ticker, weight): candidate 0 is the even midpoint book.

    ``names``: (asof, ticker, expected_return, vol).  Candidates share class budgets (the
    midpoint's) and differ in the shape inside a class: even, forecast tilt, inverse
    volatility, both, and log-normal perturbations of the tilt.  Caps hold by water filling:
    weight above a cap goes to uncapped names of the class, and issuer groups are scaled to
    their limit first.
    """
    dims = universe.select("ticker", "asset_class", "issuer_id").join(position_caps(universe, max_position), "ticker")
    issuers = issuer_groups(universe).select("ticker", F.lit(True).alias("_shared"))
    base = names.join(dims, "ticker").join(issuers, "ticker", "left")
    # Members of a shared issuer split the issuer limit between those present on the date.
    mates = F.count(F.lit(1)).over(Window.partitionBy("as_of", "issuer_id"))
    base = base.withColumn("_mates", mates)
    cap = F.when(F.col("_shared"), F.least(F.col("cap"), F.lit(ISSUER_LIMIT) / F.col("_mates"))).otherwise(F.col("cap"))
    base = base.withColumn("cap", cap)
    start = feasible_start(base, bounds, max_position, 0.0, target)
    budget = start.groupBy("as_of", "asset_class").agg(F.sum("weight").alias("budget"))
    # A class whose caps cannot hold its midpoint passes the rest to classes with room.
    room = base.groupBy("as_of", "asset_class").agg(F.sum("cap").alias("_room"))
    budget = budget.join(room, ["as_of", "asset_class"]).join(bounds.select("asset_class", "max_weight"), "asset_class", "left")
    day = Window.partitionBy("as_of")
    budget = budget.withColumn("_b", F.least("budget", "_room"))
    budget = budget.withColumn("_spare", F.greatest(F.least("_room", F.coalesce("max_weight", "_room")) - F.col("_b"), F.lit(0.0)))
    missing = F.greatest(F.lit(float(target)) - F.sum("_b").over(day), F.lit(0.0))
    share = F.least(F.coalesce(F.try_divide(missing, F.sum("_spare").over(day)), F.lit(0.0)), F.lit(1.0))
    budget = budget.select("as_of", "asset_class", (F.col("_b") + F.col("_spare") * share).alias("budget"))
    w = Window.partitionBy("as_of", "asset_class")
    z = (F.col("expected_return") - F.avg("expected_return").over(w)) / (F.stddev_pop("expected_return").over(w) + F.lit(1e-9))
    base = base.withColumns({"_z": S.clip(z, -3.0, 3.0), "_iv": F.lit(1.0) / F.greatest(F.coalesce("vol", F.lit(0.01)), F.lit(1e-4))})
    code = F.pmod(F.xxhash64("ticker"), F.lit(2 ** 20))
    when = F.date_diff("as_of", F.lit("1970-01-01").cast("date"))
    rows = base.join(budget, ["as_of", "asset_class"]).withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(3 + n_random))))
    rows = spread(rows, "as_of", "cand")  # every window below keeps this partitioning
    minor = F.col("cand") * F.lit(65536) + when
    noise = S.box_muller(S.hash_uniform(seed, 31, code, minor), S.hash_uniform(seed, 32, code, minor))
    shape = (F.when(F.col("cand") == 0, F.lit(1.0)).when(F.col("cand") == 1, F.exp(F.col("_z"))).when(F.col("cand") == 2, F.col("_iv"))
             .when(F.col("cand") == 3, F.col("_iv") * F.exp(F.col("_z"))).otherwise(F.exp(F.col("_z") + F.lit(0.7) * noise)))
    rows = rows.withColumn("_shape", shape).select("as_of", "cand", "ticker", "asset_class", "cap", "budget", "_shape")
    group = Window.partitionBy("as_of", "cand", "asset_class")
    rows = rows.withColumn("weight", F.col("budget") * F.col("_shape") / F.sum("_shape").over(group))
    for _ in range(rounds):
        capped = F.col("weight") >= F.col("cap") - 1e-12
        spare = F.col("budget") - F.sum(F.least("weight", "cap")).over(group)
        free = F.sum(F.when(~capped, F.col("weight")).otherwise(F.lit(0.0))).over(group)
        rows = rows.withColumns({"_spare": spare, "_free": free}).withColumn(
            "weight", F.when(capped, F.col("cap")).otherwise(F.col("weight") * (F.lit(1.0) + F.when(F.col("_free") > 1e-12, F.col("_spare") / F.col("_free")).otherwise(F.lit(0.0)))))
    return rows.select("as_of", "cand", "ticker", F.least("weight", "cap").alias("weight"))


def previous_books(books: DataFrame, cand: int = 0) -> DataFrame:
    """The rule book (one candidate) of the previous as-of date, the reference for trading costs."""
    w = Window.orderBy("as_of")  # as-of dates: one row per month
    nexts = books.select("as_of").distinct().withColumn("_next", F.lead("as_of").over(w)).where(F.col("_next").isNotNull())
    return books.where(F.col("cand") == cand).join(nexts, "as_of").select(F.col("_next").alias("as_of"), "ticker", F.col("weight").alias("prev_weight"))


def objective_terms(books: DataFrame, names: DataFrame, returns: DataFrame, liquidity: DataFrame, window: int = 63,
                    smooth: bool = True) -> DataFrame:
    """(asof, cand, ret_term, var_term, turn_term, impact_term), parameter free.

    Variance is that of the book's own window returns plus the shrinkage ridge, annualised;
    no covariance matrix is built.  Turnover is scaled by the mean absolute forecast; impact is
    annual volatility over liquidity, per unit traded.
    """
    asof = books.select(F.col("as_of").alias("date")).distinct()
    cells = centred(window_returns(returns.join(names.select("ticker").distinct(), "ticker", "left_semi"), asof, window))
    per_name = cells.groupBy("as_of", "ticker").agg(F.sum(F.col("z") * F.col("z")).alias("ss"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("age", "z"))).alias("path"))
    per_name = per_name.withColumn("path", F.col("path.z"))
    dims = names.select("as_of", "ticker", "expected_return").join(per_name, ["as_of", "ticker"], "left").join(liquidity.select("ticker", F.col("liquidity_score").alias("adtv")), "ticker", "left")
    prev = previous_books(books)
    size = F.greatest(F.avg(F.abs("expected_return")).over(Window.partitionBy("as_of")), F.lit(1e-4))
    dims = dims.withColumn("er_scale", size).join(prev, ["as_of", "ticker"], "left")
    df = books.join(dims, ["as_of", "ticker"])
    delta = F.col("weight") - F.coalesce("prev_weight", F.lit(0.0))
    moved = S.smooth_abs(delta) if smooth else F.abs(delta)
    vol = F.sqrt(F.coalesce(F.col("ss") / F.col("n"), F.lit(0.0)) * F.lit(252.0) + F.lit(1e-8))
    impact = vol / F.greatest(F.coalesce("adtv", F.lit(0.5)), F.lit(0.05))
    sums = df.groupBy("as_of", "cand").agg(
        F.sum(-F.col("weight") * F.col("expected_return")).alias("ret_term"), F.sum(moved * F.col("er_scale")).alias("turn_term"),
        F.sum(moved * impact).alias("impact_term"), F.sum(F.col("weight") * F.col("weight")).alias("w2"))
    daily = candidate_daily(df.select("as_of", "cand", "ticker", "weight", "path"))
    risk = daily.groupBy("as_of", "cand").agg(F.var_pop("r").alias("v"))
    k = factored_shrinkage(cells)
    out = sums.join(risk, ["as_of", "cand"], "left").join(k, "as_of", "left")
    s = F.coalesce("shrinkage", F.lit(0.0))
    var = ((F.lit(1.0) - s) * F.coalesce("v", F.lit(0.0)) + s * F.coalesce("mu", F.lit(0.0)) * F.col("w2")) * F.lit(252.0) + F.lit(1e-8) * F.col("w2")
    return out.select("as_of", "cand", "ret_term", var.alias("var_term"), "turn_term", "impact_term")


def candidate_daily(rows: DataFrame) -> DataFrame:
    """(asof, cand, age, r): window returns of every candidate book."""
    cells = rows.where(F.col("path").isNotNull()).select("as_of", "cand", "weight", F.posexplode("path").alias("age", "z"))
    return cells.groupBy("as_of", "cand", "age").agg(F.sum(F.col("weight") * F.col("z")).alias("r"))


def factored_shrinkage(cells: DataFrame) -> DataFrame:
    """(asof, shrinkage, mu) from the row Gram matrix X X' of each window (window x window numbers).

    ||X'X||^2 = ||X X'||^2, so each ticker contributes one small outer product that is summed;
    ticker pairs never appear.
    """
    from .covariance import _intensity

    paths = cells.groupBy("as_of", "ticker").agg(F.sort_array(F.collect_list(F.struct("age", "z"))).alias("p")).select("as_of", "ticker", F.col("p.z").alias("x"))

    def partial(batches):
        for pdf in batches:
            for asof, part in pdf.groupby("as_of"):
                length = part["x"].map(len).max()
                x = np.zeros((len(part), length))
                for i, v in enumerate(part["x"]):
                    x[i, : len(v)] = v
                g = x.T @ x
                yield pd.DataFrame({"as_of": asof, "i": np.repeat(np.arange(length), length), "j": np.tile(np.arange(length), length), "g": g.ravel(), "p": len(part)})

    grams = spread(paths, "as_of", "ticker").mapInPandas(partial, "as_of date, i int, j int, g double, p long").groupBy("as_of", "i", "j").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    stats = grams.groupBy("as_of").agg(
        F.sum(F.col("g") * F.col("g")).alias("s2"), F.sum(F.when(F.col("i") == F.col("j"), F.col("g"))).alias("tr"),
        F.sum(F.when(F.col("i") == F.col("j"), F.col("g") * F.col("g"))).alias("b4"), (F.max("i") + 1).cast("double").alias("n"), F.max("p").cast("double").alias("p"))
    return _intensity(stats).select("as_of", "shrinkage", "mu")


def score(terms: DataFrame, risk_aversion: float | Column = 4.0, turnover_penalty: float | Column = 0.05, impact_eta: float | Column = 0.1) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    value = F.col("ret_term") + lit(risk_aversion) * F.col("var_term") + lit(turnover_penalty) * F.col("turn_term") + lit(impact_eta) * F.col("impact_term")
    return terms.withColumn("objective", value)


def pick_best(scored: DataFrame, keys: Sequence[str] = ("as_of",)) -> DataFrame:
    return scored.groupBy(*keys).agg(F.min_by("cand", F.struct("objective", "cand")).alias("cand"), F.min("objective").alias("objective"))


def feasible_only(books: DataFrame, universe: DataFrame, bounds: DataFrame, target: float) -> DataFrame:
    """Candidates without a violation; the even book always stays as the fallback."""
    bad = violations(books, universe, bounds, target, keys=("as_of", "cand")).select("as_of", "cand").distinct().where(F.col("cand") > 0)
    return books.join(bad, ["as_of", "cand"], "left_anti")


