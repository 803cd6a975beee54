"""Optimal books: mean-variance, mean-tail-loss and resampled, with caps, class bounds, issuer limits and sector bands as constraints.

Trading costs refer to the book that a strategy really holds, so its dates depend on each other: a strategy is one ordered stream of packed problems
(a date's names, limits and window returns), walked once by a task that carries only the last book.  Strategies and parameter trials run side by side.
Variance keeps its factor form (window returns and a ridge), so no task holds a matrix of names by names unless that is the smaller one.
Every solved date hands out its multipliers; ``certificate`` bounds from them, by DataFrame operations alone, how far the book is from the optimum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..constants import ISSUER_LIMIT, MAX_POSITION
from ..functions import scalars as S
from ..session import spread
from .allocation import factored_shrinkage, issuer_groups, position_caps
from .covariance import centred, window_returns
from .interior import Solution, solve

YEAR = 252.0
#: Room that limits get, so that equal bounds leave an inside; ridge on annual variances; fewest window rows for a shrunk covariance, and for a weighted one.
ROOM, RIDGE, FEWEST_ROWS, FEWEST_DECAYED = 1e-8, 1e-8, 10, 60
#: Names and scenarios that a tail needs; otherwise weights are even.
FEWEST_NAMES, FEWEST_SCENARIOS = 2, 20


@dataclass(frozen=True)
class Strategy:
    """What a strategy minimises: ``kind`` is mv (variance), cvar (tail mean of scenarios) or robust (mv averaged over perturbed forecasts)."""

    kind: str = "mv"
    target: float = 0.9
    risk_aversion: float = 4.0
    turnover_penalty: float = 0.05
    impact_eta: float = 0.1
    alpha: float = 0.99
    n_sims: int = 100
    t_effective: int = 252
    seed: int = 42
    #: Weight of a window row against the next younger one in the covariance; None weighs all alike.
    decay: float | None = None


#: Window rows that each kind looks back over.
WINDOWS = {"mv": 63, "cvar": 252, "robust": 63}


def strategies(cfg: Mapping) -> dict[str, Strategy]:
    """The three strategies with the penalties and targets of the settings."""
    eta = cfg["mv_market_impact_eta"]
    return {
        "mv": Strategy("mv", cfg["target_net_exposure_mv"], cfg["mv_risk_aversion"], cfg["mv_turnover_penalty"], eta),
        "cvar": Strategy("cvar", cfg["target_net_exposure_cvar"], cfg["cvar_risk_aversion"], cfg["cvar_turnover_penalty"], eta, cfg["cvar_alpha"]),
        "robust": Strategy("robust", cfg["target_net_exposure_robust"], cfg["robust_risk_aversion"], cfg["robust_turnover_penalty"], eta,
                           n_sims=cfg["michaud_n_simulations"], t_effective=cfg["michaud_t_effective"]),
    }


SOLVED = ("strategy_id string, date date, status string, gap double, budget double, ticker array<string>, weight array<double>, held array<double>, lower array<double>, upper array<double>, "
          "moved array<double>, cost array<double>, cap array<double>, tail array<double>, groups array<struct<kind:string,item:string,least:double,most:double,low:double,high:double>>")


def problems(names: DataFrame, universe: DataFrame, bounds: DataFrame, returns: DataFrame, window: int = 63, anchor: tuple[DataFrame, DataFrame] | None = None,
             max_position: float = MAX_POSITION, keys: Sequence[str] = ()) -> DataFrame:
    """One packed row per as-of date: names in order, forecasts, limits, and window returns with their ages.

    ``names``: (as_of, ticker, expected_return); ``bounds``: (asset_class, min_weight, max_weight), with ``as_of`` where they change by date; ``keys``: columns of both that tell problems of a date apart; names may bring a liquidity ``adtv`` of their own; ``anchor``: bands and ticker map of ``sector_bands``.
    A row is as large as a date's names times the window.
    """
    shared = issuer_groups(universe).select("ticker", F.col("issuer_id").alias("issuer"))
    dims = universe.select("ticker", "asset_class", *([] if "adtv" in names.columns else [F.col("liquidity_score").alias("adtv")])).join(position_caps(universe, max_position), "ticker").join(shared, "ticker", "left")
    er = F.col("expected_return")
    df = names.select(*keys, "as_of", "ticker", *(["adtv"] if "adtv" in names.columns else []), F.when(F.isnan(er) | er.isNull(), 0.0).when(er == float("inf"), 0.5).when(er == float("-inf"), -0.5).otherwise(er).alias("er")).join(dims, "ticker", "left")
    on = [*keys, *(["as_of"] if "as_of" in bounds.columns else []), "asset_class"]
    df = df.join(bounds.select(*on, F.col("min_weight").alias("class_min"), F.col("max_weight").alias("class_max")), on, "left")
    if anchor is None:
        df = df.withColumns({"anchor": F.lit(None).cast("string"), "anchor_min": F.lit(None).cast("double"), "anchor_max": F.lit(None).cast("double")})
    else:
        bands, mapping = anchor
        sectors = mapping.join(bands, "anchor").select("ticker", "anchor", F.col("min_weight").alias("anchor_min"), F.col("max_weight").alias("anchor_max"))
        df = df.join(sectors, "ticker", "left")
    asof = names.select(F.col("as_of").alias("date")).distinct()
    cells = window_returns(returns.join(names.select("ticker").distinct(), "ticker", "left_semi"), asof, window)
    paths = cells.groupBy("as_of", "ticker").agg(F.collect_list("age").alias("ages"), F.collect_list("ret").alias("rets"))
    df = df.join(paths, ["as_of", "ticker"], "left").withColumn("cap", F.coalesce("cap", F.lit(float(max_position))))
    columns = ("ticker", "er", "cap", "adtv", "asset_class", "class_min", "class_max", "issuer", "anchor", "anchor_min", "anchor_max")
    entry = F.struct(*columns, F.coalesce(F.size("ages"), F.lit(0)).alias("n"), F.coalesce("ages", F.array().cast("array<int>")).alias("ages"), F.coalesce("rets", F.array().cast("array<double>")).alias("rets"))
    packed = df.groupBy(*keys, "as_of").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    flat = [F.col(f"e.{c}").alias(c) for c in (*columns, "n")] + [F.flatten(F.col(f"e.{c}")).alias(c) for c in ("ages", "rets")]
    return packed.select(*keys, F.col("as_of").alias("date"), F.lit(int(window)).alias("window"), F.lit(float(max_position)).alias("max_position"), *flat)


def _paths(row: dict) -> np.ndarray:
    """Returns by age and name; a missing cell is NaN.  Rows without any cell are left out."""
    grid = np.full((row["window"], len(row["ticker"])), np.nan)
    grid[np.asarray(row["ages"], int), np.repeat(np.arange(len(row["ticker"])), row["n"])] = row["rets"]
    return grid[~np.isnan(grid).all(axis=1)]


def _groups(row: dict, target: float) -> list[tuple]:
    """(kind, item, members, least, most) of class bounds made reachable, issuer limits and sector bands."""
    def members(column):
        out: dict[str, list[int]] = {}
        for i, g in enumerate(row[column]):
            if g is not None:
                out.setdefault(g, []).append(i)
        return out

    classes = []
    for item, some in members("asset_class").items():
        least, most = row["class_min"][some[0]], row["class_max"][some[0]]
        if most is not None:
            reach = len(some) * row["max_position"]
            classes.append([item, some, round(reach, 4) if least > reach + 1e-9 else least, min(most, target)])
    total = sum(c[2] for c in classes)
    scale = target / total if total > target + 1e-9 else 1.0
    groups = [("class", item, some, min(least * scale, most), most) for item, some, least, most in classes]
    groups += [("issuer", item, some, 0.0, ISSUER_LIMIT) for item, some in members("issuer").items()]
    for item, some in members("anchor").items():
        most = min(1.0, row["anchor_max"][some[0]])
        groups.append(("sector", item, some, min(max(0.0, row["anchor_min"][some[0]]), most), most))
    return groups


def _intensity(z: np.ndarray) -> tuple[float, float]:
    """Shrinkage and mean variance of centred window returns, from the Gram matrix of its rows."""
    n, p = z.shape
    gram = z @ z.T
    trace = np.trace(gram) / n
    mu = trace / p
    if n < FEWEST_ROWS:
        return 1.0, mu * n / max(n - 1, 1)
    raw = (gram * gram).sum() / n**2
    beta, delta = ((np.diag(gram) ** 2).sum() / n - raw) / (p * n), (raw - 2 * mu * trace + p * mu * mu) / p
    return (0.0 if min(beta, delta) == 0 else min(beta, delta) / delta), mu


def _weighted(raw: np.ndarray, decay: float) -> np.ndarray:
    """Window returns, youngest first, centred and scaled so that z'z over the rows is their exponentially weighted covariance."""
    weight = decay ** np.arange(len(raw)) * np.concatenate((np.full(len(raw) - 1, 1.0 - decay), [1.0]))
    return (raw - weight @ raw) * np.sqrt(weight * len(raw) / (1.0 - weight @ weight))[:, None]


def _noise(seed: int, stream: int, sims: np.ndarray, day: int, width: int) -> np.ndarray:
    minor = day * 4096 + np.arange(width)
    u1, u2 = (S.hash_uniform_np(seed, stream + k, sims[:, None], minor[None, :]) for k in (0, 1))
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)


def _book(row: dict, setting: Strategy, held: dict[str, float]) -> dict:
    """One date's book and multipliers."""
    tickers, p, target = row["ticker"], len(row["ticker"]), setting.target
    er, cap = np.asarray(row["er"], float), np.asarray(row["cap"], float)
    adtv = np.maximum(np.array([0.5 if a is None else a for a in row["adtv"]]), 0.05)
    before = np.array([held.get(t, 0.0) for t in tickers])
    raw = _paths(row)
    groups = _groups(row, target)
    even = np.minimum(np.full(p, target / p), cap)
    out = {"ticker": tickers, "held": before.tolist(), "cap": cap.tolist(), "groups": [], "gap": None, "budget": None, "lower": None, "upper": None, "moved": None, "cost": None, "tail": None}
    if cap.sum() < target - 1e-9 or (setting.kind == "cvar" and (p < FEWEST_NAMES or len(raw) < FEWEST_SCENARIOS)):
        return out | {"status": "even", "weight": even.tolist()}
    extra = int(setting.kind == "cvar")  # the tail's threshold is a variable too
    n = p + extra
    low, high = np.zeros(n), np.concatenate((cap + ROOM, np.full(extra, 0.0)))
    equal = np.concatenate((np.ones(p), np.zeros(extra)))[None, :]
    scale = max(np.abs(er).mean(), 1e-4)
    kinks, level, kink_weight = np.zeros((0, n)), np.zeros(0), np.zeros(0)
    if setting.kind == "cvar":
        scenarios = np.nan_to_num(raw) * YEAR
        worst = int(np.floor((len(scenarios) - 1) * (1.0 - setting.alpha) + 1e-9)) + 1
        vol = scenarios.std(axis=0, ddof=1)
        reach = np.abs(scenarios).max() * target + 1.0
        low[p], high[p] = -reach, reach
        kinks, level, kink_weight = np.hstack((-scenarios, -np.ones((len(scenarios), 1)))), np.zeros(len(scenarios)), np.full(len(scenarios), setting.risk_aversion / worst)
        factor, q, c = np.zeros((0, n)), np.zeros(n), np.concatenate((-er, [setting.risk_aversion]))
    else:
        z = np.nan_to_num(raw - np.nanmean(raw, axis=0)) if len(raw) else np.zeros((1, p))
        s, mu = _intensity(z)
        rows = len(z)
        if setting.decay is not None and rows >= FEWEST_DECAYED:
            z = _weighted(np.nan_to_num(raw), setting.decay)
            mu = (z * z).sum() / rows / p
        vol = np.sqrt(((1 - s) * (z * z).sum(axis=0) / rows + s * mu) * YEAR + RIDGE)
        factor = np.sqrt(2 * setting.risk_aversion * YEAR * (1 - s) / rows) * z
        q, c = np.full(p, 2 * setting.risk_aversion * (YEAR * s * mu + RIDGE)), -er
    impact = setting.impact_eta * vol / adtv
    cost = np.concatenate((setting.turnover_penalty * scale + impact, np.zeros(extra)))
    if setting.kind == "robust":
        day, sims = (row["date"] - EPOCH).days, np.arange(setting.n_sims)
        drawn = er + np.sqrt((1 - s) / rows / setting.t_effective) * _noise(setting.seed, 41, sims, day, rows) @ z + np.sqrt(max(s * mu, 0.0) / setting.t_effective) * _noise(setting.seed, 43, sims, day, p)
        c = -drawn
        cost = setting.turnover_penalty * np.maximum(np.abs(drawn).mean(axis=1, keepdims=True), 1e-4) + impact
    place = np.concatenate((before, np.zeros(extra)))

    def tried(limits) -> Solution:
        lines = [(sign, g) for g in limits for sign in (1, -1) if sign > 0 or g[3] > 0]
        rows_, limit = np.zeros((len(lines), n)), np.zeros(len(lines))
        for k, (sign, (_, _, some, least, most)) in enumerate(lines):
            rows_[k, some], limit[k] = sign, (most if sign > 0 else -least) + ROOM
        return lines, solve(q, factor, c, equal, np.array([target]), low, high, rows_, limit, cost, place, kinks, level, kink_weight)

    lines, best = tried(groups)
    status = "full"
    if not (best.solved.any() if setting.kind == "robust" else best.solved.all()):  # limits that exclude each other: caps and budget alone
        lines, best = tried([])
        status, groups = "budget", []
    fine = best.solved
    if not fine.any():
        return out | {"status": "even", "weight": even.tolist()}
    w = np.clip(best.x[fine][:, :p], 0.0, cap)
    w = (w * (target / w.sum(axis=1, keepdims=True))).mean(axis=0)
    if setting.kind == "robust":
        w = np.clip(w * (target / w.sum()), 0.0, row["max_position"])
        return out | {"status": status, "weight": w.tolist(), "gap": float(best.gap[fine].max())}
    mult: dict[tuple, list[float]] = {(g[0], g[1]): [0.0, 0.0] for g in groups}
    for (sign, g), v in zip(lines, best.rows[0]):
        mult[g[0], g[1]][sign > 0] = float(v)
    listed = [{"kind": g[0], "item": g[1], "least": g[3], "most": g[4], "low": mult[g[0], g[1]][0], "high": mult[g[0], g[1]][1]} for g in groups]
    tail = best.kinks[0].tolist() if extra else None
    return out | {"status": status, "weight": w.tolist(), "gap": float(best.gap[0]), "budget": float(best.equal[0, 0]), "lower": best.lower[0, :p].tolist(), "upper": best.upper[0, :p].tolist(),
                  "moved": best.moved[0, :p].tolist(), "cost": cost[:p].tolist(), "tail": tail, "groups": listed}


EPOCH = np.datetime64("1970-01-01").astype(object)


def books(packed: DataFrame, strategies: Mapping[str, Strategy] | None = None) -> DataFrame:
    """Every strategy's books over the dates of ``packed``, each against the one before, with status and multipliers (``SOLVED``).

    Without ``strategies``, every problem names its own: columns ``strategy_id`` and ``setting`` (a struct of ``Strategy``'s fields).

    status: full; budget (limits that exclude each other were left out); even (caps below the target, too few scenarios, nothing solved).
    """
    spark = packed.sparkSession
    made = spark.createDataFrame([], SOLVED).schema
    arrow = to_arrow_schema(made)
    settings = {k: asdict(v) for k, v in (strategies or {}).items()}

    def walk(batches):
        name, held = None, {}
        for batch in batches:
            plain = batch.select([c for c in batch.schema.names if c not in ("ages", "rets")])
            for at in range(batch.num_rows):
                row = plain.slice(at, 1).to_pylist()[0] | {c: batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in ("ages", "rets")}
                if row["strategy_id"] != name:
                    name, held = row["strategy_id"], {}
                found = _book(row, Strategy(**(row["setting"] if strategies is None else settings[name])), held)
                held = dict(zip(found["ticker"], found["weight"]))
                yield pa.RecordBatch.from_pylist([found | {"strategy_id": name, "date": row["date"]}], schema=arrow)

    each = packed if strategies is None else packed.withColumn("strategy_id", F.explode(F.array(*[F.lit(k) for k in strategies])))
    return spread(each, "strategy_id").sortWithinPartitions("strategy_id", "date").mapInArrow(walk, made)


def weights(solved: DataFrame) -> DataFrame:
    """(strategy_id, date, ticker, weight)."""
    return solved.select("strategy_id", "date", F.explode(F.arrays_zip("ticker", "weight")).alias("z")).select("strategy_id", "date", "z.ticker", "z.weight")


def certificate(solved: DataFrame, packed: DataFrame, strategy: Strategy) -> DataFrame:
    """(strategy_id, date, n_names, total, violation, gap): a bound on each book's excess over the optimum, from multipliers and prices alone.

    The cost is convex, so it exceeds the optimum by no more than slope x (book - best book); the multipliers bound the slope's least value over all allowed
    books.  Slopes of costs at rest may lie anywhere between -cost and cost, so what a slope gives away there is added, likewise for scenarios outside the tail.
    Any multipliers give a valid bound; only good ones give a small one.
    """
    keys = ["strategy_id", "date"]
    names = solved.where("status <> 'even'").select(*keys, "budget", F.posexplode(F.arrays_zip("ticker", "weight", "held", "moved", "cost", "cap")).alias("i", "z")).select(*keys, "budget", "z.*")
    per_name = packed.select("date", "window", F.explode(F.arrays_zip("ticker", "er", "asset_class", "issuer", "anchor")).alias("z")).select("date", "z.*")
    at = F.aggregate("n", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    part = packed.select("date", "ticker", "ages", "rets", "n", at.alias("at")).select("date", F.posexplode("ticker").alias("i", "ticker"), "ages", "rets", "n", "at")
    cut = lambda c: F.slice(c, F.get("at", F.col("i")) + 1, F.get("n", F.col("i")))
    cells = part.where(F.get("n", F.col("i")) > 0).select(F.col("date").alias("as_of"), "ticker", F.explode(F.arrays_zip(cut("ages").alias("age"), cut("rets").alias("ret"))).alias("c")).select("as_of", "ticker", "c.age", "c.ret")
    held = names.join(per_name, ["date", "ticker"])
    if strategy.kind == "cvar":
        scaled = cells.select(F.col("as_of").alias("date"), "age", "ticker", (F.col("ret") * YEAR).alias("z"))
        order = Window.partitionBy("date").orderBy("age")
        ages = scaled.select("date", "age").distinct().withColumn("k", F.row_number().over(order) - 1)
        tail = solved.select(*keys, F.posexplode("tail").alias("k", "y")).join(ages, ["date", "k"]).select(*keys, "age", "y")
        slope = scaled.join(tail, ["date", "age"]).groupBy(*keys, "ticker").agg((-F.sum(F.col("y") * F.col("z"))).alias("risk"))
        loss = scaled.join(names.select(*keys, "ticker", "weight"), ["date", "ticker"]).groupBy(*keys, "age").agg((-F.sum(F.col("weight") * F.col("z"))).alias("loss"))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("loss")))
        rows = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        worst = F.floor((rows - 1) * F.lit(1.0 - strategy.alpha) + 1e-9) + 1
        most = F.lit(strategy.risk_aversion) / F.col("worst")
        joined = loss.withColumns({"rank": rank, "worst": worst}).join(tail, [*keys, "age"])
        # tail multipliers must lie in [0, most] and sum to the risk aversion: what they lack is charged at the largest loss
        given = joined.groupBy(*keys).agg(F.avg(F.when(F.col("rank") <= F.col("worst"), F.col("loss"))).alias("mean"), F.sum(S.clip("y", 0.0, most) * F.col("loss")).alias("seen"),
                                          F.greatest(F.max(-F.col("y")), F.max(F.col("y") - most), F.abs(F.sum("y") - strategy.risk_aversion)).alias("off"), F.max(F.abs("loss")).alias("largest"))
        loose = given.select(*keys, (strategy.risk_aversion * F.col("mean") - F.col("seen") + F.col("off") * F.col("largest")).alias("loose"))
    else:
        z = centred(cells)
        daily = z.withColumnRenamed("as_of", "date").join(names.select(*keys, "ticker", "weight"), ["date", "ticker"])
        book = daily.groupBy(*keys, "age").agg(F.sum(F.col("weight") * F.col("z")).alias("r"))
        rows = z.groupBy(F.col("as_of").alias("date")).agg(F.count_distinct("age").alias("rows"))
        shrunk = factored_shrinkage(z).select(F.col("as_of").alias("date"), "shrinkage", "mu").join(rows, "date")
        own = daily.join(book, [*keys, "age"]).groupBy(*keys, "ticker").agg(F.sum(F.col("z") * F.col("r")).alias("zr"), F.first("weight").alias("w"))
        k = F.when(F.col("rows") < FEWEST_ROWS, 1.0).otherwise(F.col("shrinkage"))
        mu = F.col("mu") * F.when(F.col("rows") < FEWEST_ROWS, F.col("rows") / F.greatest(F.col("rows") - 1, F.lit(1))).otherwise(1.0)
        grad = 2.0 * strategy.risk_aversion * (YEAR * ((1 - k) * F.col("zr") / F.col("rows") + k * mu * F.col("w")) + RIDGE * F.col("w"))
        slope = own.join(shrunk, "date").select(*keys, "ticker", grad.alias("risk"))
        loose = solved.select(*keys, F.lit(0.0).alias("loose"))
    groups = solved.select(*keys, F.explode("groups").alias("g")).select(*keys, "g.*")
    belongs = held.select(*keys, "ticker", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("item")) for k, c in (("class", "asset_class"), ("issuer", "issuer"), ("sector", "anchor"))])).alias("b"), "weight").select(
        *keys, "ticker", "b.kind", "b.item", "weight").where("item IS NOT NULL")
    member = belongs.join(groups, [*keys, "kind", "item"])
    pull = member.groupBy(*keys, "ticker").agg(F.sum(F.greatest("high", F.lit(0.0)) - F.greatest("low", F.lit(0.0))).alias("pull"))
    sums = member.groupBy(*keys, "kind", "item", "least", "most", "low", "high").agg(F.sum("weight").alias("s"))
    limits = sums.groupBy(*keys).agg(F.sum(F.greatest("high", F.lit(0.0)) * F.col("most") - F.greatest("low", F.lit(0.0)) * F.col("least")).alias("limits"),
                                     F.max(F.greatest(F.col("s") - F.col("most"), F.col("least") - F.col("s"))).alias("broken"))
    moved = F.least(F.greatest(F.col("moved"), -F.col("cost")), F.col("cost"))
    step = F.col("weight") - F.col("held")
    v = -F.col("er") + F.coalesce("risk", F.lit(0.0)) + moved
    reduced = v + F.col("budget") + F.coalesce("pull", F.lit(0.0))
    rows = held.join(slope, [*keys, "ticker"], "left").join(pull, [*keys, "ticker"], "left")
    summed = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_names"), F.sum("weight").alias("total"), F.first("budget").alias("budget"), F.sum(v * F.col("weight")).alias("at"), F.sum(F.least(reduced, F.lit(0.0)) * F.col("cap")).alias("floor"),
        F.sum(F.col("cost") * F.abs(step) - moved * step).alias("rest"), F.max(F.greatest(F.col("weight") - F.col("cap"), -F.col("weight"))).alias("over"))
    gap = F.col("at") + F.col("budget") * F.lit(strategy.target) + F.coalesce("limits", F.lit(0.0)) - F.col("floor") + F.col("rest") + F.coalesce("loose", F.lit(0.0))
    out = summed.join(limits, keys, "left").join(loose, keys, "left")
    return out.select(*keys, "n_names", "total", F.greatest("over", F.coalesce("broken", F.lit(0.0)), F.abs(F.col("total") - strategy.target), F.lit(0.0)).alias("violation"), gap.alias("gap"))
