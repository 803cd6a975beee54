"""Expanding-window elastic-net forecasts from Gram sums.

Stage one is relational: one pass over the labelled rows gives, per (class, fold, month), the
sums of all products of (1, features, label).  Window sums over months turn them into every
expanding training set at once, so history is read once and not once per refit date.

Stage two works on those small matrices: one row per (class, refit date).  Cross-validation
subtracts a fold's Gram from the total; the paths of all folds, ratios and models of a task are
followed together from penalty to penalty.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..constants import EQUITY_MODEL_FEATURES, FIBRA_MODEL_FEATURES
from ..functions import windows as W
from ..session import spread, stage
from ..settings import DEFAULTS
from .features import by_ticker, forward_return

#: Matrices that a task sums up before it hands them out.
GRAMS_HELD = 20_000
N_PENALTIES = 100
PENALTY_FLOOR = 1e-3


def labelled_rows(features: DataFrame, columns: Sequence[str], horizon: int) -> DataFrame:
    """(date, ticker, label, label_date, columns...) with missing features as 0."""
    rows = forward_return(features.where(F.col("price").isNotNull()), horizon)
    return rows.select("date", "ticker", "asset_class", F.col("forward_return").alias("label"), F.col("forward_return_date").alias("label_date"),
                       *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def labelled_variants(features: DataFrame, columns: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """``labelled_rows`` for several horizons at once, from one pass over each ticker; ``horizon`` tells them apart."""
    rows = features.where(F.col("price").isNotNull())
    w = by_ticker()
    ahead = [F.struct(F.lit(int(h)).alias("horizon"), F.ln(F.lead("price", int(h)).over(w) / (F.col("price") + F.lit(1e-9))).alias("label"), F.lead("date", int(h)).over(w).alias("label_date")) for h in horizons]
    rows = rows.select("date", "ticker", F.array(*ahead).alias("_h"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])
    return rows.withColumn("_h", F.explode("_h")).select("_h.*", "date", "ticker", *columns)


def ticker_folds(rows: DataFrame, n_folds: int) -> DataFrame:
    """Contiguous blocks of tickers in name order, the layout of ordered k-fold on (ticker, date) rows."""
    names = rows.select("ticker").distinct()
    w = Window.orderBy("ticker")  # one row per listed name
    count = F.count(F.lit(1)).over(Window.partitionBy())
    return names.select("ticker", F.floor((F.row_number().over(w) - 1) * F.lit(n_folds) / count).cast("int").alias("fold"))


def gram_position(k: int, i: int, j: int) -> int:
    """Place of entry (i, j), i <= j, in the row-major upper triangle of a k x k Gram matrix."""
    return i * k - i * (i - 1) // 2 + (j - i)


def monthly_grams(rows: DataFrame, columns: Sequence[str], folds: DataFrame, strict: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fold, month, pos, g): product sums of (1, features, label), per month in which the label is known.

    ``strict`` uses the month the label is realised; otherwise the month of the row, which lets
    a training set see returns that end after it.  Each task keeps one small matrix per
    (keys, fold, month) over all its batches (a bounded number at a time), so only those matrices are shuffled and summed.
    ``keys``: whole-number columns that tell variants apart.
    """
    known = F.col("label_date") if strict else F.col("date")
    data = rows.where(F.col("label").isNotNull()).join(F.broadcast(folds), "ticker").select(
        *keys, "fold", F.trunc(known, "MM").alias("month"), *columns, "label")
    k = len(columns) + 2
    upper = np.triu_indices(k)

    def rows_of(sums):
        if sums:
            parts = list(zip(*sums))
            own = {c: np.repeat(np.asarray(v, np.int32), len(upper[0])) for c, v in zip([*keys, "fold"], parts)}
            yield pd.DataFrame({**own, "month": np.repeat(np.asarray(parts[-1]), len(upper[0])), "pos": np.tile(np.arange(len(upper[0]), dtype=np.int32), len(sums)), "g": np.stack(list(sums.values()))[:, upper[0], upper[1]].ravel()})

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            z = np.column_stack([np.ones(len(pdf)), pdf[[*columns, "label"]].to_numpy(dtype=np.float64)])
            for key, at in pdf.groupby([*keys, "fold", "month"]).indices.items():
                g = z[at].T @ z[at]
                sums[key] = sums[key] + g if key in sums else g
            if len(sums) > GRAMS_HELD:
                yield from rows_of(sums)
                sums = {}
        yield from rows_of(sums)

    parts = data.mapInPandas(partial, "".join(f"{c} int, " for c in keys) + "fold int, month date, pos int, g double")
    return parts.groupBy(*keys, "fold", "month", "pos").agg(F.sum("g").alias("g"))


def expanding_grams(grams: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running sums over months for each (fold, entry), on a gap-free month grid."""
    low, high = grams.agg(F.min("month")).scalar(), grams.agg(F.max("month")).scalar()
    grid = grams.select(*keys, "fold", "pos").distinct().withColumn("month", F.explode(F.sequence(low, high, F.expr("interval 1 month"))))
    dense = grid.join(grams, [*keys, "fold", "pos", "month"], "left").fillna(0.0, subset=["g"])
    w = Window.partitionBy(*keys, "fold", "pos").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return dense.select(*keys, "fold", "month", "pos", F.sum("g").over(w).alias("g"))


def _centre(gram: np.ndarray):
    n = gram[0, 0]
    mx, my = gram[0, 1:-1] / n, gram[0, -1] / n
    xx = gram[1:-1, 1:-1] - n * np.outer(mx, mx)
    xy = gram[1:-1, -1] - n * mx * my
    return n, mx, my, xx, xy


def descend(xx: np.ndarray, xy: np.ndarray, n: np.ndarray, l1: np.ndarray, l2: np.ndarray, max_iter: int, sweeps: int = 3) -> np.ndarray:
    """Elastic nets of many problems, exact: xx (B,k,k), xy (B,k), n (B,), penalties (B,P) -> (B,P,k).

    A round is a few sweeps of coordinate descent, which find the signs, and a step to the minimum among coefficients
    of those signs, stopped where the first one reaches 0.  No part raises the objective, so signs never return; a problem
    leaves once that minimum keeps its signs and no absent coefficient would enter.
    """
    b, p = l1.shape
    k = xy.shape[1]
    g, c = xx / n[:, None, None], xy / n[:, None]
    at = np.repeat(np.arange(b), p)
    a1, a2 = l1.reshape(-1), l2.reshape(-1)
    out = np.zeros((b * p, k))
    live = np.arange(b * p)
    flat = np.einsum("bii->bi", g) <= 1e-14
    eye = np.eye(k)
    for _ in range(max_iter):
        gl, cl, fl, w, s1, s2 = g[at[live]], c[at[live]], flat[at[live]], out[live], a1[live], a2[live]
        for _ in range(sweeps):
            for j in range(k):
                rho = cl[:, j] - np.einsum("mk,mk->m", gl[:, j], w) + gl[:, j, j] * w[:, j]
                w[:, j] = np.where(fl[:, j], 0.0, np.sign(rho) * np.maximum(np.abs(rho) - s1, 0.0) / np.maximum(gl[:, j, j] + s2, 1e-300))
        sign = np.sign(w)
        on = sign != 0
        # a trace of ridge keeps exact copies of a column solvable where the penalty is all absolute
        inner = np.where(on[:, :, None] & on[:, None, :], gl + (s2[:, None, None] + 1e-13) * eye, eye)
        aim = np.linalg.solve(inner, np.where(on, cl - s1[:, None] * sign, 0.0)[:, :, None])[:, :, 0]
        turns = on & (aim * sign <= 0)
        reach = np.where(turns, w / np.where(turns, w - aim, 1.0), 1.0)
        part = reach.min(axis=1)
        step = np.where(on, w + part[:, None] * (aim - w), 0.0)
        step[turns & (reach <= part[:, None])] = 0.0
        slope = np.abs(cl - np.einsum("mjk,mk->mj", gl, step))
        out[live] = step
        done = (part >= 1.0) & (np.where(on | fl, 0.0, slope - s1[:, None]) <= 1e-10 * (s1[:, None] + np.abs(cl).max(axis=1, keepdims=True))).all(axis=1)
        live = live[~done]
        if not len(live):
            break
    return out.reshape(b, p, k)


def follow(xx: np.ndarray, xy: np.ndarray, n: np.ndarray, l1: np.ndarray, l2: np.ndarray, max_iter: int) -> np.ndarray:
    """``descend`` along falling penalties: a penalty starts from the signs and coefficients of the one before, all problems side by side.

    A step goes to the minimum among coefficients of the present signs, stopped where the first one reaches 0, which leaves; at that minimum the
    absent coefficient that misses its condition most enters.  Neighbouring penalties mostly share their signs, so one small system each is enough.
    A problem that is not settled after ``8 k`` steps (exact copies of a column) is left to ``descend``.
    """
    b, p = l1.shape
    k = xy.shape[1]
    g, c = xx / n[:, None, None], xy / n[:, None]
    flat = np.einsum("bii->bi", g) <= 1e-14
    largest = np.abs(c).max(axis=1)
    eye = np.eye(k)
    w, sign = np.zeros((b, k)), np.zeros((b, k))
    out = np.zeros((b, p, k))
    for i in range(p):
        live = np.arange(b)
        for _ in range(8 * k):
            gl, cl, s1, s2, now, way = g[live], c[live], l1[live, i], l2[live, i], w[live], sign[live]
            on = way != 0
            inner = np.where(on[:, :, None] & on[:, None, :], gl + (s2[:, None, None] + 1e-13) * eye, eye)
            aim = np.linalg.solve(inner, np.where(on, cl - s1[:, None] * way, 0.0)[:, :, None])[:, :, 0]
            turns = on & (aim * way <= 0)
            reach = np.where(turns, now / np.where(turns & (now != aim), now - aim, 1.0), 1.0)
            part = reach.min(axis=1)
            step = np.where(on, now + part[:, None] * (aim - now), 0.0)
            gone = turns & (reach <= part[:, None])
            step[gone], way[gone] = 0.0, 0.0
            slope = cl - np.matmul(gl, step[:, :, None])[:, :, 0]
            missed = np.where((way != 0) | flat[live], -1.0, np.abs(slope) - s1[:, None])
            worst = missed.argmax(axis=1)
            rows = np.arange(len(live))
            whole = part >= 1.0
            enter = whole & (missed[rows, worst] > 1e-10 * (s1 + largest[live]))
            way[rows[enter], worst[enter]] = np.sign(slope[rows[enter], worst[enter]])
            w[live], sign[live] = step, way
            live = live[enter | ~whole]
            if not len(live):
                break
        if len(live):
            w[live] = descend(xx[live], xy[live], n[live], l1[live, i:i + 1], l2[live, i:i + 1], max_iter)[:, 0]
            sign[live] = np.sign(w[live])
        out[:, i] = w
    return out


#: Models whose paths are followed side by side.
MODELS_AT_ONCE = 64


def solve_many(grams: np.ndarray, sets: Sequence[Sequence[float]], max_iter: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """``solve_elastic_nets`` of many models (M, B, k+2, k+2), some at a time."""
    return [m for at in range(0, len(grams), MODELS_AT_ONCE) for m in _solve_chunk(grams[at:at + MODELS_AT_ONCE], sets, max_iter)]


def _solve_chunk(grams: np.ndarray, sets: Sequence[Sequence[float]], max_iter: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    ratios = list(dict.fromkeys(r for s in sets for r in s))
    r = np.repeat(ratios, N_PENALTIES)
    models, parts, owner, tests = [], [], [], []
    for folds in grams:
        n, mx, my, xx, xy = _centre(folds.sum(0))
        sd = np.sqrt(np.maximum(np.diag(xx) / n, 0.0))
        sd = np.where(sd <= 1e-12, 1.0, sd)
        # work in standardised features: z = (x - mean) / sd
        t = np.eye(folds.shape[1])
        t[1:-1, 1:-1] = np.diag(1.0 / sd)
        t[0, 1:-1] = -mx / sd
        scaled = np.matmul(np.matmul(t.T, folds), t)
        whole = scaled.sum(0)
        n, _, my, xx, xy = _centre(whole)
        a = np.concatenate([np.geomspace(top, top * PENALTY_FLOOR, N_PENALTIES) for x in ratios for top in [max(float(np.abs(xy).max()) / (n * x), 1e-12)]])
        used = [f for f in range(len(scaled)) if scaled[f, 0, 0] > 0 and whole[0, 0] - scaled[f, 0, 0] > len(sd)]
        if len(used) > 1:
            parts += [_centre(whole - scaled[f]) for f in used]
            tests += [scaled[f] for f in used]
            owner += [len(models)] * len(used)
        models.append((n, mx, my, xx, xy, sd, a))
    errors: dict[int, np.ndarray] = {}
    if parts:
        each, q = len(parts), len(ratios)
        penalty = np.stack([models[m][6] for m in owner])
        many = lambda i: np.repeat(np.stack([p[i] for p in parts]), q, axis=0)
        w = follow(many(3), many(4), np.repeat(np.asarray([p[0] for p in parts]), q), (penalty * r).reshape(each * q, -1), (penalty * (1.0 - r)).reshape(each * q, -1), max_iter)
        w = w.reshape(each, q * N_PENALTIES, -1)
        for i, m in enumerate(owner):
            _, mt, yt, _, _ = parts[i]
            full = np.concatenate([(yt - w[i] @ mt)[:, None], w[i], -np.ones((len(r), 1))], axis=1)
            errors[m] = errors.get(m, 0.0) + np.einsum("pi,pi->p", full @ tests[i], full) / tests[i][0, 0]
    best = []
    for m in range(len(models)):
        places = [np.concatenate([np.arange(N_PENALTIES) + N_PENALTIES * ratios.index(x) for x in s]) for s in sets]
        best.append([int(at[np.argmin(errors[m][at])]) if m in errors else int(at[len(at) // 2]) for at in places])
    wanted = sorted({(m, i) for m, own in enumerate(best) for i in own})
    take = lambda i: np.stack([models[m][i] for m, _ in wanted])
    strict = np.asarray([[models[m][6][i] * r[i]] for m, i in wanted])
    smooth = np.asarray([[models[m][6][i] * (1.0 - r[i])] for m, i in wanted])
    fitted = dict(zip(wanted, follow(take(3), take(4), np.asarray([models[m][0] for m, _ in wanted]), strict, smooth, max_iter)[:, 0]))
    out = []
    for m, own in enumerate(best):
        _, mx, my, _, _, sd, a = models[m]
        out.append([(fitted[m, i] / sd, float(my - fitted[m, i] / sd @ mx), float(a[i]), float(r[i])) for i in own])
    return out


def solve_elastic_nets(folds: np.ndarray, sets: Sequence[Sequence[float]], max_iter: int) -> list[tuple[np.ndarray, float, float, float]]:
    """Cross-validated elastic net of every set of ratios from fold Grams (B, k+2, k+2): (raw coefficients, intercept, penalty, ratio).

    A ratio's errors are computed once, however many sets hold it.  Ties go to the first ratio of the set, and to its largest penalty.
    """
    return solve_many(folds[None], sets, max_iter)[0]


def solve_elastic_net(folds: np.ndarray, ratios: Sequence[float], max_iter: int) -> tuple[np.ndarray, float, float, float]:
    """``solve_elastic_nets`` of one set of ratios."""
    return solve_elastic_nets(folds, [ratios], max_iter)[0]


MODEL = T.StructType([
    T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("intercept", T.DoubleType()),
    T.StructField("penalty", T.DoubleType()), T.StructField("l1_ratio", T.DoubleType())])


def fit_models(expanding: DataFrame, k: int, n_folds: int, sets: Sequence[Sequence[float]], min_rows: int, max_iter: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, month, n_train, ratio_set, coef, intercept, penalty, l1_ratio) per refit month with enough rows and set of ratios."""
    per_fold = expanding.groupBy(*keys, "month", "fold").agg(F.sort_array(F.collect_list(F.struct("pos", "g"))).alias("_g")).select(*keys, "month", "fold", F.col("_g.g").alias("g"))
    packed = per_fold.groupBy(*keys, "month").agg(F.sum(F.get("g", F.lit(0))).alias("n_train"), F.collect_list(F.struct("fold", "g")).alias("folds"))
    rows, cols = np.triu_indices(k)
    chosen = [list(s) for s in sets]

    @F.pandas_udf(T.ArrayType(MODEL))
    def fit(folds: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(folds), MODELS_AT_ONCE):
            some = folds.iloc[at:at + MODELS_AT_ONCE]
            grams = np.zeros((len(some), n_folds, k, k))
            for own, packs in zip(grams, some):
                for item in packs:
                    own[item["fold"], rows, cols] = item["g"]
                    own[item["fold"], cols, rows] = item["g"]
            out += [[dict(zip(MODEL.names, (m[0].tolist(), *m[1:]))) for m in found] for found in solve_many(grams, chosen, max_iter)]
        return pd.Series(out)

    ready = spread(packed.where(F.col("n_train") >= min_rows), *keys, "month")
    return ready.select(*keys, "month", F.col("n_train").cast("long").alias("n_train"), F.posexplode(fit("folds")).alias("ratio_set", "_m")).select(*keys, "month", "n_train", "ratio_set", "_m.*")


def optimality(expanding: DataFrame, models: DataFrame, k: int) -> DataFrame:
    """(month, n_train, residual): the most that a model misses the elastic net's optimality conditions by, as a share of its absolute penalty.

    Read from the training sums and the model's coefficients alone, so it holds whatever solver found them.
    """
    summed = expanding.groupBy("month", "pos").agg(F.sum("g").alias("g")).groupBy("month").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "g"))), lambda x: x["g"]).alias("g"))
    rows = summed.join(models, "month")
    at = lambda i, j: F.get("g", F.lit(gram_position(k, min(i, j), max(i, j))))
    b = lambda j: F.get("coef", F.lit(j - 1))
    n, features = at(0, 0), range(1, k - 1)
    left = lambda i: at(i, k - 1) - F.col("intercept") * at(0, i) - functools.reduce(lambda s, j: s + b(j) * at(i, j), features, F.lit(0.0))
    strict, smooth = F.col("penalty") * F.col("l1_ratio"), F.col("penalty") * (1.0 - F.col("l1_ratio"))
    missed = []
    for j in features:
        mean = at(0, j) / n
        raw = F.sqrt(F.greatest(at(j, j) / n - mean * mean, F.lit(0.0)))
        sd = F.when(raw <= 1e-12, 1.0).otherwise(raw)
        slope = (left(j) - mean * left(0)) / (sd * n)
        missed.append(F.when(b(j) != 0.0, F.abs(slope - smooth * b(j) * sd - strict * F.signum(b(j)))).otherwise(F.greatest(F.abs(slope) - strict, F.lit(0.0))))
    return rows.select("month", "n_train", (F.greatest(*missed) / strict).alias("residual"))


def class_variants(features: DataFrame, asset_class: str, columns: Sequence[str], horizons: Sequence[int], sets: Sequence[Sequence[float]], cfg: dict, strict: bool = True) -> DataFrame:
    """Raw predictions of one asset class on its month-end dates, for every horizon and set of ratios."""
    n_folds, k = int(cfg["elasticnet_cv_folds"]), len(columns) + 2
    own = features.where((F.col("asset_class") == asset_class) & F.col("price").isNotNull())
    rows = labelled_variants(spread(own, "ticker"), columns, horizons)
    grams = stage(monthly_grams(rows, columns, ticker_folds(own, n_folds), strict, ["horizon"]), "grams")
    models = fit_models(expanding_grams(grams, ["horizon"]), k, n_folds, sets, int(cfg["forecast_min_train_rows"]), int(cfg["elasticnet_max_iter"]), ["horizon"])
    ends = own.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("date"))
    now = own.select("date", "ticker", "asset_class", F.array(*[F.coalesce(c, F.lit(0.0)) for c in columns]).alias("_x"))
    current = now.join(ends, "date").join(models, "month")
    prediction = F.aggregate(F.zip_with("_x", "coef", lambda a, b: a * b), F.col("intercept"), lambda acc, v: acc + v)
    return current.select("horizon", "ratio_set", "date", "ticker", "asset_class", "n_train", "penalty", "l1_ratio", prediction.alias("prediction"))


def forecast_variants(features: DataFrame, horizons: Sequence[int], sets: Sequence[Sequence[float]], settings: dict | None = None, strict: bool = True) -> DataFrame:
    """Monthly forecasts for every horizon and set of ratios (``ratio_set``: its place), z-scored over each date's cross-section.

    Every class but fixed income has a model of its own; classes other than fibra use the equity features.
    """
    cfg = {**DEFAULTS, **(settings or {})}
    names = sorted(r[0] for r in features.where("asset_class IS NOT NULL AND asset_class <> 'fixed_income'").select("asset_class").distinct().collect())
    parts = [class_variants(features, name, [c for c in (FIBRA_MODEL_FEATURES if name == "fibra" else EQUITY_MODEL_FEATURES) if c in features.columns], horizons, sets, cfg, strict)
             for name in names or ["equity"]]
    both = functools.reduce(DataFrame.unionByName, parts)
    return both.withColumn("expected_return", W.cross_zscore("prediction", ["horizon", "ratio_set", "date"]))


def forecast_returns(features: DataFrame, settings: dict | None = None, strict: bool = True) -> DataFrame:
    """``forecast_variants`` of the horizon and ratios of the settings."""
    cfg = {**DEFAULTS, **(settings or {})}
    return forecast_variants(features, [int(cfg["forecast_forward_days"])], [cfg["elasticnet_l1_ratios"]], cfg, strict).drop("horizon", "ratio_set")
