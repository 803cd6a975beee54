"""Whole spectra of shrunk covariances without a matrix of names by names.

Sigma = k Z'Z + ridge I with T window rows Z, so its eigenvalues are ridge + k times those of the T x T matrix ZZ', and ridge itself for every name beyond T.
ZZ' is a sum over names: tasks add up their own names' outer products and hand on one packed matrix per date.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .covariance import window_returns
from .optimise import FEWEST_ROWS

#: A determinant's matrix gets this on its diagonal; an eigenvalue below -PSD is negative.
RIDGE, PSD = 1e-12, 1e-9


def _weights(rows: int, decay: float | None) -> np.ndarray:
    """Weight of each age: even, or falling by ``decay`` with the rest on the oldest; they sum to 1."""
    if decay is None:
        return np.full(rows, 1.0 / rows)
    age = np.arange(rows)
    return decay**age * np.where(age == rows - 1, 1.0, 1.0 - decay)


def window_grams(returns: DataFrame, asof: DataFrame, window: int, decay: float | None = None) -> DataFrame:
    """(as_of, n_rows, n_names, plain, weighted): row products of centred window returns, evenly and by age weighted, packed row by row.

    Ages run from 0; a name's missing cells count as its mean.
    """
    cells = window_returns(returns, asof, window)
    rows = cells.groupBy("as_of").agg((F.max("age") + 1).alias("n_rows"))
    paths = cells.groupBy("as_of", "ticker").agg(F.collect_list("age").alias("ages"), F.collect_list("ret").alias("rets")).join(rows, "as_of")
    schema = "as_of date, n_rows int, n_names long, plain array<double>, weighted array<double>"

    def packed(date, n, names, plain, weighted):
        return pa.RecordBatch.from_pylist([{"as_of": date, "n_rows": n, "n_names": names, "plain": plain.ravel().tolist(), "weighted": weighted.ravel().tolist()}], schema=GRAMS)

    def partial(batches):
        date = have = None
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n_rows"]
                if r["as_of"] != date:
                    if have is not None:
                        yield packed(date, *have)
                    date, have = r["as_of"], [n, 0, np.zeros((n, n)), np.zeros((n, n))]
                ages = np.asarray(r["ages"], int)
                w = _weights(n, decay)
                values = np.asarray(r["rets"])
                plain, weighted = np.zeros(n), np.zeros(n)
                plain[ages] = values - values.mean()
                weighted[ages] = values - (w[ages] * values).sum() / w[ages].sum()
                weighted *= np.sqrt(w)
                have[1] += 1
                have[2] += np.outer(plain, plain)
                have[3] += np.outer(weighted, weighted)
        if have is not None:
            yield packed(date, *have)

    def total(table: pa.Table) -> pa.Table:
        add = lambda c: np.sum([np.asarray(x) for x in table[c].to_pylist()], axis=0).tolist()
        one = table.slice(0, 1)
        out = {"as_of": one["as_of"], "n_rows": one["n_rows"], "n_names": pa.array([sum(table["n_names"].to_pylist())]), "plain": pa.array([add("plain")], pa.list_(pa.float64())), "weighted": pa.array([add("weighted")], pa.list_(pa.float64()))}
        return pa.table(out)

    # a date's names are spread over a few tasks, each of which holds one date at a time
    sliced = spread(paths.withColumn("_slice", F.pmod(F.xxhash64("ticker"), F.lit(8))), "as_of", "_slice").sortWithinPartitions("as_of")
    return sliced.mapInArrow(partial, schema).groupBy("as_of").applyInArrow(total, schema)


def eigenvalues(plain: np.ndarray, weighted: np.ndarray, names: int, decay: float | None) -> tuple[np.ndarray, int, float]:
    """Eigenvalues that rest on window rows (falling), how many more equal the ridge, and the ridge."""
    n = len(plain)
    trace = np.trace(plain) / n
    mu = trace / names
    raw = (plain * plain).sum() / n**2
    beta, delta = ((np.diag(plain) ** 2).sum() / n - raw) / (names * n), (raw - 2 * mu * trace + names * mu * mu) / names
    s = 0.0 if min(beta, delta) == 0 else min(beta, delta) / delta
    kept = min(n, names)
    if decay is None:
        if n < FEWEST_ROWS:
            return np.full(kept, mu * n / max(n - 1, 1)), names - kept, mu * n / max(n - 1, 1)
        gram = plain / n
    else:
        gram = weighted / (1.0 - (_weights(n, decay) ** 2).sum())
    ridge = s * np.trace(gram) / names
    return ridge + (1 - s) * np.linalg.eigvalsh(gram)[::-1][:kept], names - kept, ridge


def spectra(grams: DataFrame, decay: float | None = None, min_rows: int = 1) -> DataFrame:
    """(as_of, n_names, trace, squares, least, largest, condition, logdet) of each date's shrunk covariance; dates under ``min_rows`` rows are left out.

    ``trace`` and ``squares`` are the sums of the eigenvalues and of their squares; ``logdet`` is null where the determinant isn't positive.
    """
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n_rows"]
                shape = lambda c: np.asarray(r[c]).reshape(n, n)  # noqa: B023,E731
                values, more, ridge = eigenvalues(shape("plain"), shape("weighted"), r["n_names"], decay)
                whole = np.append(values, ridge) if more else values
                firm = np.abs(whole + RIDGE)
                positive = (np.sum(values + RIDGE < 0) + more * (ridge + RIDGE < 0)) % 2 == 0
                logdet = np.log(np.abs(values + RIDGE)).sum() + more * np.log(abs(ridge + RIDGE)) if more else np.log(firm).sum()
                yield pa.RecordBatch.from_pylist([{"as_of": r["as_of"], "n_names": r["n_names"], "trace": values.sum() + more * ridge, "squares": (values**2).sum() + more * ridge**2, "least": whole.min(),
                                                   "largest": whole.max(), "condition": firm.max() / firm.min(), "logdet": float(logdet) if positive else None}], schema=SPECTRUM)

    return grams.where(F.col("n_rows") >= min_rows).mapInArrow(run, "as_of date, n_names long, trace double, squares double, least double, largest double, condition double, logdet double")


GRAMS = pa.schema([("as_of", pa.date32()), ("n_rows", pa.int32()), ("n_names", pa.int64()), ("plain", pa.list_(pa.float64())), ("weighted", pa.list_(pa.float64()))])
SPECTRUM = pa.schema([("as_of", pa.date32()), ("n_names", pa.int64()), *[(c, pa.float64()) for c in ("trace", "squares", "least", "largest", "condition", "logdet")]])


def covariance_choice(rolling: DataFrame, ewma: DataFrame) -> DataFrame:
    """(as_of, method_used, fallback_to_rolling, condition_ratio, det_ratio) from two tables of spectra: EWMA where it exists and is positive semi-definite."""
    e = ewma.select("as_of", F.col("least").alias("e_least"), F.col("condition").alias("e_cond"), F.col("logdet").alias("e_logdet"))
    d = rolling.join(e, "as_of", "left")
    usable = F.col("e_least").isNotNull() & (F.col("e_least") >= -PSD)
    return d.select("as_of", F.when(usable, "ewma_ledoit_wolf").otherwise("rolling_ledoit_wolf").alias("method_used"), (~usable).alias("fallback_to_rolling"),
                    F.when(usable, F.col("e_cond") / (F.col("condition") + F.lit(1e-12))).alias("condition_ratio"), F.when(usable, F.exp(F.col("e_logdet") - F.col("logdet"))).alias("det_ratio"))
