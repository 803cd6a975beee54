"""Global positions against plain sorting, and spectra against dense matrices."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import covariance, ranks, spectra


def test_row_numbers_over_many_partitions(spark):
    rng = np.random.default_rng(0)
    values = [(int(v), i) for i, v in enumerate(rng.integers(0, 50, 3000))] + [(None, 5000)]
    df = spark.createDataFrame(values, "v int, id int").repartition(13)
    got = {r["id"]: r["rank"] for r in ranks.row_numbers(df, [F.col("v").desc(), F.col("id")]).collect()}
    want = sorted(values, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == {i: k + 1 for k, (_, i) in enumerate(want)}
    assert ranks.row_numbers(df.limit(0), ["v"]).count() == 0


def test_codes_are_dense_with_null_first(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("b", 4)], "c string, x int")
    assert sorted(tuple(r) for r in ranks.codes(df, "c").collect()) == [(0, 2), (1, 3), (2, 1), (2, 4)]


@pytest.mark.parametrize("names, decay", [(8, None), (8, 0.94), (90, None), (120, 0.94)])
def test_spectra_match_dense(spark, names, decay):
    rng = np.random.default_rng(names)
    days = [d.astype(object) for d in np.arange("2020-01-01", "2020-07-01", dtype="datetime64[D]") if np.is_busday(d)]
    returns = spark.createDataFrame([(d, f"T{i:03}", float(rng.normal(0, 0.01 + 0.001 * (i % 7)))) for d in days for i in range(names)], "date date, ticker string, ret double")
    asof = spark.createDataFrame([(days[-1],), (days[-30],)], "date date")
    cov = covariance.ledoit_wolf(returns, asof, 63) if decay is None else covariance.ewma_ledoit_wolf(returns, asof, 63, decay, 10)
    grams = spectra.window_grams(returns, asof, 63, decay)
    got = {r["as_of"]: r for r in spectra.spectra(grams, decay).collect()}
    assert len(got) == 2 and grams.count() == 2
    for date, part in cov.toPandas().groupby("as_of"):
        m = np.zeros((names, names))
        for r in part.itertuples():
            i, j = int(r.ticker_i[1:]), int(r.ticker_j[1:])
            m[i, j] = m[j, i] = r.cov
        e = np.linalg.eigvalsh(m)
        r = got[date]
        assert isinstance(date, dt.date) and r["n_names"] == names
        assert [r["least"], r["largest"], r["trace"], r["squares"]] == pytest.approx([e[0], e[-1], e.sum(), (e * e).sum()], rel=1e-8)
        assert r["condition"] == pytest.approx((e[-1] + 1e-12) / (e[0] + 1e-12), rel=1e-7) and r["logdet"] == pytest.approx(np.log(e + 1e-12).sum(), rel=1e-9)
