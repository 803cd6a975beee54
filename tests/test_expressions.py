"""Window, rank, quantile and scalar expressions against pandas / NumPy."""

from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.functions import scalars as S
from quantloom.functions import windows as W
from quantloom.functions.quantiles import exact_quantile


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    return pd.DataFrame({"k": "a", "date": pd.bdate_range("2020-01-01", periods=300).date, "x": rng.normal(0, 0.01, 300)})


def column(spark, pdf, expr):
    df = spark.createDataFrame(pdf)
    w = Window.partitionBy("k").orderBy("date")
    return df.select("date", expr(w).alias("v")).orderBy("date").toPandas()["v"].to_numpy(dtype=float)


def test_ewma_matches_pandas(spark, series):
    x = series.x
    np.testing.assert_allclose(column(spark, series, lambda w: W.ewma("x", w, 2 / 7)), x.ewm(span=6, adjust=False).mean(), atol=1e-13)
    np.testing.assert_allclose(column(spark, series, lambda w: W.ewma_adjusted("x", w, 1 / 3)), x.ewm(span=5, adjust=True).mean(), atol=1e-13)
    got = column(spark, series, lambda w: W.ewma_stddev("x", w, 21, 10))
    np.testing.assert_allclose(got, x.ewm(span=21, min_periods=10, adjust=False).std(), atol=1e-12)


def test_rolling_frames_match_pandas(spark, series):
    x = series.x
    np.testing.assert_allclose(column(spark, series, lambda w: W.lagged_volatility("x", w, 63)), x.rolling(63).std().shift(1), atol=1e-12)
    np.testing.assert_allclose(column(spark, series, lambda w: W.rolling_quantile("x", w, 50, 0.05)), x.rolling(50).quantile(0.05), atol=1e-12)
    e = x.expanding(3)
    np.testing.assert_allclose(column(spark, series, lambda w: W.expanding_zscore("x", w)), (x - e.mean()) / (e.std(ddof=0) + 1e-9), atol=1e-9)


def test_rolling_cvar_uses_only_earlier_rows(spark, series):
    got = column(spark, series, lambda w: W.rolling_cvar_prior("x", w, 63, 0.95))
    x = series.x.to_numpy()
    want = [np.nan] * 63 + [x[i - 63:i][x[i - 63:i] <= np.percentile(x[i - 63:i], 5) + 1e-12].mean() for i in range(63, 300)]
    np.testing.assert_allclose(got, want, atol=1e-13)


def test_percent_rank_averages_ties_and_skips_nulls(spark):
    x = pd.Series([3.0, 1.0, None, 3.0, 2.0, 2.0, 2.0])
    df = spark.createDataFrame([(i, 1, None if v != v else float(v)) for i, v in enumerate(x)], "i int, g int, x double")
    got = df.select("i", W.percent_rank_average("x", "g").alias("r")).orderBy("i").toPandas()["r"]
    np.testing.assert_allclose(got.to_numpy(dtype=float), x.rank(ascending=False, pct=True), atol=1e-12)


@pytest.mark.parametrize("q", [0.0, 0.05, 0.37, 0.5, 0.999, 1.0])
def test_exact_quantile_matches_numpy(spark, q):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=4000), np.repeat(0.25, 2000)])  # a third of the rows tie
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    row = exact_quantile(df, "v", q).collect()[0]
    assert row["n"] == 6000
    assert row["quantile"] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_normal_law(spark):
    law = NormalDist()
    rows = spark.range(1, 400).select((F.col("id") / 400).alias("p"), ((F.col("id") - 200) / 25).alias("x")).select(
        "p", "x", S.normal_quantile("p").alias("q"), S.normal_cdf("x").alias("c")).collect()
    assert max(abs(r.q - law.inv_cdf(r.p)) for r in rows) < 1e-12
    assert max(abs(r.c - law.cdf(r.x)) for r in rows) < 1e-14


def test_hashed_uniforms_agree_and_look_uniform(spark):
    pdf = spark.range(20000).select("id", S.hash_uniform(42, 5, F.col("id") % 100, F.floor(F.col("id") / 100)).alias("u")).toPandas()
    np.testing.assert_allclose(pdf.u, S.hash_uniform_np(42, 5, pdf.id % 100, pdf.id // 100), atol=0)
    assert abs(pdf.u.mean() - 0.5) < 0.01 and abs(np.corrcoef(pdf.u[:-1], pdf.u[1:])[0, 1]) < 0.03


def test_business_day_index_counts_weekdays(spark):
    days = pd.bdate_range("2019-12-25", periods=40)
    pdf = spark.createDataFrame([(d.date(),) for d in days], "d date").select("d", S.business_day_index("d").alias("i")).orderBy("d").toPandas()
    assert (np.diff(pdf.i) == 1).all()


def test_bond_price(spark):
    row = spark.range(1).select(S.bond_price(F.lit(0.05), F.lit(0.05), F.lit(7.0)).alias("par"), S.bond_price(F.lit(-0.01), F.lit(0.05), F.lit(7.0)).alias("flat")).collect()[0]
    assert row.par == pytest.approx(100.0) and row.flat == 100.0
