"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, quality
from ..session import stage_once
from ..sources import warehouse


def feature_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "panel": warehouse.price_panel(spark, sf_dir),
        "fundamentals": quality.publication_lag(warehouse.fundamentals(spark, sf_dir)),
        "fibra_reports": quality.publication_lag(warehouse.fibra_fundamentals(spark, sf_dir)),
        "bonds": warehouse.bonds(spark, sf_dir),
        "macro": warehouse.macro(spark, sf_dir),
        "universe": warehouse.universe(spark, sf_dir),
    }


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal matrix, staged: every later stage reads it column by column."""
    return stage_once(spark, sf_dir, "features", lambda: features.signal_matrix(**feature_inputs(spark, sf_dir)))


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_once(spark, sf_dir, "scored", lambda: features.score_cross_section(feature_table(spark, sf_dir)))


def returns_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_once(spark, sf_dir, "returns", lambda: features.add_returns(warehouse.price_panel(spark, sf_dir)))


def month_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.month_end_dates(returns_table(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored risky names on rebalance dates."""
    scored = scored_table(spark, sf_dir).where(F.col("asset_class").isin("equity", "fibra"))
    return scored.join(month_ends(spark, sf_dir), "date", "left_semi")


def rule_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four simple monthly books, the inputs of back-test and risk queries."""
    from ..operators.backtest import even_book, top_n

    def build():
        c = candidates(spark, sf_dir)
        parts = [top_n(c, "momentum_63", 5, "momentum"), top_n(c, "composite_score", 5, "composite", descending=False),
                 top_n(c, "volatility_63", 8, "lowvol", descending=False), even_book(c, "price", "equal")]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    return stage_once(spark, sf_dir, "weights", build)


def strategy_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.backtest import strategy_returns

    return stage_once(spark, sf_dir, "series", lambda: strategy_returns(rule_weights(spark, sf_dir), returns_table(spark, sf_dir)))


def benchmark_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-weight mean return per date, overall and per sector."""
    rets = returns_table(spark, sf_dir)
    from ..sources.warehouse import universe

    sectors = rets.join(universe(spark, sf_dir).select("ticker", "sector"), "ticker").select("date", F.col("sector").alias("benchmark"), "ret")
    everything = rets.select("date", F.lit("ALL").alias("benchmark"), "ret")
    return everything.unionByName(sectors).groupBy("date", "benchmark").agg(F.avg("ret").alias("ret"))


def trial_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_date, trial_id, metric): a trial x day metric matrix from the event stream."""
    from ..sources.warehouse import read

    return read(spark, sf_dir, "events").groupBy(
        F.col("ts").cast("date").alias("row_date"), (F.col("user_id") % 20).alias("trial_id")).agg(F.avg("value").alias("metric"))
