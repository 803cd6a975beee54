"""Feature matrices: one window pass per ticker, as-of joins, column formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import EQUITY_DEFAULTS, EQUITY_FUNDAMENTALS, FIBRA_DEFAULTS, FIBRA_FUNDAMENTALS, SCORE_COLUMNS
from ..functions import scalars as S
from ..functions import windows as W
from .joins import asof_join
from .quality import RISKY

UNIVERSE_COLUMNS = ["ticker", "sector", "liquidity_score", "market_cap", "usd_exposure", "asset_class"]
MACRO_FEATURES = [
    "IMAI", "industrial_production_yoy", "exports_yoy", "usd_mxn", "banxico_rate",
    "inflation_yoy", "us_ip_yoy", "us_fed_rate",
]


def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def add_returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("ret", W.log_return("price", by_ticker()))


def price_signals(panel: DataFrame) -> DataFrame:
    """Return, momentum and volatility: all frames share one partitioning and one sort."""
    w = by_ticker()
    return (add_returns(panel)
            .withColumn("momentum_63", W.skip_momentum("price", w, 63, 1))
            .withColumn("momentum_126", W.skip_momentum("price", w, 126, 21))
            .withColumn("volatility_63", W.lagged_volatility("ret", w, 63))
            .where(F.col("price").isNotNull()))


def last_date(table: DataFrame) -> Column:
    """Latest date of a *stored* table as a scalar subquery (a one-column scan)."""
    return table.agg(F.max("date")).scalar()


def daily_macro(df: DataFrame, macro: DataFrame, columns=None, horizon: Column | None = None) -> DataFrame:
    """Latest macro row on or before each date."""
    wanted = [c for c in (columns or MACRO_FEATURES) if c in macro.columns]
    return asof_join(df, macro, [], wanted, horizon=horizon)


def has_history(panel: DataFrame, reports: DataFrame, columns) -> Column:
    """Does any report with a value ever become known inside its ticker's price span?

    A scalar over two small per-ticker aggregates; it picks the fill rule inside one plan.
    """
    spans = panel.where(F.col("price").isNotNull()).groupBy("ticker").agg(F.max("date").alias("last"))
    firsts = reports.where(F.coalesce(*columns).isNotNull()).groupBy("ticker").agg(F.min("date").alias("first"))
    found = spans.join(firsts, "ticker").agg(F.coalesce(F.bool_or(F.col("first") <= F.col("last")), F.lit(False)))
    return found.scalar()


def fill_or_null(df: DataFrame, defaults: dict[str, float], known: Column) -> DataFrame:
    """Neutral defaults for single gaps, only where real history exists."""
    return df.withColumns({c: F.when(known, F.coalesce(c, F.lit(v))).otherwise(F.col(c)) for c, v in defaults.items()})


def risky_base(panel: DataFrame, macro: DataFrame, universe: DataFrame, asset_class: str) -> DataFrame:
    members = universe.where(F.col("investable") & (F.col("asset_class") == asset_class)).select(*UNIVERSE_COLUMNS)
    signals = price_signals(panel.join(members.select("ticker"), "ticker", "left_semi"))
    signals = signals.where(F.col("momentum_63").isNotNull() & F.col("volatility_63").isNotNull())
    return daily_macro(signals.join(members, "ticker"), macro, horizon=last_date(panel))


def equity_features(panel: DataFrame, fundamentals: DataFrame, macro: DataFrame, universe: DataFrame) -> DataFrame:
    base = risky_base(panel, macro, universe, "equity")
    members = universe.where(F.col("investable") & (F.col("asset_class") == "equity")).select("ticker")
    reports = fundamentals.join(members, "ticker", "left_semi")
    known = has_history(panel, reports, EQUITY_FUNDAMENTALS)
    df = asof_join(base, reports, ["ticker"], EQUITY_FUNDAMENTALS, horizon=last_date(panel))
    df = fill_or_null(df, EQUITY_DEFAULTS, known)
    df = df.where(~known | (F.col("pe_ratio").isNotNull() & F.col("pb_ratio").isNotNull()))
    return df.withColumns({
        "momentum": F.col("momentum_63"),
        "volatility": F.col("volatility_63"),
        "value_score": F.lit(-0.5) * F.col("pe_ratio") - F.lit(0.5) * F.col("pb_ratio"),
        "quality_score": F.col("roe") + F.col("profit_margin") - F.lit(0.25) * F.col("net_debt_to_ebitda"),
        "macro_exposure": F.col("industrial_production_yoy") + F.lit(0.5) * F.coalesce("exports_yoy", F.lit(0.0)),
    })


def fibra_features(panel: DataFrame, reports: DataFrame, macro: DataFrame, universe: DataFrame) -> DataFrame:
    base = risky_base(panel, macro, universe, "fibra")
    members = universe.where(F.col("investable") & (F.col("asset_class") == "fibra")).select("ticker")
    reports = reports.join(members, "ticker", "left_semi")
    known = has_history(panel, reports, FIBRA_FUNDAMENTALS)
    df = asof_join(base, reports, ["ticker"], FIBRA_FUNDAMENTALS, horizon=last_date(panel))
    df = fill_or_null(df, FIBRA_DEFAULTS, known).where(~known | F.col("cap_rate").isNotNull())
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.withColumns({
        "macro_sensitivity_usd": F.lit(0.5),
        "macro_sensitivity_rate": F.lit(-0.2),
        "macro_sensitivity_inflation": F.lit(0.2),
        "momentum": F.col("momentum_63"),
        "volatility": F.col("volatility_63"),
        "value_score": F.col("cap_rate"),
        "quality_score": F.col("ffo_yield") - F.col("vacancy_rate") - F.lit(0.15) * F.col("ltv"),
        "macro_exposure": F.lit(0.5) * zero("exports_yoy") - F.lit(0.2) * zero("banxico_rate") + F.lit(0.2) * zero("inflation_yoy"),
    })


def fixed_income_features(bonds: DataFrame, macro: DataFrame) -> DataFrame:
    df = asof_join(bonds, macro, [], ["banxico_rate"])
    df = df.withColumns({
        "dv01": F.col("duration") * F.col("price") * F.lit(0.0001),
        "carry": F.col("ytm") - F.col("banxico_rate"),
        "banxico_sensitivity": F.col("duration") * F.lit(0.0025),
    })
    return df.withColumns({
        "momentum": F.lit(0.0),
        "volatility": F.coalesce("dv01", F.lit(0.0)),
        "value_score": F.coalesce("carry", F.lit(0.0)),
        "quality_score": -F.col("credit_spread") - F.lit(0.02) * F.col("duration"),
        "macro_exposure": -F.col("duration") * F.coalesce("banxico_sensitivity", F.lit(0.0)),
        "liquidity_score": F.lit(1.0),
    }).drop("banxico_rate")


def signal_matrix(panel: DataFrame, fundamentals: DataFrame, fibra_reports: DataFrame, bonds: DataFrame,
                  macro: DataFrame, universe: DataFrame) -> DataFrame:
    """Union of the three sleeves; columns a sleeve lacks are NULL."""
    parts = [equity_features(panel, fundamentals, macro, universe), fibra_features(panel, fibra_reports, macro, universe)]
    if bonds is not None:
        parts.append(fixed_income_features(bonds, macro))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def etf_features(panel: DataFrame, macro: DataFrame, universe: DataFrame, bonds: DataFrame | None = None) -> DataFrame:
    """Price-only sleeve features plus bond carry."""
    members = universe.where(F.col("investable") & (F.col("asset_class") != "fixed_income")).select(*UNIVERSE_COLUMNS)
    signals = price_signals(panel.join(members.select("ticker"), "ticker", "left_semi"))
    signals = signals.where(F.col("momentum_63").isNotNull() & F.col("volatility_63").isNotNull())
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sleeves = daily_macro(signals.join(members, "ticker"), macro, horizon=last_date(panel)).withColumns({
        "momentum": F.col("momentum_63"), "volatility": F.col("volatility_63"),
        "value_score": F.lit(0.0), "quality_score": F.lit(0.0),
        "macro_exposure": zero("industrial_production_yoy") + F.lit(0.5) * zero("exports_yoy"),
    })
    if bonds is None:
        return sleeves
    government = universe.where(F.col("asset_class") == "fixed_income").select("ticker")
    carry = fixed_income_features(bonds.join(government, "ticker", "left_semi"), macro)
    return sleeves.unionByName(carry, allowMissingColumns=True)


def score_cross_section(features: DataFrame, columns=None) -> DataFrame:
    """Average of the available percentile ranks per date.

    Ranks run in descending order, so the best name has the *smallest* composite score.
    """
    chosen = [c for c in (columns or SCORE_COLUMNS) if c in features.columns]
    ranked = features.withColumns({f"{c}_rank": W.percent_rank_average(c, "date") for c in chosen})
    ranks = [F.col(f"{c}_rank") for c in chosen]
    total = sum((F.coalesce(r, F.lit(0.0)) for r in ranks), F.lit(0.0))
    known = sum((r.isNotNull().cast("int") for r in ranks), F.lit(0))
    return ranked.withColumn("composite_score", total / F.nullif(known, F.lit(0)))


def month_end_dates(df: DataFrame, date: str = "date") -> DataFrame:
    """Last available date of each month."""
    return df.groupBy(F.trunc(date, "MM").alias("_m")).agg(F.max(date).alias("date")).select("date")


def forward_return(df: DataFrame, days: int = 21, price: str = "price", out: str = "forward_return") -> DataFrame:
    """ln(P[t+h] / (P[t] + 1e-9)) and the date at which that label is known."""
    w = by_ticker()
    return df.withColumns({
        out: F.ln(F.lead(price, days).over(w) / (F.col(price) + F.lit(1e-9))),
        f"{out}_date": F.lead("date", days).over(w),
    })
