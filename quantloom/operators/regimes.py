"""Macro regimes and their allocation bounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import REGIME_BOUNDS, SLEEVE_BOUNDS
from ..functions import windows as W
from ..settings import DEFAULTS
from .joins import asof_join


def _macro_window(keys):
    # one macro history has one row per month; extra keys allow many histories at once
    return Window.partitionBy(*(keys or [F.lit(1)])).orderBy("date")


def regime_inputs(macro: DataFrame, keys=()) -> DataFrame:
    w = _macro_window(keys)
    return macro.select(
        *keys, "date", W.diff("banxico_rate", w, 3).alias("banxico_delta_3m"),
        W.pct_change("usd_mxn", w, 3).alias("fx_mom_3m"), F.col("industrial_production_yoy").alias("ip_yoy"))


def threshold_regimes(macro: DataFrame, rate_step: float = 0.25, keys=()) -> DataFrame:
    df = regime_inputs(macro, keys)
    stress = (F.col("ip_yoy") < 0.0) | (F.col("fx_mom_3m") > 0.05)
    label = F.when(stress, "stress").when(F.col("banxico_delta_3m") > rate_step, "tightening").otherwise("expansion")
    return df.withColumn("regime", label)


def composite_regimes(macro: DataFrame, settings: dict | None = None, keys=()) -> DataFrame:
    """Smoothed score z(IP) - z(FX) - z(rate), thresholds, and hysteresis on low confidence.

    A row switches regime unless its confidence is known and too low; so the regime in force
    is the last raw label among the rows allowed to switch (the first row always is).
    """
    cfg = {**DEFAULTS, **(settings or {})}
    w = _macro_window(keys)
    df = regime_inputs(macro, keys)
    score = W.expanding_zscore("ip_yoy", w) - W.expanding_zscore("fx_mom_3m", w) - W.expanding_zscore("banxico_delta_3m", w)
    df = df.withColumn("regime_score", score)
    alpha = 2.0 / (int(cfg["regime_ewma_span"]) + 1.0)
    df = df.withColumn("regime_score_smoothed", W.ewma("regime_score", w, alpha, min_periods=3))
    smooth = F.col("regime_score_smoothed")
    df = df.withColumn("regime_confidence", F.least(F.abs(smooth), F.lit(3.0)))
    raw = (F.when(smooth.isNull() | (smooth > float(cfg["regime_threshold_expansion"])), "expansion")
           .when(smooth < float(cfg["regime_threshold_stress"]), "stress").otherwise("tightening"))
    df = df.withColumn("raw_regime", raw)
    may_switch = (F.col("regime_confidence").isNull() | (F.col("regime_confidence") >= float(cfg["regime_min_confidence_for_switch"]))
                  | (F.row_number().over(w) == 1))
    held = F.last(F.when(may_switch, F.col("raw_regime")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("regime", held)


def regime_history(macro: DataFrame, settings: dict | None = None, keys=()) -> DataFrame:
    method = str((settings or {}).get("regime_method", DEFAULTS["regime_method"])).lower()
    return threshold_regimes(macro, keys=keys) if method == "threshold_discrete" else composite_regimes(macro, settings, keys)


def latest_regime(history: DataFrame) -> DataFrame:
    """One row; an empty history means expansion."""
    return history.agg(F.coalesce(F.max_by("regime", "date"), F.lit("expansion")).alias("regime"))


def count_switches(history: DataFrame, label: str = "regime", keys=()) -> DataFrame:
    w = _macro_window(keys)
    changed = history.withColumn("_c", (F.lag(label).over(w).isNotNull() & (F.col(label) != F.lag(label).over(w))).cast("long"))
    grouped = changed.groupBy(*keys) if keys else changed
    return grouped.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("switches"))


def bounds_table(spark, table=None) -> DataFrame:
    rows = [(r, a, float(lo), float(hi)) for r, classes in (table or REGIME_BOUNDS).items() for a, (lo, hi) in classes.items()]
    return spark.createDataFrame(rows, "regime string, asset_class string, min_weight double, max_weight double")


def regime_bounds(regimes: DataFrame) -> DataFrame:
    """Class bounds per row of ``regimes`` (unknown labels use expansion)."""
    spark = regimes.sparkSession
    known = F.when(F.col("regime").isin(list(REGIME_BOUNDS)), F.col("regime")).otherwise(F.lit("expansion"))
    return regimes.withColumn("_r", known).join(F.broadcast(bounds_table(spark).withColumnRenamed("regime", "_r")), "_r").drop("_r")


def liquidity_sleeve(regimes: DataFrame) -> DataFrame:
    """Sleeve weight = midpoint of the regime range, split half and half over two bills."""
    spark = regimes.sparkSession
    table = spark.createDataFrame([(r, float(a), float(b)) for r, (a, b) in SLEEVE_BOUNDS.items()], "_r string, sleeve_min double, sleeve_max double")
    known = F.when(F.col("regime").isin(list(SLEEVE_BOUNDS)), F.col("regime")).otherwise(F.lit("expansion"))
    mid = (F.col("sleeve_min") + F.col("sleeve_max")) / F.lit(2.0)
    return (regimes.withColumn("_r", known).join(F.broadcast(table), "_r").drop("_r")
            .withColumns({"total_sleeve": mid, "cetes28_weight": mid / 2.0, "cetes91_weight": mid / 2.0}))


def blend_bounds(previous: DataFrame, current: DataFrame, alpha: float, keys=("asset_class",)) -> DataFrame:
    """Linear interpolation of two bound tables; a class on one side only passes through."""
    a = min(max(float(alpha), 0.0), 1.0)
    joined = previous.alias("p").join(current.alias("c"), list(keys), "full")

    def mix(c):
        p, n = F.col(f"p.{c}"), F.col(f"c.{c}")
        return F.when(p.isNull(), n).when(n.isNull(), p).otherwise(F.lit(1.0 - a) * p + F.lit(a) * n)

    return joined.select(*keys, mix("min_weight").alias("min_weight"), mix("max_weight").alias("max_weight"))


def transition_path(regimes: DataFrame, min_confidence: float = 0.3, steps: int = 2, key: str = "strategy_id") -> DataFrame:
    """Two-step entry into a low-confidence regime, walked over the rebalance dates.

    Input (key, date, regime, regime_confidence); adds effective label and blend weight.  The state (last regime, where a
    transition leads from and to, its step) is carried along a key's dates by one ordered pass; nothing but the row of the date is held.
    """
    schema = f"{key} string, date date, effective_regime string, transition_alpha double"

    def walk(batches):
        now = previous = target = origin = None
        step = 0
        for batch in batches:
            out = []
            for owner, date, regime, confidence in zip(*(batch.column(c).to_pylist() for c in (key, "date", "regime", "regime_confidence"))):
                if owner != now:
                    now, previous, target, origin, step = owner, regime, None, None, 0
                if regime != previous and confidence is not None and confidence < min_confidence:
                    if target != regime:
                        origin, target, step = previous, regime, 1
                    out.append((owner, date, f"{origin}->{regime}", step / steps))
                    if step >= steps:
                        previous, target, origin, step = regime, None, None, 0
                    else:
                        step += 1
                else:
                    previous, target, origin, step = regime, None, None, 0
                    out.append((owner, date, regime, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.date32(), pa.string(), pa.float64()))],
                                             names=[key, "date", "effective_regime", "transition_alpha"])

    rows = regimes.select(F.col(key).cast("string").alias(key), "date", "regime", "regime_confidence")
    return rows.repartition(key).sortWithinPartitions(key, "date").mapInArrow(walk, schema)


def bounds_in_force(history: DataFrame, dates: DataFrame, base: DataFrame, min_confidence: float = 0.3, steps: int = 2) -> DataFrame:
    """(as_of, asset_class, min_weight, max_weight) at each of ``dates``: the bounds of the regime then known, blended while it is entered.

    A class of ``base`` that the regimes don't name keeps its bounds; regime classes outside ``base`` are left out, as are dates before the history: there ``base`` holds.
    """
    known = asof_join(dates.select("date").distinct(), history.select("date", "regime", "regime_confidence"), [], ["regime", "regime_confidence"])
    path = transition_path(known.where(F.col("regime").isNotNull()).withColumn("strategy_id", F.lit("all")), min_confidence, steps)
    side = F.split("effective_regime", "->")
    ends = path.select("date", F.coalesce("transition_alpha", F.lit(1.0)).alias("a"), F.element_at(side, 1).alias("origin"), F.element_at(side, -1).alias("target"))
    columns = ("date", "asset_class", "min_weight", "max_weight")
    before = regime_bounds(ends.select("date", F.col("origin").alias("regime"))).select(*columns)
    after = regime_bounds(ends.select("date", "a", F.col("target").alias("regime"))).select(*columns, "a")
    both = before.alias("b").join(after.alias("c"), ["date", "asset_class"])
    mixed = both.select("date", "asset_class", *[((1 - F.col("c.a")) * F.col(f"b.{m}") + F.col("c.a") * F.col(f"c.{m}")).alias(f"_{m}") for m in ("min_weight", "max_weight")])
    listed = F.explode(base.agg(F.collect_list(F.struct("asset_class", "min_weight", "max_weight"))).scalar())  # a few classes ride along with each date
    every = dates.select("date").distinct().withColumn("b", listed).select("date", "b.*")
    return every.join(mixed, ["date", "asset_class"], "left").select(
        F.col("date").alias("as_of"), "asset_class", F.coalesce("_min_weight", "min_weight").alias("min_weight"), F.coalesce("_max_weight", "max_weight").alias("max_weight"))
