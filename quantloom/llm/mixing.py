"""Mixing sources to target weights by weighted sampling without replacement.

Each document draws an exponential key divided by its quality weight.  Sorted by that key inside
its source, the documents form a weighted sample at every prefix, so a prefix sum of sizes cut at
the budget selects them.  Whole passes over a source come first, the rest is the cut prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import unit

#: Weights of the sources in code point order, repeating.
SOURCE_WEIGHTS = (5, 2, 1)
#: The mix takes this share of all words; no source gives more than CAP times its own.
SHARE, CAP = 1.5, 2.0
#: Slices of the key range.  Sizes are summed per (source, slice), so no task sorts a whole source.
SLICES = 4096
SALT = "mix:"


def quality_weight(quality: Column) -> Column:
    """2 for documents labelled good, 1/2 for those labelled bad, 1 without a label."""
    return F.when(quality.isNull(), F.lit(1.0)).when(quality >= 0.5, F.lit(2.0)).otherwise(F.lit(0.5))


def source_targets(sizes: DataFrame, weights=SOURCE_WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Words to take from each source.  ``sizes``: one row per source (source, source_size).

    The level L solves sum(min(cap * size, L * weight)) = share * sum(size).  In the order of
    cap * size / weight the capped sources come first, so L follows from two prefix sums.  This
    table has one row per source, so its windows may run in one task.
    """
    everything = Window.partitionBy()
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(listed) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", w).withColumn("most", F.lit(cap) * F.col("source_size"))
    before = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("pos", F.row_number().over(before.rowsBetween(Window.unboundedPreceding, 0)))
    budget = F.lit(share) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct("pos", "level"))).over(everything)
    target = F.when(first.isNull(), F.col("most")).otherwise(F.least(F.col("most"), first["level"] * F.col("w")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=SOURCE_WEIGHTS, share: float = SHARE, cap: float = CAP, salt: str = SALT) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs``: doc_id, source, size (words, long), weight (positive quality weight, double).
    Returns doc_id, source, size, source_size, target, taken, epochs.  ``taken`` is ``epochs`` times
    the size, plus the size again for documents of the cut prefix; the document on which the budget
    ends gives only the words still wanted, so a source's total is its target rounded to words.

    Null doc_id and null source are values like any other (all null sources are one source, listed
    last).  Empty documents have size 0 and give nothing.  Repeated rows count as often as they
    occur; equal keys are ordered by doc_id and size.  An empty table gives an empty result.
    Other columns of ``docs`` are ignored.
    """
    key = -F.ln(unit(F.col("doc_id"), salt)) / F.col("weight")
    d = docs.select("doc_id", "source", "size", key.alias("key")).withColumn(
        "slice", F.least(F.floor(F.lit(SLICES) * (1 - F.exp(-F.col("key")))), F.lit(SLICES - 1)).cast("int"))
    d = stage(d, "mix-keys")
    parts = d.groupBy("source", "slice").agg(F.sum("size").alias("part"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, cap)
    below = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("part_source"), F.col("slice").alias("part_slice"),
                         F.coalesce(F.sum("part").over(below), F.lit(0)).alias("below"))
    parts = parts.join(targets, F.col("part_source").eqNullSafe(F.col("source"))).drop("source")
    d = d.join(parts, F.col("source").eqNullSafe(F.col("part_source")) & (F.col("slice") == F.col("part_slice")))
    inside = Window.partitionBy("part_source", "part_slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("wanted") - F.col("epochs") * F.col("source_size") - F.col("ahead")
    return (d.withColumn("ahead", F.col("below") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .withColumn("wanted", wanted).withColumn("epochs", epochs)
            .select("doc_id", "size", "source_size", "target",
                    (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))).cast("long").alias("taken"),
                    "source", "epochs"))
