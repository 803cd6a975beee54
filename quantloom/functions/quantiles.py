"""Exact quantiles of unbounded columns without gathering the column.

Built-in ``percentile`` keeps every distinct value of a group in one task: right for a
series, wrong for a whole fact column.  Here the answer is located by rank instead:

1. ``approx_percentile`` gives a few cut points closely around the wanted rank (a mergeable
   sketch of bounded size),
2. rows are counted per cut bucket (partial aggregation; a dozen rows shuffle),
3. only the values in the buckets that hold the wanted ranks - about one row in ten
   thousand - are grouped and ranked.

Cut points only split the work, so the result is exact whatever their accuracy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_quantile(df: DataFrame, value: str | Column, q: float) -> DataFrame:
    """One row (n, quantile): linear interpolation between the two nearest order statistics."""
    v = F.col(value) if isinstance(value, str) else value
    values = df.select(v.cast("double").alias("v")).where(F.col("v").isNotNull())
    around = sorted({min(max(q + k * 1e-4, 0.0), 1.0) for k in range(-5, 6)})
    points = values.agg(F.array_distinct(F.approx_percentile("v", around, 10000)))
    # bucket = number of cut points strictly below the value
    below = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    values = values.withColumn("cuts", points.scalar()).select("v", below.alias("bucket"))
    counted = values.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("bucket")  # at most a dozen rows
    offsets = (counted.withColumn("start", F.sum("n").over(w) - F.col("n"))
               .withColumn("total", F.sum("n").over(Window.partitionBy())))
    low_rank = F.floor(F.lit(q) * (F.col("total") - 1))
    wanted = offsets.where((F.col("start") <= low_rank + 1) & (F.col("start") + F.col("n") > low_rank))
    near = (values
            .join(F.broadcast(wanted.select("bucket", "start", "total")), "bucket")
            .groupBy("bucket", "start", "total", "v").agg(F.count(F.lit(1)).alias("k")))
    run = Window.partitionBy("bucket").orderBy("v")
    ranked = near.withColumn("upto", F.col("start") + F.sum("k").over(run))
    at = F.lit(q) * (F.col("total") - 1)
    return ranked.groupBy("total").agg(
        F.min(F.when(F.col("upto") > F.floor(at), F.col("v"))).alias("lo"),
        F.min(F.when(F.col("upto") > F.ceil(at), F.col("v"))).alias("hi"),
    ).select(
        F.col("total").alias("n"),
        (F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at))).alias("quantile"),
    )


def exact_quantile_scalar(df: DataFrame, value: str | Column, q: float) -> Column:
    return exact_quantile(df, value, q).select("quantile").scalar()
