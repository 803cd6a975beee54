"""Exact positions over a whole table without a window in one task.

Rows are range-partitioned by the order, numbered within their partition, and shifted by the sizes of the partitions before: only one number per
partition meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage


def row_numbers(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with a ``name`` from 1 by ``order``, which should tell all rows apart; equal rows come in any order, and fall into one partition."""
    ranged = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(before, "_part").withColumn(name, (F.col("_before") + local).cast("long")).drop("_part", "_before")


def codes(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the values of ``column`` replaced by their dense position from 0; null comes first and has a position too."""
    values = row_numbers(df.select(column).distinct(), [F.col(column).asc_nulls_first()], "_code").withColumnRenamed(column, "_value")
    joined = df.join(values, F.col(column).eqNullSafe(F.col("_value")))
    return joined.select(*[(F.col("_code") - 1).alias(c) if c == column else F.col(c) for c in df.columns])
