"""Sinks and the small hand-off tables between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import REGULATED_KEYS, SEARCH_SPACE


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet sink; long panels are best partitioned by a year column."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}.parquet")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def sector_weight_records(weights: DataFrame, source: str) -> DataFrame:
    """(as_of, sector, weight) -> one record per date with a sector map, ready for the JSON sink."""
    return weights.groupBy("as_of").agg(
        F.lit(source).alias("source"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("sector", "weight")))).alias("sector_weights"),
    )


def read_sector_weights(spark: SparkSession, path: str) -> DataFrame:
    schema = "as_of string, source string, sector_weights map<string,double>"
    records = spark.read.schema(schema).json(path)
    return records.select("as_of", "source", F.explode("sector_weights").alias("sector", "weight"))


def tunable_keys() -> list[str]:
    return [k for k in SEARCH_SPACE if k not in set(REGULATED_KEYS)]


def best_parameters(history: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Trial rows (source, trial_id, value, param, param_value) -> whitelisted best set per source."""
    allowed = list(keys) if keys is not None else tunable_keys()
    rows = history.where(F.col("param").isin(allowed) & F.col("param_value").isNotNull())
    return rows.groupBy("source", "param").agg(
        F.max_by("param_value", F.struct("value", -F.col("trial_id"))).alias("param_value"),
    )
