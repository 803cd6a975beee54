"""Query registry.

A query is a function ``(spark, sf_dir) -> DataFrame`` plus a column list such as
``"date ticker price:6"``: names in output order, with the digits doubles are rounded to.
The same list wraps the checking SQL, so both sides always agree on names and rounding.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .ctes import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, int | None]]:
    out = []
    for item in spec.split():
        name, _, digits = item.partition(":")
        out.append((name, int(digits) if digits else None))
    return out


def rounded(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*[
        F.col(name) if digits is None else (F.round(F.col(name).cast("double"), digits) + F.lit(0.0)).alias(name)
        for name, digits in _columns(spec)
    ])


def _needed(body: str, seen: dict[str, None]) -> None:
    for word in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", body)):
        if word in CTES and word not in seen:
            _needed(CTES[word], seen)
            seen[word] = None


def checked_sql(body: str, spec: str) -> str:
    """Body plus the shared CTEs it names (dependencies first), rounded like the query."""
    seen: dict[str, None] = {}
    _needed(body, seen)
    heads = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in seen)
    items = ", ".join(
        name if digits is None else f"round(CAST({name} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {name}"
        for name, digits in _columns(spec)
    )
    prefix = f"WITH {heads}\n" if heads else ""
    return f"{prefix}SELECT {items} FROM ({body}) AS answer"


def query(name: str, spec: str, sql: str | None = None):
    """Register a query; ``sql`` is the body that must give the same rows."""

    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return rounded(fn(spark, sf_dir), spec)

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = checked_sql(sql, spec)
        return fn

    return register
