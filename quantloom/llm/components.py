"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Link every node's neighbours to its smallest one: larger neighbours only (``both``: edges seen from either
    end), or the smaller ones and itself.  The least neighbour comes from an aggregate with map-side
    combining and meets the edges in a join, which the planner may split where one node has very many."""
    if both:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u")
    out = joined.where(F.col("v") > F.col("u")) if both else joined
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not both:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    Each step is written to the shared folder, so a lost executor costs one step.  Ends when a
    step changes nothing, after a number of steps that grows with the logarithm of the longest path.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = stage(e, "links")
    before = _state(e)
    while before[0]:
        e = stage(_star(stage(_star(e, True), "large-star"), False), "small-star")
        now = _state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", F.col("v").alias("component")).distinct())
