"""Connected components of an edge table by alternating large and small stars.

Every round turns edges towards smaller neighbours with two aggregations and two equi-joins; the edges of
a round are written to the shared folder. It ends when the edges are stars, after a number of rounds that
grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, label: str = "components") -> DataFrame:
    """edges: u, v (long). Returns node, component (smallest node reachable) for every node that isn't
    itself the smallest of its component."""
    now = scratch.cut(_small(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))), f"{label}0")
    seen, step = None, 0
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, step = mark, step + 1
        now = scratch.cut(_small(_large(now)), f"{label}{step}")
        scratch.drop(f"{label}{step - 1}")
