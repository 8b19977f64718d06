"""Connected components of an edge table by alternating large and small stars.

Every step is a pre-aggregated minimum per node and a join; labels and links
stay in Spark. The minima are pre-aggregated, but the joins deal rows by node:
the links of one hub meet in one task unless Spark's skew join splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def _least(edges: DataFrame, extra: bool) -> DataFrame:
    """node, m: the least of a node and its neighbours (``a`` side)."""
    return edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select(
        "n", (F.least("n", "m") if extra else F.col("m")).alias("m")
    )


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b of any one ordered type. Returns node, component (the least node reachable)."""
    now = written(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        both = _both(now)
        least = _least(both, True)
        large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Each node now points to smaller ones only.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = _least(down, False)
        next_ = down.join(small, F.col("a") == F.col("n")).select("b", "m", "a")
        stars = next_.select(F.col("b").alias("a"), F.col("m").alias("b")).union(next_.select("a", F.col("m").alias("b")))
        now = written(stars.filter("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
