"""Connected components of a table of links by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours on the smallest one: every node's larger neighbours, or a node with its smaller neighbours.

    The smallest neighbour comes from a mergeable aggregate and a join, so a node with very many links is no single group.
    """
    ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    low = ways.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    joined = ways.join(low, "a")
    if larger:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
    own = low.select("a", F.col("low").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(own).filter("a <> b").distinct()


def oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes of the links ``a``, ``b``; links to itself do not count.

    Each round is written in the shared folder and only its size and sum come to the driver. Rounds grow with the logarithm
    of the longest chain.
    """
    shared_dir(edges.sparkSession)
    state = oriented(edges).distinct().checkpoint()
    seen = None
    while True:
        state = oriented(star(star(state, True), False)).distinct().checkpoint()
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
