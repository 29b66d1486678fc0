"""Connected components of a link table, without any node's links in one place."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import stored


def _smallest(pairs: DataFrame) -> DataFrame:
    """Per node ``u``: ``m``, the smallest of itself and its neighbours ``v``."""
    return stored(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "smallest")


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that hangs on none."""
    hanging = edges.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.lit(False).alias("held"))
    held = edges.groupBy(F.col("v").alias("node")).agg(F.lit(0).alias("n"), F.lit(True).alias("held"))
    nodes = hanging.unionByName(held).groupBy("node").agg(F.sum("n").alias("n"), F.max("held").alias("held"))
    return nodes.where((F.col("n") > 1) | ((F.col("n") > 0) & F.col("held"))).limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v); a component is named by its smallest node.

    Alternates two steps until only stars are left: each node hands its larger neighbours to the smallest
    node it knows, then its smaller ones. Smallest nodes are partial aggregates and are joined back, so
    a node with very many links is a skewed join. Each round is a stored table.
    """
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .where("u <> v").distinct(), "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "links")
        lows = _smallest(large)
        small = large.join(lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(lows.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
