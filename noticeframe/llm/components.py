"""Connected components of a link table by alternating large-star and small-star rounds.

Each round replaces the links of a node by links to its smallest neighbour. Nothing is collected:
a round's only result on the driver is one count and one checksum. Neighbour minima are partial
aggregates, and the joins back to the links are plain equi-joins that adaptive execution can split
when one node holds a large share of the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, read_once


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, component)`` for every node with a link; the component is its smallest node.

    ``links`` may hold either direction, repeats and self links. Nodes are integers. Nulls are
    ignored, an empty table gives an empty table.
    """
    edges = durable(
        links.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        mark = read_once(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))).collect()[0]
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = mark
        edges = durable(_small_star(_large_star(edges)))
