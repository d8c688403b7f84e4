"""Connected components by alternating large-star and small-star steps on an edge table; nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import settle


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges (u, v), u > v.  Large: larger neighbours of each node move to its least neighbour; small: the smaller ones and itself."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if small:
        out = moved.where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): every linked node with the least node of its component."""
    edges = settle(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = None
    while (now := state(edges)) != before:
        before = now
        edges = settle(_star(_star(edges, small=False), small=True))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
