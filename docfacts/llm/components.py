"""Connected components of a graph given as a table of links, by alternating star contraction.

Each round every node hands its larger neighbours to its smallest one (large star), then its smaller neighbours (small
star). Links stay in tables; each round is one written to the shared folder. No group is gathered: only minima are
aggregated, and the joins back are plain equi-joins that Spark can split where one node has many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _star(links: DataFrame, larger: bool) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(low, "u")
    if larger:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable, for each node that has a link. links: columns a, b of whole numbers."""
    now = durable(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        now = durable(_star(_star(now, True), False), "stars")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError("components did not settle")
    low = now.groupBy("b").agg(F.count("*"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        low.select(F.col("b").alias("node"), F.col("b").alias("root"))
    )
