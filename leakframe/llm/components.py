"""Connected components of a link table, by alternating large and small stars.

Each star is a minimum per node (combined before the shuffle) and a join, so a node with any
share of the links is split like any skewed join key.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakframe.llm.storage import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` has each link once as (u, v) with u > v.  Large star: every neighbour above a
    node is linked to the smallest node around it.  Small star: every neighbour below."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node``, ``component``: the smallest node reachable, for every node that has a link.

    Links are undirected; repeated links, links of a node to itself and null ends are allowed
    and mean nothing.
    """
    a, b = F.col(left), F.col(right)
    current = stored(
        links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = None
    while True:
        state = current.agg(mark.alias("s")).first()["s"]
        if state == before or state[0] == 0:
            break
        before = state
        current = stored(_star(_star(current, large=True), large=False), "stars")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
