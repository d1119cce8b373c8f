"""Connected components by repeated contraction, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return (node, component): the smallest node that each node of ``links`` reaches.

    Every round points each node at its smallest neighbour (or itself), follows the pointers to their ends by doubling, and
    replaces the ends of each link by where they point. At most half of the nodes of a component remain after a round.
    Minima are pre-aggregated, and joins on a popular node are plain equi-joins, which AQE splits when skewed.
    Empty input gives an empty result; self-links only name their node.
    """
    links = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct())
    member = cut(links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).distinct().withColumn("component", F.col("node")))
    links = links.where("u <> v")
    while not links.isEmpty():
        both = links.union(links.select(F.col("v"), F.col("u")))
        up = cut(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("up")))
        moved = True
        while moved:  # two jumps a step: the depth of the trees falls to a quarter
            for _ in range(2):
                top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
                up = up.join(top, "up").select("node", F.col("top").alias("up"), F.col("up").alias("before"))
            up = cut(up)
            moved = not up.where("up <> before").isEmpty()
        up = up.select("node", "up")
        member = cut(member.join(up.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        links = links.join(up.select(F.col("node").alias("u"), F.col("up").alias("u2")), "u").join(up.select(F.col("node").alias("v"), F.col("up").alias("v2")), "v")
        links = cut(links.where("u2 <> v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct())
    return member
