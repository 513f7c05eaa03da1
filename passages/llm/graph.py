"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is two joins with a group minimum, dealt by salts, so a node with very many links is no
group of one task. Each round is written to the shared folder, which ends its lineage. Rounds end when all
components are stars around their smallest nodes, which one grouped sum tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.common import with_group_min, written


def _are_stars(links: DataFrame) -> bool:
    """Whether each node has one link to a smaller one, which has none itself, or only links to larger ones."""
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of a link the smallest node that it reaches. Self-links and
    repeated links change nothing; nodes without links have no row."""
    now = written(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi > lo").distinct(), "links")
    while not _are_stars(now):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = with_group_min(both, ["u"], "v", ["v"], ("m", "n")).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = with_group_min(large, ["u"], "v", ["v"], ("m", "n"))
        stars = small.select(F.col("u").alias("hi"), F.col("m").alias("lo")).unionByName(small.select(F.col("v").alias("hi"), F.col("m").alias("lo")))
        now = written(stars.filter("hi > lo").distinct(), "links")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
