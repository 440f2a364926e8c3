"""Connected components of a graph of links, by alternating large and small stars.

Each round is two aggregations and two joins over the links. A node's links meet its least
neighbour in parts: a node of more than HOT links, or a thousandth of all, is dealt out by a
salt, so that nothing of a component's size meets in one task or the driver. Such nodes are
2,000 at most, which bounds what is broadcast. Every half round is written to the shared folder,
which cuts the lineage. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import staged

#: Links of a node that meet in one task.
HOT = 256


def _star(links: DataFrame, total: int, large: bool) -> DataFrame:
    """links (a, b), a > b. Large: neighbours above a node go to its least neighbour. Small: those below it."""
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    part = max(HOT, total // 1000)
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.ceil(F.count("*") / part).alias("parts"))
    hot = F.broadcast(least.where("parts > 1").select("a", F.col("parts").alias("_of")))
    ways = ways.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("_of", F.lit(1))).alias("part"))
    both = ways.join(least.select("a", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")), ["a", "part"])
    if large:
        return both.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    moved = both.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: long); component is the smallest node reachable."""
    now = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    total = now.count()
    sums = None
    while total:
        now = staged(_star(now, total, True).where("a <> b").distinct(), "links")
        now = staged(_star(now, total, False).where("a <> b").distinct(), "links")
        # stars that no longer move have as many links and the same sum of hashes as before
        last, sums = sums, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        total = sums[0]
        if sums == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
