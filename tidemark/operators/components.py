"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import Scratch, saved


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over rows (hi, lo)."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    least = large.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = large.join(least, "hi")
    small = joined.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()


def _open(edges: DataFrame) -> bool:
    """Whether a node has several lower ends, or one that has a lower end itself."""
    ends = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.lit(None).cast("long").alias("v")))
    per = ends.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("z"), F.count_if(F.col("v").isNull()).alias("below"))
    return bool(per.filter("a is not null and (a <> z or below > 0)").limit(1).count())


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component): the least node that each node of ``links`` (a, b: long) can reach.

    Every round is written to the shared folder, so nothing depends on a lost executor's blocks; a round's table
    is dropped once the next is written, the last stays or goes with ``scratch``. Ends when all links point to
    roots; rounds grow with the logarithm of the longest chain. No links: no rows.
    """
    with Scratch(links.sparkSession) as rounds:
        edges = rounds.saved(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
        while _open(edges):
            before, edges = edges, rounds.saved(_stars(edges))
            rounds.drop(before)
        roots = edges.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
        joined = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)
        return scratch.saved(joined) if scratch else saved(joined)
