"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns ``a`` and ``b``); component is the smallest node reached.

    Each round links every node to the smallest node it has seen and joins what hung below it to that node; the label
    of a node only falls, and chains halve, so the rounds grow with the logarithm of the longest chain.  A table per
    round in the shared folder cuts the lineage.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = scratch.keep(pairs.distinct(), f"{label}-0")
    before = None
    for i in range(1, rounds + 1):
        # Large star: all neighbours of a node, and the node itself, hang below its smallest neighbour.
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node's smaller neighbours hang below the smallest of them.
        down = large.where(F.col("u") != F.col("v")).distinct()
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        links = scratch.keep(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), f"{label}-{i}")
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{label}-{i - 1}")
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
