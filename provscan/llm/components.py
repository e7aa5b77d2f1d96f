"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provscan.llm.scratch import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: hang every neighbour (large: the greater ones; else the lesser ones) on the least."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hung = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = hung.union(least.select("u", F.col("m").alias("v")))
    return hung.where("u != v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long, u != v): root is the least node it reaches.

    Each round is two aggregations and joins on the node, so a hub with very many
    neighbours is pre-aggregated and its join can be split. Rounds grow with the
    logarithm of the largest component; no edge leaves the executors. An empty
    table of edges gives an empty result; repeated and reversed edges count once.
    """
    now = scratch.write(edges.select("u", "v").where("u != v").distinct(), "edges-0")
    before, k = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before, k = mark, k + 1
        now = scratch.write(_stars(_stars(now, True), False), f"edges-{k}")
        scratch.drop(f"edges-{k - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
