"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Rows descend from the root over regions and racks to a shard. At each node every
child draws -ln(u) / weight, u being a hash of the row's key and the child's
name alone, and the least draw wins. A child's draws do not depend on its
siblings, so changing weights moves rows only into subtrees whose weight rose
and out of those whose weight fell; all others keep what they have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: {region: {rack: {shard: weight}}}
Tree = dict[str, dict[str, dict[int, float]]]
BASE = 8


def topology(shards: int) -> Tree:
    """The tree for so many shards of weight 1: up to BASE in regions of two racks of two, each further one a region of its own.

    A region added at the root takes rows only into itself, so one more shard
    beyond BASE never moves a row between shards that were there before.
    """
    tree: Tree = {}
    for s in range(shards):
        region, rack = (f"region{s // 4}", f"rack{s // 2}") if s < BASE else (f"region-of-{s}", f"rack-of-{s}")
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def weight(node) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def _draw(key: Column, name: str, w: float) -> Column:
    """-ln(u) / weight, u from the upper 53 bits of a hash of key and name."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 53))) / F.lit(w)


def _choose(key: Column, at: str, node) -> Column:
    """The shard (int) that ``key`` reaches below ``node``."""
    if not isinstance(node, dict):
        return F.lit(int(at.rsplit("/", 1)[1]))
    children = [(f"{at}/{name}", child) for name, child in node.items() if weight(child) > 0]
    if len(children) == 1:
        return _choose(key, *children[0])
    draws = [F.struct(_draw(key, name, weight(child)).alias("draw"), F.lit(i).alias("i")) for i, (name, child) in enumerate(children)]
    won = F.least(*draws)["i"]
    first, *rest = [(i, _choose(key, name, child)) for i, (name, child) in enumerate(children)]
    return reduce(lambda case, x: case.when(won == x[0], x[1]), rest, F.when(won == first[0], first[1]))


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a row by its key (null: the hash of null) and the tree alone."""
    return _choose(key, "", tree)


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) per row of ``docs``.

    size: UTF-8 bytes of the text and 1; slot: gapless from 0 in each shard, in
    an order that groups of shard and hash fix, so that a shard, however large,
    is numbered by many tasks. A null text has no bytes, a null id is a key like
    any other, repeated rows take slots of their own; an empty table gives an
    empty result; only the two named columns are read and texts are never moved.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = rows.withColumns({"shard": shard_of(F.col("id"), tree), "grown_shard": shard_of(F.col("id"), grown) if grown else F.lit(None).cast("int")})
    # As many groups a shard as tasks of a shuffle: their number follows the cluster and the data, not the shard.
    groups = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("id", "text_crc32", F.lit("slot")), F.lit(groups)))
    counts = salted.groupBy("shard", "__salt").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "__salt", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("shard", "__salt").orderBy("id", "text_crc32", "size"))
    placed = salted.withColumn("__in", inside).join(starts, ["shard", "__salt"])
    return placed.select("id", "size", "text_crc32", "shard", (F.col("__start") + F.col("__in") - 1).alias("slot"), "grown_shard")
