"""Connected components of a graph given as edges, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, hot_values, joined_to_one


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Each node's neighbours (large: the greater ones) point to the least of the node and its neighbours.

    Minima are combined before the shuffle and joined back, so a node of many edges is a join key, not a group; the
    minima of the most connected nodes are broadcast. n: the number of edges.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        rows = both.where("v > u")
    else:
        rows = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        near = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    out = joined_to_one(rows, near.select("u", "m"), "u", hot_values(near, "u", "n", n), F.xxhash64("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(near.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for each node of an edge u, v that isn't a loop.

    What a round has written is deleted once the next one is there.
    """
    now = checkpointed(edges.where("u <> v").select("u", "v").distinct())
    seen, n = None, now.count()
    for _ in range(most_rounds):
        before, now = now, checkpointed(_star(_star(now, True, n), False, n))
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(before)
        if mark == seen:
            break
        seen, n = mark, mark[0]
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
