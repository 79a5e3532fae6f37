"""Connected components of an undirected graph given as an edge table (alternating stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.llm.common import dropped, written


def connected_components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a long, b long)``; root is the smallest node it reaches.

    Large-star and small-star steps alternate until the edge set is a forest of stars, in
    O(log^2 n) rounds.  Each round is two aggregations with map-side combining and two equi-joins; nodes with
    many edges, of which there are at most :data:`HOT_NODES`, are joined by broadcast, so that a star's centre
    is in no task alone.  Its result is written to the shared folder, so that a lost executor costs one
    round at most.  Self loops give no row; null ends are ignored; an empty table gives an empty table.
    """
    now = written(_directed(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).na.drop()), f"{label}-0")
    mark = _mark(now)
    for k in range(1, max_rounds + 1):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_with_least(both, 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), f"{label}-large")
        small = _with_least(large, mark[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = written(_directed(small), f"{label}-{k}")
        dropped(now)
        dropped(large)
        now, old, mark = after, mark, _mark(after)
        if old == mark:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Nodes with many edges at most: their least neighbours are broadcast, some 16 bytes each.
HOT_NODES = 10_000


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """``(u, v, m)``: each of about ``n`` edges with the least ``v`` of its ``u``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    many = max(100, -(-n // HOT_NODES))  # at most n / many nodes have so many edges
    hot = F.broadcast(least.where(F.col("n") > many).select("u", "m"))
    cold = edges.join(hot.select("u"), "u", "left_anti").join(least.where(F.col("n") <= many).select("u", "m"), "u")
    return edges.join(hot, "u").select("u", "v", "m").unionByName(cold.select("u", "v", "m"))


def _directed(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
