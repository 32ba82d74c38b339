"""Connected components of a link table by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import cut, meet, spent


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links``; component is its smallest node.

    Each round lets every node point at its lowest neighbour (or itself), then replaces
    both ends of each link by what they point at. Order is by id in the first round, as
    links mostly come as stars around the smallest id, and by a hash that changes each
    round afterwards: a path then loses a constant share of its nodes in each round,
    so the rounds grow with the logarithm of the longest path. What a round makes is
    written to the shared folder and deleted when it is spent. Hub nodes are skewed keys of
    plain joins, which adaptive execution splits; the minimum is pre-aggregated before its
    shuffle, and the roots of large components are joined by broadcast.
    Null ends and self links are ignored; an empty table gives an empty result. The result
    is a written table; ``spent`` deletes it.
    """
    e = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    e = cut(e.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct())
    steps: list[DataFrame] = []
    for k in range(rounds):
        if e.isEmpty():
            break
        rank = (lambda c: F.col(c)) if k == 0 else (lambda c, k=k: F.xxhash64(F.col(c), F.lit(k)))
        both = e.select("a", F.struct(rank("b").alias("r"), F.col("b").alias("v")).alias("x")).unionByName(e.select(F.col("b").alias("a"), F.struct(rank("a").alias("r"), F.col("a").alias("v")).alias("x")))
        low = both.groupBy("a").agg(F.min("x").alias("x"))
        step = cut(low.select(F.col("a").alias("u"), F.least(F.col("x"), F.struct(rank("a").alias("r"), F.col("a").alias("v")))["v"].alias("p")))
        steps.append(step)
        moved = e.join(step.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(step.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        left = cut(moved.where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        spent(e)
        e = left
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if not steps:
        out = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        out._cut_path = e._cut_path
        return out
    at = steps[0].select(F.col("u").alias("node"), "p")
    for step in steps[1:]:
        at = at.join(step.withColumnRenamed("p", "q"), F.col("p") == F.col("u"), "left").select("node", F.coalesce("q", "p").alias("p"))
    at = cut(at)
    least = cut(at.groupBy("p").agg(F.min("node").alias("component"), F.count("*").alias("n")))
    out = cut(meet(at, least, "p", at.count()).select("node", "component"))
    spent(e, at, least, *steps)
    return out
