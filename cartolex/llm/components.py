"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.llm.common import cut, drop_cut

MAX_ROUNDS = 60


def large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the smallest vertex that it sees, itself included."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the smallest of them. Edges come as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every vertex of an edge except the smallest of its component, with that smallest vertex.

    ``edges``: columns u and v, of one orderable type; loops, both directions and repeated edges may come, nulls are left
    out. No edge gives no row. A hot vertex is safe: its minimum is summed up before the shuffle, and the join that spreads
    it is one that Spark splits when a partition is skewed. Each round is written to the shared folder.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        nxt = cut(small_star(large_star(now)), "edges")
        drop_cut(now)
        now = nxt
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            return now
        mark = seen
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
