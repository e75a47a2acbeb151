"""Connected components by alternating large-star and small-star.

The graph stays a distributed edge table; every round is two joins on the node, the result of a round
is written to the shared folder, and rounds end when the edge table no longer changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import cut, drop_cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node, and its smaller neighbours, are linked to the smallest of them; edges point from larger (u) to smaller (v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link to another.

    Nulls, loops and repeated links are ignored; no links give no rows.  A node without links is its
    own component and isn't listed.
    """
    start = edges.select(F.col(u).cast("long").alias("a"), F.col(v).cast("long").alias("b")).where("a <> b")
    now = cut(start.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _state(now)
    while seen[0]:
        new = cut(_small_star(_large_star(now)), "links")
        state = _state(new)
        drop_cut(now)
        now = new
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
