"""Late fusion of dense and sparse lists, and the search over its parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.ranking import first_per_key, minmax, top_k


def fusion_pool(dense: DataFrame, sparse: DataFrame, missing_dense: DataFrame | None = None, missing_sparse: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, dense, sparse): the candidates of both lists, missing scores looked up, else 0; both scaled per query."""
    both = dense.select("query_id", "item_id", F.col("score").alias("d")).join(sparse.select("query_id", "item_id", F.col("score").alias("s")), ["query_id", "item_id"], "full")
    for name, extra in (("d", missing_dense), ("s", missing_sparse)):
        if extra is not None:
            both = both.join(extra.select("query_id", "item_id", F.col("score").alias("_x")), ["query_id", "item_id"], "left").withColumn(name, F.coalesce(name, "_x")).drop("_x")
    return scaled_pool(both.fillna(0.0, ["d", "s"]))


def scaled_pool(both: DataFrame) -> DataFrame:
    """(query_id, item_id, dense, sparse) of candidates (query_id, item_id, d, s), scaled per query."""
    return both.select("query_id", "item_id", F.round(minmax(F.col("d"), ["query_id"]), 6).alias("dense"), F.round(minmax(F.col("s"), ["query_id"]), 6).alias("sparse"))


def fuse(pool: DataFrame, weights: list[float], keys: DataFrame, k: int) -> DataFrame:
    """(weight, query_id, rank, key, item_id, score): for every weight of the dense side at once the k best distinct keys.

    ``keys`` is (item_id, key).
    """
    grid = pool.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    scored = grid.withColumn("score", F.round(F.col("weight") * F.col("dense") + (1 - F.col("weight")) * F.col("sparse"), 6)).join(keys, "item_id")
    by = ["weight", "query_id"]
    # The best item of each key is the first per key; ranks need no list of everything.
    best = top_k(scored, 1, [*by, "key"]).drop("rank")
    return top_k(best, k, by).select("weight", "query_id", "rank", "key", "item_id", "score")


def best_of_grid(rows: DataFrame, metric: str, others: list[str], order: list[str]) -> DataFrame:
    """The row of the greatest metric; then of the other metrics; then the first in grid order."""
    return rows.orderBy(F.desc(metric), *[F.desc(o) for o in others], *order).limit(1)


__all__ = ["best_of_grid", "first_per_key", "fuse", "fusion_pool", "scaled_pool"]
