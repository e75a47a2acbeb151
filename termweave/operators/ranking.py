"""Top-k lists in long form: (query, rank, item, score), best first, ties by item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_depth(k: int, n_items: int, dedup: bool, factor: int = 4) -> int:
    """How many items to fetch for k results: more where results are then made distinct."""
    return min(n_items, max(k, k * factor)) if dedup else k


def top_k(scores: DataFrame, k: int, query: list[str], score: str = "score", item: str = "item_id") -> DataFrame:
    """The k best rows of each query with their rank; planned as partial and final group limits."""
    w = Window.partitionBy(*query).orderBy(F.desc(score), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_per_key(ranked: DataFrame, k: int, query: list[str], key: str) -> DataFrame:
    """Keeps the best row of each key, then the first k keys, ranked anew.

    The input's ``rank`` is the order.  A list that was cut before may hold fewer than k keys; rank
    everything first for a result that is exact.
    """
    first = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*query, key).orderBy("rank"))).where("_n = 1").drop("_n")
    again = first.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy("rank")))
    return again.where(F.col("rank") <= k)


def merge_top_k(left: DataFrame, right: DataFrame, k: int, query: list[str], score: str = "score", item: str = "item_id") -> DataFrame:
    """The top k of two partial lists."""
    both = left.drop("rank").unionByName(right.drop("rank")).dropDuplicates([*query, item])
    return top_k(both, k, query, score, item)


def pad_to(ranked: DataFrame, width: int, query: list[str]) -> DataFrame:
    """Repeats each query's last row up to ``width`` rows; queries without rows stay without."""
    last = ranked.withColumn("_last", F.max("rank").over(Window.partitionBy(*query)))
    copies = F.when(F.col("rank") == F.col("_last"), F.sequence(F.col("rank"), F.greatest(F.col("rank"), F.lit(width)))).otherwise(F.array(F.col("rank")))
    return last.withColumn("rank", F.explode(copies)).drop("_last")


def keep_depth(ranked: DataFrame, k: int) -> DataFrame:
    """A stored list cut to a smaller depth."""
    return ranked.where(F.col("rank") <= k)


def stored_depth(ranked: DataFrame) -> int:
    return ranked.agg(F.max("rank")).first()[0] or 0


def minmax(score: Column, query: list[str]) -> Column:
    """Scores of a query scaled to [0, 1]; a flat list is 1 where positive, else 0."""
    w = Window.partitionBy(*query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < 1e-12, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((score - low) / (high - low))
