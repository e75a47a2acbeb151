"""Search over the parameters of the sparse side and the weight of the dense side together."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.fusion import best_of_grid, fuse, fusion_pool
from termweave.operators.metrics import CUTOFFS, ranking_metrics


def valid_parameters(parameters: dict) -> bool:
    """Whether the shortest n-gram isn't longer than the longest; parameters without both always are valid."""
    return not {"min_ngram", "max_ngram"} <= parameters.keys() or int(parameters["min_ngram"]) <= int(parameters["max_ngram"])


def parameter_grid(choices: dict[str, list]) -> list[dict]:
    """All valid combinations of the sparse parameters, in the order of the choices."""
    names = [n for n in choices if n != "dense_weight"]
    return [p for values in product(*(choices[n] for n in names)) if valid_parameters(p := dict(zip(names, values)))]


def search_parameters(dense: DataFrame, sparse: Callable[[dict], DataFrame], keys: DataFrame, gold: DataFrame, choices: dict[str, list], k: int, order: str | None = None) -> DataFrame:
    """A row for each valid combination and dense weight: position, parameters (JSON), dense_weight, n_queries, acc_k..., mrr.

    ``sparse`` gives the lists (query_id, item_id, score) of a combination; the dense lists are the same
    for all.  One plan evaluates the whole grid, which is small; ``gold`` is (query_id, gold).
    """
    weights = [float(w) for w in choices["dense_weight"]]
    grid = parameter_grid(choices)
    if not grid or not weights:
        raise ValueError("no valid combination of parameters")
    parts = [fuse(fusion_pool(dense, sparse(p)), weights, keys, k).withColumn("position", F.lit(i)) for i, p in enumerate(grid)]
    whole = reduce(DataFrame.unionByName, parts)
    name = F.struct("position", "weight", F.col("query_id").alias("q"))
    found = whole.select(name.alias("query_id"), "rank", F.col("key").alias("prediction"))
    spark = dense.sparkSession
    points = spark.createDataFrame([(i, json.dumps(p, sort_keys=True), w) for i, p in enumerate(grid) for w in weights], "position int, parameters string, weight double")
    asked = gold.crossJoin(F.broadcast(points))  # the grid's size
    asked = asked.withColumn("query_id", F.struct("position", "weight", F.col("query_id").alias("q")))
    rows = ranking_metrics(found, asked, by=["position", "parameters", "weight"], order=order)
    return rows.withColumnRenamed("weight", "dense_weight")


def best_parameters(rows: DataFrame, metric: str = "mrr") -> DataFrame:
    """The row of the best metric, then of the other metrics, then the first of the grid."""
    others = [c for c in ["mrr", *(f"acc_{c}" for c in CUTOFFS)] if c != metric]
    return best_of_grid(rows, metric, others, ["position", "dense_weight"])
