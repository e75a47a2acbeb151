"""Ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTOFFS = (1, 5, 10, 20)


def ranking_metrics(predictions: DataFrame, gold: DataFrame, by: list[str] | None = None, cutoffs=CUTOFFS, order: str | None = None) -> DataFrame:
    """Acc@k and MRR of predictions (query_id, rank, prediction) against gold (query_id, gold[, by...]).

    The denominator is all gold rows; a query without predictions is a miss; where ``gold`` holds a
    query twice the last row by its column ``order`` counts (without one, that of the greatest gold).
    A cutoff beyond the deepest rank is null.
    """
    by = by or []
    truth = gold.groupBy("query_id", *by).agg((F.max_by("gold", order) if order else F.max("gold")).alias("gold"))
    hits = truth.join(predictions.select("query_id", "rank", "prediction"), "query_id", "left").groupBy(*by, "query_id").agg(F.min(F.when(F.col("prediction") == F.col("gold"), F.col("rank"))).alias("at"), F.max("rank").alias("deep"))
    measures = [F.round(F.when(F.max("deep") >= k, F.avg(F.when(F.col("at") <= k, 1.0).otherwise(0.0))), 6).alias(f"acc_{k}") for k in cutoffs]
    return hits.groupBy(*by).agg(F.count("*").alias("n_queries"), *measures, F.round(F.avg(F.coalesce(1.0 / F.col("at"), F.lit(0.0))), 6).alias("mrr"))


def without_unlinkable(gold: DataFrame, mark: str = "CUILESS") -> DataFrame:
    """Gold rows but those marked unlinkable; a null gold stays (and is never hit)."""
    return gold.where(~F.col("gold").eqNullSafe(mark))


def pairwise_metrics(scored: DataFrame) -> DataFrame:
    """Acc@1, Acc@5, MRR of (query_id, label, score, retriever_score, rank) rows, ordered by score, retriever score (nulls last), rank."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("retriever_score"), "rank")
    at = scored.withColumn("_p", F.row_number().over(w)).groupBy("query_id").agg(F.min(F.when(F.col("label") > 0, F.col("_p"))).alias("at"))
    share = lambda k: F.round(F.avg(F.when(F.col("at") <= k, 1.0).otherwise(0.0)), 6)
    return at.agg(share(1).alias("acc_1"), share(5).alias("acc_5"), F.round(F.avg(F.coalesce(1.0 / F.col("at"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n_queries"))


def best_epoch(history: DataFrame, metric: str, patience: int) -> DataFrame:
    """(epoch, value, best_epoch, stop): the best epoch so far and whether ``patience`` epochs passed since.

    History is one row per epoch, so its window is small by nature.
    """
    from pyspark.sql import Window

    so_far = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max_by("epoch", F.struct(metric, -F.col("epoch"))).over(so_far)
    return history.withColumn("best_epoch", best).withColumn("stop", F.col("epoch") - F.col("best_epoch") >= patience)
