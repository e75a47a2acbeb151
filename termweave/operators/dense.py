"""Dense retrieval: block-wise inner products within each type, partial top-k per block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.operators.best import Best
from termweave.operators.ranking import top_k

QUERY_BLOCK, ITEM_BLOCK = 4096, 16384
#: Scores of so many queries and items are in memory at once (8 MB).
QUERY_TILE, ITEM_TILE = 256, 4096
ROWS = pa.schema([("type", pa.string()), ("query_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])


def unit_vector(c: Column) -> Column:
    """A vector in double precision with norm 1; a zero vector stays."""
    v = c.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _matrix(vectors) -> np.ndarray:
    """A list column as a matrix; lists of other lengths than the first are an error, as for a product."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.list_value_length(vectors))
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of a type differ in length")
    flat = vectors.combine_chunks().flatten() if len(sizes) else pa.array([], pa.float64())
    return np.asarray(flat, dtype=np.float64).reshape(len(sizes), -1 if len(flat) else 0)


def _block_top(k: int, skip_self: bool, schema: pa.Schema):
    def run(key, queries, items):
        who, ids = queries.column("query_id").to_numpy(), items.column("item_id").to_numpy()
        if not len(who) or not len(ids):
            return schema.empty_table()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        asked, held = _matrix(queries.column("v")), _matrix(items.column("v"))[order]
        best = Best(len(who), k)
        for i in range(0, len(ids), ITEM_TILE):
            part = held[i : i + ITEM_TILE].T
            for q in range(0, len(who), QUERY_TILE):
                scores = asked[q : q + QUERY_TILE] @ part
                if skip_self:
                    scores[who[q : q + QUERY_TILE, None] == ids[None, i : i + ITEM_TILE]] = -np.inf
                best.add(q, i, scores)
        n = len(best.query)
        return pa.table([pa.array([key[0].as_py()] * n, pa.string()), pa.array(who[best.query]), pa.array(ids[best.item]), pa.array(best.score)], schema=schema)

    return run


def dense_top_k(queries: DataFrame, items: DataFrame, k: int, skip_self: bool = False, query_block: int = QUERY_BLOCK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(type, query_id, item_id, score, rank): the k items of the query's type with the greatest inner product.

    Inputs are (type, query_id, v) and (type, item_id, v).  Scores are rounded to 6 digits before
    they are ranked; a type that one side lacks, and a null type, gives no rows.
    """
    spark = queries.sparkSession
    sizes_q = queries.where("type is not null").groupBy("type").agg(F.ceil(F.count("*") / query_block).cast("int").alias("nq"))
    sizes_i = items.where("type is not null").groupBy("type").agg(F.ceil(F.count("*") / item_block).cast("int").alias("ni"))
    grid = sizes_q.join(sizes_i, "type")  # a row for each type
    q = queries.join(F.broadcast(grid), "type").withColumn("qb", F.pmod(F.xxhash64("query_id"), "nq")).withColumn("ib", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)))
    i = items.join(F.broadcast(grid), "type").withColumn("ib", F.pmod(F.xxhash64("item_id"), "ni").cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq").cast("long") - 1)))
    left = q.select("type", F.col("qb").cast("long").alias("qb"), "ib", "query_id", "v")
    right = i.select(*[F.col(c).alias(c) for c in ("type", "qb", "ib", "item_id", "v")])  # new columns: both sides may come from one table
    keys = ["type", "qb", "ib"]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    best = left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInArrow(_block_top(k, skip_self, ROWS), "type string, query_id long, item_id long, score double")
    return top_k(best, k, ["type", "query_id"])


def pair_scores(pairs: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """Inner products of listed pairs (query_id, item_id); each vector is read once per pair."""
    rows = pairs.join(queries.select("query_id", F.col("v").alias("_q")), "query_id").join(items.select("item_id", F.col("v").alias("_i")), "item_id")
    return rows.select("query_id", "item_id", F.round(dot(F.col("_q"), F.col("_i")), 6).alias("score"))


def with_dense_scores(pairs: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """pairs (query_id, item_id, d, ...) with the inner product where ``d`` is null."""
    rows = pairs.join(queries.select("query_id", F.col("v").alias("_q")), "query_id").join(items.select("item_id", F.col("v").alias("_i")), "item_id")
    return rows.withColumn("d", F.when(F.col("d").isNull(), F.round(dot(F.col("_q"), F.col("_i")), 6)).otherwise(F.col("d"))).drop("_q", "_i")
