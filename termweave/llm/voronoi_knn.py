"""Exact top-k inner products by a Voronoi kNN join.

Rows are grouped by their nearest pivot.  Each group is summarised by its size, its radius and its
smallest distances to the pivot; these summaries give every query a score that its k best reach at
least, and every pair of query and group a score that no row of the group exceeds.  A group is sent
only the queries it can matter to, large groups are cut in blocks, and each (query group, block) is
solved locally; the k best of all blocks are then ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.common import cut, partitions
from termweave.llm.vectors import blobs, from_blobs, matrix, reference_vectors, usable

BLOCK = 2048  # rows of a data block, and queries of a query group
EXACT = float(1 << 53)


def pivot_count(n: int) -> int:
    return int(min(256, max(4, n // BLOCK)))


def _assign(pivots: np.ndarray, scale: float):
    """Integer vectors with their nearest pivot and their distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(1) / 2
        for batch in batches:
            v = matrix(batch.column(1))
            if not len(v):
                continue
            q = np.floor(v * scale)
            cell = np.argmax(q @ pivots.T - half, 1)
            far = np.sqrt(((q - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.sqrt((q**2).sum(1))), blobs(q)], ["vec_id", "cell", "far", "norm", "q"])

    return run


def _route(pivots: np.ndarray, cells: np.ndarray, radius: np.ndarray, near: list[np.ndarray], k: int):
    """The groups each query must see: those whose best possible score reaches the query's sure k-th best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = np.repeat(np.arange(len(cells)), [len(d) for d in near])
        dist = np.concatenate(near)
        for batch in batches:
            q = from_blobs(batch.column(3).to_pylist()) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            if not len(q):
                continue
            norm = np.sqrt((q**2).sum(1))[:, None]
            dots = q @ pivots[cells].T
            slack = 1e-6 * (1 + norm * np.sqrt((pivots**2).sum(1)).max())  # more than rounding can take
            best = dots + norm * radius + slack
            own = np.asarray(batch.column(4))  # so many rows of the query's own id may be among the best
            need = k - 1 + own
            least = np.full(len(q), -np.inf)
            able = need < len(dist)
            if able.any():
                sure = -np.sort(norm * dist - dots[:, owner], axis=1)
                least[able] = sure[able, need[able]] - slack[able, 0]
            row, col = np.nonzero(best >= least[:, None])
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), batch.column(2).take(pick), pa.array(cells[col].astype(np.int32)), batch.column(3).take(pick)], ["query_id", "home", "part", "cell", "q"])

    return run


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows, exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    wide = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, x)) for x in r] for r in wide], np.int64)


def _solve(k: int):
    def run(key, queries, data):
        import pandas as pd

        if not len(queries) or not len(data):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids = data["vec_id"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        ids, b = ids[order], from_blobs(data["q"])[order]
        who = queries["query_id"].to_numpy(np.int64)
        scores = _products(from_blobs(queries["q"]), b)
        out = []
        for i in range(len(who)):
            s = scores[i]
            at = np.flatnonzero(ids != who[i])
            if len(at) > 4 * k:  # all that tie with the kth best are kept until the sort
                at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
            at = at[np.argsort(-s[at], kind="stable")][:k]
            out.append((np.full(len(at), who[i]), ids[at], s[at]))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out))})

    return run


def top_k(embeddings: DataFrame, k: int = 5, scale: float = 256.0, query_mod: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row whose id is divisible by ``query_mod``.

    Components become floor(scale * x) in double precision, the score is the integer inner product,
    ties go to the smaller vec_id.  Vectors that are null, empty, or hold null or non-finite
    components take no part, nor do rows with a null id.  Vectors of different lengths have no inner
    product: each length is a table of its own.  With fewer than k other rows all are returned; an
    empty table gives no rows.  Rows repeated under one id are ranked each, but a query isn't ranked
    against rows of its own id, and is answered once for each length and each of its distinct vectors.
    """
    spark = embeddings.sparkSession
    good = usable(embeddings, id_col, vec_col)
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % query_mod == 0).alias("asks")).where("asks > 0").orderBy("d").collect()
    parts = [_of_one_length(good.where(F.size("v") == r["d"]), r["n"], k, scale, query_mod) for r in sizes]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _of_one_length(good: DataFrame, count: int, k: int, scale: float, query_mod: int) -> DataFrame:
    spark = good.sparkSession
    pivots = np.unique(np.floor(reference_vectors(good, pivot_count(count)) * scale), axis=0)
    data = cut(good.mapInArrow(_assign(pivots, scale), "vec_id long, cell int, far double, norm double, q binary"), "cells")
    small = data.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("far"))).where(F.col("r") <= k + 1)
    near = {r["cell"]: r["near"] for r in small.groupBy("cell").agg(F.sort_array(F.collect_list("far")).alias("near")).collect()}  # k + 1 numbers a pivot
    cells = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.count_if(F.col("vec_id") % query_mod == 0).alias("asks")).orderBy("cell").collect()
    names = np.array([r["cell"] for r in cells])

    # Query groups: the queries of one cell, cut by a hash where there are more than a block of them.
    asks = spark.createDataFrame([(r["cell"], max(1, -(-r["asks"] // BLOCK)), max(1, -(-r["n"] // BLOCK))) for r in cells], "cell int, parts int, blocks int")
    asking = data.where(F.col("vec_id") % query_mod == 0)
    own = asking.groupBy("vec_id").agg(F.count("*").alias("own"))
    asked = asking.dropDuplicates(["vec_id", "q"]).join(own, "vec_id").join(F.broadcast(asks), "cell")  # asks: a row for each of 256 pivots at most
    asked = asked.select("vec_id", F.col("cell").alias("home"), F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "q", "own")
    routed = asked.mapInArrow(_route(pivots, names, np.array([r["radius"] for r in cells]), [np.array(near[c]) for c in names], k), "query_id long, home int, part int, cell int, q binary")
    # Cells are small in number, so query groups are gathered to about a block each before data follow them.
    total = sum(r["asks"] for r in cells)
    groups = max(1, -(-total // BLOCK))
    group = {r["cell"]: 0 for r in cells}
    along = np.argsort(pivots[names] @ pivots[names[0]], kind="stable")
    seen = 0
    for i in along:
        group[int(names[i])] = min(groups - 1, seen // BLOCK)
        seen += cells[i]["asks"]
    grouped = spark.createDataFrame(sorted(group.items()), "home int, g int")
    routed = cut(routed.join(F.broadcast(grouped), "home").select("query_id", "g", "part", "cell", "q"), "routed")

    # Only the pairs of data block and query group that are wanted are built; they grow with the queries, so they aren't broadcast.
    wanted = routed.select("cell", F.col("g").alias("to_g"), F.col("part").alias("to_part")).distinct().join(F.broadcast(asks.select("cell", "blocks")), "cell")
    wanted = wanted.select("cell", "to_g", "to_part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    placed = data.join(F.broadcast(asks), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    left = routed.join(F.broadcast(asks.select("cell", "blocks")), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = placed.select("cell", "block", "vec_id", "q").join(wanted, ["cell", "block"]).select(F.col("to_g").alias("g"), F.col("to_part").alias("part"), "cell", "block", "vec_id", "q")
    keys = ["g", "part", "cell", "block"]
    n = partitions(spark)
    best = left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInPandas(_solve(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
