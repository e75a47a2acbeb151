"""Embedding near-duplicates through a pivot-permutation index.

Each vector is described by its nearest reference vectors in order (the head of its permutation) and
posted in the list of each of them.  All pairs of a list are compared by cosine.  Reference vectors
are kept apart, so that a dense group holds one and its vectors meet in that list, however large the
group is.  Lists are cut in blocks, so that a list of any length is compared block by block in many
tasks; a block pair returns link counts and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import cut, drop_cut, partitions
from termweave.llm.components import connected_components
from termweave.llm.vectors import blobs, from_blobs, matrix, reference_vectors, usable

PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 128, 64, 16384
HEAD, BLOCK, TILE = 8, 4096, 512
#: Reference vectors of a greater cosine aren't used together, and as many rows a reference vector are looked at.
APART, TRIED = 0.75, 2


def pivot_count(n: int) -> int:
    """Reference vectors for n vectors: lists of about HEAD * PER_PIVOT entries, and a bounded sample."""
    return int(min(MOST_PIVOTS, max(LEAST_PIVOTS, n // PER_PIVOT)))


def spread(rows: np.ndarray, most: int, apart: float = APART) -> np.ndarray:
    """At most ``most`` of the rows, as unit vectors: in their order, each that has no cosine above ``apart`` to one taken before."""
    unit = rows / np.abs(rows).max(1)[:, None]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    free = np.ones(len(unit), bool)
    taken: list[int] = []
    for i in range(len(unit)):
        if free[i]:
            taken.append(i)
            if len(taken) == most:
                break
            free[i:] &= unit[i:] @ unit[i] <= apart
    return unit[taken]


def _heads(pivots: np.ndarray, head: int, least: float, before: int = 0):
    """The nearest reference vectors of each vector, as far as a linked vector can have its nearest one there.

    The nearest reference vector of a linked vector is at most twice the link angle farther than the own
    nearest one.  Places of those farther off hold the nearest one again.  Their numbers start at ``before``.
    """
    reach = 2 * np.arccos(np.clip(least, -1, 1)) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1))
            if not len(v):
                continue
            v = v / np.abs(v).max(1)[:, None]  # the scale doesn't matter, and squares can't overflow
            v /= np.linalg.norm(v, axis=1)[:, None]
            near = v @ pivots.T
            order = np.argsort(-near, axis=1, kind="stable")[:, :head].astype(np.int32)
            angle = np.arccos(np.clip(np.take_along_axis(near, order, 1), -1, 1))
            order = np.where(angle <= angle[:, :1] + reach, order, order[:, :1])
            flat, offs = pa.array(order.ravel() + np.int32(before)), pa.array(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(offs, flat), blobs(v)], ["rep", "weight", "head", "unit"])

    return run


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between positions a and b, (id, smallest id of its group) for all positions linked."""
    root = np.arange(len(ids))
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    low = rank.copy()
    while True:  # labels only fall, and fall along both the links and their own pointers
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        root[rank] = np.arange(len(ids))
        new = np.minimum(new, new[root[new]])
        if (new == low).all():
            break
        low = new
    touched = np.unique(np.concatenate([a, b]))
    return ids[touched], ids[root[low[touched]]]


def _compare(least: float, tile: int = TILE):
    """Counts and forest of the links of one block pair; rows: pivot, left, right, block, rep, weight, head, unit."""

    def run(key, pdf):
        import pandas as pd

        pivot, left, right = key
        ids, weight = pdf["rep"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64)
        heads = np.stack(pdf["head"].to_numpy())
        unit = from_blobs(pdf["unit"])
        block = pdf["block"].to_numpy()
        links = np.zeros(len(ids), np.int64)
        edges = [np.empty((2, 0), np.int64)]
        xs, ys = np.flatnonzero(block == left), np.flatnonzero(block == right)
        for at in range(0, len(xs), tile):
            x = xs[at : at + tile]
            for to in range(at if left == right else 0, len(ys), tile):
                y = ys[to : to + tile]
                hit = unit[x] @ unit[y].T >= least
                if left == right and at == to:
                    hit = np.triu(hit, 1)
                if not hit.any():
                    continue
                hit &= _first_here(heads[x], heads[y], pivot)
                links[x] += hit @ weight[y]
                links[y] += weight[x] @ hit
                i, j = _spanning(hit)
                edges.append(np.stack([x[i], y[j]]))
        a, b = np.concatenate(edges, 1)
        if not len(a):
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        who, root = _forest(ids, a, b)
        return pd.DataFrame({"rep": who, "links": links[np.unique([a, b])], "root": root})

    return run


def _first_here(x: np.ndarray, y: np.ndarray, pivot: int) -> np.ndarray:
    """Pairs of rows that share no reference vector below ``pivot``: each pair counts in one list only."""
    names = np.intersect1d(x[x < pivot], y[y < pivot])
    if not len(names):
        return np.ones((len(x), len(y)), bool)
    one_x, one_y = ((h[:, :, None] == names).any(1).astype(np.float32) for h in (x, y))
    return one_x @ one_y.T == 0


def _spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of few of the links that connect all that the links connect."""
    hit = hit.copy()
    n, m = hit.shape
    a = b = np.empty(0, np.int64)
    while hit.any():  # each group with a link to another one is joined with one: the groups at least halve
        i, j = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        a = np.concatenate([a, i, hit[:, j].argmax(0)])
        b = np.concatenate([b, hit[i].argmax(1), j])
        label = np.arange(n + m)
        who, root = _forest(label, a, n + b)
        label[who] = root
        hit &= label[:n, None] != label[n:]
    return a, b


def embedding_near_duplicates(embeddings: DataFrame, least: float = 0.9, head: int = HEAD, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors are linked where their cosine in double precision is ``least`` or more.  Null, empty and
    zero vectors and those holding null or non-finite components have no links.  Vectors of different
    lengths aren't linked: each length has reference vectors and lists of its own.  Equal vectors form one class with a weight, so copies aren't
    compared; a row of the same id counts as another vector.  A row with a null id has no links, a
    null component and kept = false.  An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    ids = embeddings.select(F.col(id_col).cast("long").alias("vec_id"))
    good = usable(embeddings, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()  # a row for each length
    if not sizes:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    classes = cut(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    # One id may name several vectors; classes then get an id of their own beside it.
    member = good.join(classes, "v").select("vec_id", "rep", "weight", F.xxhash64("v").alias("kind"))

    parts, before = [], 0
    for r in sizes:
        own = classes.where(F.size("v") == r["d"])
        most = pivot_count(r["n"])
        pivots = spread(reference_vectors(own.select(F.col("rep").alias("vec_id"), "v"), TRIED * most), most)
        parts.append(own.select("rep", "v", "weight").mapInArrow(_heads(pivots, min(head, len(pivots)), least, before), "rep long, weight long, head array<int>, unit binary"))
        before += len(pivots)
    heads = cut(reduce(DataFrame.unionAll, parts), "heads")
    lists = heads.select(F.explode(F.array_distinct("head")).alias("pivot")).groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # a row for each pivot
    posted = heads.select(F.explode(F.array_distinct("head")).alias("pivot"), "rep", "weight", "head", "unit").join(F.broadcast(lists), "pivot")
    posted = posted.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = posted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    pairs = pairs.select("pivot", "left", "right", "block", "rep", "weight", "head", "unit").repartition(partitions(spark), "pivot", "left", "right")
    found = cut(pairs.groupBy("pivot", "left", "right").applyInPandas(_compare(least), "rep long, links long, root long"), "found")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    same_id = member.groupBy("vec_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v"))
    edges = found.select(F.col("rep").alias("u"), F.col("root").alias("v")).unionAll(same_id.select("u", "v"))
    roots = connected_components(edges)
    per_id = member.groupBy("vec_id").agg(F.min("rep").alias("rep"), F.max("weight").alias("weight"))
    result = (
        per_id.join(links, "rep", "left")
        .join(roots, per_id["rep"] == roots["node"], "left")
        .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = ids.join(result, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
    drop_cut(heads)
    return out
