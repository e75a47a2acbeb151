"""Reading embedding columns in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id long, v array<double>) of rows whose id isn't null and whose vector has finite components only.

    Empty vectors are left out too.
    """
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equally long rows as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    return np.asarray(pc.list_flatten(column)).astype(np.float64).reshape(n, -1)


def blobs(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    m = np.ascontiguousarray(m)
    return pa.array([r.tobytes() for r in m], pa.binary())


def from_blobs(column, dtype=np.float64) -> np.ndarray:
    """The matrix that :func:`blobs` took apart."""
    values = list(column)
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def reference_vectors(usable_rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors, taken by a hash of the id: a bounded sample that doesn't depend on the row order."""
    rows = usable_rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most).select("v").collect()
    return np.array([r["v"] for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))
