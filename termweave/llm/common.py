"""Helpers shared by the training-data operators.

Every operator selects the columns it names and ignores all others, so extra columns with clashing
names never reach its plan.  Intermediate results that must not change when an executor is lost are
written as tables in the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="termweave-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.  Where the session names none, a temporary one in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_folder(spark.sparkContext.applicationId)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, row content is fixed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/termweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._termweave_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like :func:`cut`, but dealt into files by a hash of ``key``, so that a join on it doesn't move these rows again."""
    spark = df.sparkSession
    table_name = f"termweave_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/termweave/{table_name}"
    df.write.option("path", path).bucketBy(partitions(spark), key).saveAsTable(table_name)
    out = spark.table(table_name)
    out.schema  # resolved now: the plan holds path and buckets, the catalog entry isn't needed any more
    spark.sql(f"DROP TABLE {table_name}")
    out._termweave_path = path
    return out


def drop_cut(*frames: DataFrame) -> None:
    """Delete tables written by :func:`cut` or :func:`bucketed` that no later step reads."""
    for df in frames:
        path = getattr(df, "_termweave_path", None)
        if path is None:
            continue
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_or_empty(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_bucket(id_col: str, mod: int):
    """crc32 of the id written as text, modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % mod


def release() -> None:
    """Give memory that was freed back to the system: Python workers stay alive for later stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """An Arrow function over batches that calls :func:`release` after each batch it gives and at its end."""

    def tidy(batches):
        for out in run(batches):
            yield out
            del out
            release()
        release()

    return tidy


def lean_group(run):
    """A grouped function that calls :func:`release` when its own arrays are gone."""

    def tidy(pdf):
        out = run(pdf)
        release()
        return out

    return tidy


def byte_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string/binary column and its n+1 offsets; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return flat, offs - offs[0]


def slices(flat: np.ndarray, offs: np.ndarray, limit: int = 2 << 20):
    """Runs of whole documents of about ``limit`` bytes (more for a longer document): (first, last + 1, bytes, offsets)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, flat[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
