"""Contiguous, byte-balanced shards from global prefix sums.

Rows are put in one global order by a range partitioning, each partition contributes one total, the
running sum of those totals gives every partition its global offset, and a row's shard is read off
the position of its midpoint on the line of all bytes, cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.common import cut, partitions, text_or_empty


def byte_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    Order is (id, crc, size), nulls first; rows equal in all three are interchangeable, so ties and
    repeated rows stay well defined.  A null text counts no bytes (size = ``overhead``, crc of the
    empty text); a null id sorts first.  Shards are contiguous in that order, sizes differ by at most
    one row, and with fewer rows than shards some shards are empty.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text_or_empty(text_col)).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(F.encode(text_or_empty(text_col), "UTF-8")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    # The partition id is written with the rows: a recomputed partition could hold others.
    placed = cut(sized.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "shards")
    totals = sorted(placed.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect())  # one row per partition
    starts, byte_at, row_at = [], 0, 0
    for part, b, n in totals:
        starts.append((part, byte_at, row_at))
        byte_at, row_at = byte_at + b, row_at + n
    offsets = spark.createDataFrame(starts, "part int, byte_at long, row_at long")

    local = Window.partitionBy("part").orderBy(*order)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shard = F.least(
        F.lit(n_shards - 1),
        F.expr(f"cast((2 * start + size) * {n_shards} div {max(1, 2 * byte_at)} as int)"),
    )
    rows = (
        placed.join(F.broadcast(offsets), "part")
        .withColumn("start", F.col("byte_at") + F.sum("size").over(running) - F.col("size"))
        .withColumn("row", F.col("row_at") + F.row_number().over(local) - 1)
        .withColumn("shard", shard)
    )
    # Contiguity makes a shard's slots the distance from its first row: at most n_shards rows.
    first = rows.groupBy("shard").agg(F.min("row").alias("first_row"))
    return rows.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int"),
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
