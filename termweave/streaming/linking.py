"""Mention linking over a stream: exact dictionary lookup and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def link_mentions(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """mentions (…, name, type) joined to (concept_name, semantic_type, CUI); the same for a stream and a table.

    Unknown mentions stay with a null CUI.
    """
    d = dictionary.select(F.lower("concept_name").alias("_n"), F.col("semantic_type").alias("_t"), "CUI").groupBy("_n", "_t").agg(F.min("CUI").alias("CUI"))
    return mentions.join(d, (F.lower(mentions["name"]) == d["_n"]) & mentions["type"].eqNullSafe(d["_t"]), "left").drop("_n", "_t")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """(start, by, n, total) of tumbling windows; rows later than the watermark are left out of a stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.col("window.start").alias("start"), by, "n", "total")


def first_events(events: DataFrame, late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """One event per key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys or ["event_id"])


def read_stream(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """A folder of Parquet files as a stream, with the schema of what lies there now."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything available now, written as Parquet batch by batch; a batch written twice replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
