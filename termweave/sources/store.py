"""Artifacts kept as Parquet beside their description, reused where they still fit."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.sources.readers import _exists, read_json, save_json


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> str:
    """sha256 of the columns, row count, and the sum and xor of row hashes: the same for any row order."""
    columns = df.columns if columns is None else columns
    h = F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("null")) for c in columns])
    r = df.select(h.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return hashlib.sha256(json.dumps([columns, r["n"], str(r["s"]), r["x"]]).encode()).hexdigest()


def list_description(vocabulary: DataFrame, queries: DataFrame, query_columns: list[str], **config) -> dict:
    """What stored candidate lists depend on: the vocabulary, the queries and the settings given."""
    settings = json.loads(json.dumps(config, sort_keys=True, default=str))
    return {"vocabulary": fingerprint(vocabulary), "queries": fingerprint(queries, query_columns), "config": settings}


def config_key(config: dict) -> str:
    """sha256 of a configuration, the same for any order of its entries; names what is built from it."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


class ArtifactStore:
    """load-or-build by name; a stored list that is deep enough serves smaller depths."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _described(self, name: str) -> dict | None:
        path = f"{self.root}/{name}.json"
        return read_json(self.spark, path) if _exists(self.spark, path) else None

    def get(self, name: str, config: dict, build: Callable[[], DataFrame], depth: int | None = None, rank: str = "rank") -> DataFrame:
        """The stored table where its configuration equals ``config`` and its depth suffices; else built, stored and returned.

        With a depth the table is cut to it.
        """
        config = json.loads(json.dumps(config))
        have = self._described(name)
        fits = have is not None and have["config"] == config and (depth is None or (have["depth"] or 0) >= depth)
        path = f"{self.root}/{name}.parquet"
        if not fits:
            build().write.mode("overwrite").parquet(path)
            save_json(self.spark, f"{self.root}/{name}.json", {"config": config, "depth": depth})
        found = self.spark.read.parquet(path)
        return found if depth is None else found.where(F.col(rank) <= depth)
