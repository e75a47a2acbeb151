"""Reading entities, dictionaries and texts; writing results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = T.StructType([T.StructField(c, T.StringType()) for c in ("document_id", "text", "entity_type", "spans", "UMLS_CUI")])
VOCABULARY = T.StructType([T.StructField(c, T.StringType()) for c in ("concept_name", "CUI", "semantic_type", "lang")])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def split_path(spark: SparkSession, root: str, dataset: str, split: str, explicit: str | None = None) -> str:
    """The given path; else, for test, the TSV where there is one; else the Parquet file of dataset and split."""
    if explicit:
        return explicit
    tsv = f"{root}/tsv/{dataset}/{dataset}_{split}.tsv"
    return tsv if split == "test" and _exists(spark, tsv) else f"{root}/parquet/{dataset}/{dataset}_{split}.parquet"


def read_entities(spark: SparkSession, path: str, schema: T.StructType = ENTITY) -> DataFrame:
    """Parquet by its suffix, else tab-separated with a header; columns of the schema that are absent are null."""
    if path.rstrip("/").endswith(".parquet"):
        found = spark.read.parquet(path)
        return found.select(*[(F.col(f.name).cast(f.dataType) if f.name in found.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
    names = spark.read.option("sep", "\t").option("header", True).csv(path).columns  # the header line only
    by_name = {f.name: f for f in schema.fields}
    own = T.StructType([by_name.get(n, T.StructField(n, T.StringType())) for n in names])
    found = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(own).csv(path)
    return found.select(*[(F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return read_entities(spark, path, VOCABULARY)


def enrichment_datasets(flag: str | None, dataset: str) -> list[str]:
    """The comma-separated list, else all three for ru and bilingual and en alone for en."""
    if flag:
        return [d.strip() for d in flag.split(",") if d.strip()]
    return ["en"] if dataset == "en" else ["bilingual", "en", "ru"]


def language_of(document_id: str = "document_id"):
    """ru or en by the id's ending; any other id is an error."""
    c = F.col(document_id)
    return F.when(c.endswith("_ru"), "ru").when(c.endswith("_en"), "en").otherwise(F.raise_error(F.concat(F.lit("no language in document id "), F.coalesce(c, F.lit("null")))))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, language, split, document_text) of {root}/{language}/{split}/{document_id}.txt, one row per file."""
    rows = spark.read.text(f"{root}/*/*/*.txt", wholetext=True).select(F.col("value").alias("document_text"), F.split("_metadata.file_path", "/").alias("p"))
    part = lambda i: F.element_at("p", -i)
    return rows.select(F.regexp_replace(part(1), r"\.txt$", "").alias("document_id"), part(3).alias("language"), part(2).alias("split"), "document_text")


def write_outputs(metrics: DataFrame, folder: str, predictions: DataFrame | None = None) -> None:
    """Metrics as TSV and JSON, predictions as TSV if there are any."""
    metrics.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/metrics.tsv")
    metrics.coalesce(1).write.mode("overwrite").json(f"{folder}/metrics.json")
    if predictions is not None:
        predictions.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/predictions.tsv")


def metrics_table(metrics: DataFrame) -> DataFrame:
    """Metrics in their fixed column order."""
    return metrics.select(*[c for c in ("split", "acc_1", "acc_5", "acc_10", "acc_20", "mrr") if c in metrics.columns])


def save_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


__all__ = [n for n in globals() if n[0] != "_" and n not in ("annotations", "json")]
