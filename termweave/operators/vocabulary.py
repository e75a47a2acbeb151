"""Dictionary maintenance: (concept_name, CUI, semantic_type, lang) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.text import language_code

KEYS = ["concept_name", "CUI", "semantic_type"]


def filter_language(vocab: DataFrame, dataset: str) -> DataFrame:
    """For the English dataset the rows of language ENG, those without a language dropped; else all."""
    return vocab.where(language_code("lang") == "ENG") if dataset == "en" else vocab


def enrichment_rows(vocab: DataFrame, entities: DataFrame, missing_cui_only: bool = True, lang: str | None = None) -> DataFrame:
    """Distinct (name, CUI, type) of linked entities that the dictionary lacks.

    Entities are (text, UMLS_CUI, entity_type); null, empty and unlinkable ones are left out.  With
    ``missing_cui_only`` concepts the dictionary has under any name are left out too.
    """
    rows = entities.select(F.col("text").alias("concept_name"), F.col("UMLS_CUI").alias("CUI"), F.col("entity_type").alias("semantic_type"))
    for c in KEYS:
        rows = rows.where(F.col(c).isNotNull() & (F.trim(c) != ""))
    rows = rows.where("CUI <> 'CUILESS'").distinct()
    if missing_cui_only:
        rows = rows.join(vocab.select("CUI").where("CUI is not null").distinct(), "CUI", "left_anti")
    have = vocab.select(*[F.coalesce(c, F.lit("")).alias(c) for c in KEYS]).distinct()
    return rows.join(have, KEYS, "left_anti").select(*KEYS, F.lit(lang).cast("string").alias("lang"))


def enrich(vocab: DataFrame, entities: DataFrame, missing_cui_only: bool = True, lang: str | None = None) -> DataFrame:
    """The dictionary and its enrichment rows; other columns are null there."""
    return vocab.unionByName(enrichment_rows(vocab, entities, missing_cui_only, lang), allowMissingColumns=True)


def prepare_vocabularies(vocab: DataFrame, entities: DataFrame, dataset: str, enrich_dev: bool = False, enrich_test: bool = True) -> tuple[DataFrame, DataFrame]:
    """(dev, test) dictionaries: enriched where asked, then filtered by language."""
    lang = "EN" if dataset == "en" else None
    grown = enrich(vocab, entities, False, lang)
    return filter_language(grown if enrich_dev else vocab, dataset), filter_language(grown if enrich_test else vocab, dataset)


def union_splits(*splits: DataFrame) -> DataFrame:
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
