"""Concept profiles: a representative name and a short, varied choice of aliases per concept."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions.aliases import GROUP_LIMITS, KINDS, alias_kind, is_abbreviation, quality_penalty, representative_order, sanitize_alias, similarity
from termweave.functions.text import alias_key, caseless, language_code, language_priority, normalize_text

SCHEMA = (
    "CUI string, semantic_type string, candidate_text string, representative_name string, representative_name_normalized string, selected_aliases array<string>, "
    "selected_aliases_normalized array<string>, selected_alias_count int, num_aliases_raw int, num_aliases_kept int, num_duplicates_removed int, num_long_removed int, "
    "num_noisy_removed int, languages array<string>, alias_length_threshold int"
)


def alias_length_threshold(names: DataFrame, column: str = "concept_name", quantile: float = 0.995, scale: float = 3.0, least: int = 96, most: int = 256) -> DataFrame:
    """One row of length statistics and the length beyond which aliases are left out."""
    size = names.select(F.length(F.trim(F.coalesce(column, F.lit("")))).alias("n")).where("n > 0")
    q = lambda p: F.percentile("n", F.lit(p))
    s = size.agg(F.count("*").alias("num_aliases"), q(0.25).alias("q1"), q(0.75).alias("q3"), q(quantile).alias("quantile_value"), q(0.5).alias("median"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max("n").cast("double").alias("longest"))
    iqr = F.col("q3") + scale * F.greatest(F.col("q3") - F.col("q1"), F.lit(1.0))
    s = s.withColumn("iqr_value", iqr)
    threshold = F.greatest(F.lit(least), F.least(F.lit(most), F.bround(F.least("quantile_value", "iqr_value"), 0))).cast("double")
    s = s.withColumn("threshold", F.coalesce(threshold, F.lit(float(least)))).drop("q1", "q3")
    return s.fillna({"quantile_value": float(least), "iqr_value": float(least), "median": 0.0, "p95": 0.0, "p99": 0.0, "longest": 0.0})


def alias_records(vocab: DataFrame, preferred: list[str], allowed: list[str] | None = None, compose: bool = True) -> DataFrame:
    """Cleaned aliases of (item_id, concept_name, CUI, semantic_type, lang) with all that selection asks for, computed in columns.

    ``alias`` is empty where it was rejected.
    """
    rows = vocab.withColumn("language", language_code("lang", blank="UNK"))
    if allowed:
        rows = rows.where(F.col("language").isin(*allowed))
    rows = rows.withColumn("alias", sanitize_alias(F.col("concept_name")))
    penalty = quality_penalty(F.col("alias"))
    return rows.select(
        "item_id",
        F.coalesce("CUI", F.lit("")).alias("CUI"),
        F.coalesce("semantic_type", F.lit("")).alias("semantic_type"),
        "language",
        "alias",
        alias_key("alias", compose).alias("key"),
        normalize_text("alias", compose).alias("normalized"),
        alias_kind(F.col("alias")).alias("kind"),
        is_abbreviation(F.col("alias")).alias("abbreviation"),
        *[p.alias(f"penalty{i}") for i, p in enumerate(penalty)],
        language_priority(F.col("language"), preferred).alias("priority"),
        F.length("alias").alias("size"),
        caseless("alias").alias("folded"),
        representative_order(F.col("alias")).alias("order"),
    )


def representatives(vocab: DataFrame, preferred: list[str], threshold: int = 256, compose: bool = True) -> DataFrame:
    """(CUI, semantic_type, representative): the best name of the best language present."""
    rows = alias_records(vocab, preferred, compose=compose).where((F.col("alias") != "") & (F.col("size") <= threshold))
    first = F.row_number().over(Window.partitionBy("CUI", "semantic_type", "key").orderBy("item_id"))
    rows = rows.withColumn("_n", first).where("_n = 1")
    return rows.groupBy("CUI", "semantic_type").agg(F.min_by("alias", F.struct("priority", "language", "order")).alias("representative"))


def _words(t: str) -> set[str]:
    return set(re.findall(r"\w+", t))


def varied(aliases: list[dict], limit: int, representative: str, known: dict | None = None) -> list[dict]:
    """Greedy choice: best language and quality first, then the least like what is chosen already.

    Similarities are kept, so each pair is compared once; the nearest chosen alias and the sum of
    similarities are carried along instead of being recomputed.
    """
    known = {} if known is None else known

    def like(a: str, b: str) -> float:
        if (a, b) not in known:
            known[a, b] = similarity(a, b, _words)
        return known[a, b]

    left = [a for a in aliases if a["key"] != representative]
    far = {id(a): 1.0 - like(a["key"], representative) for a in left} if limit > 0 else {}
    total = {id(a): 0.0 for a in left}
    chosen: list[dict] = []
    while left and len(chosen) < limit:
        best = max(left, key=lambda a: (-a["priority"], -a["penalty0"], -a["penalty1"], -a["penalty2"], far[id(a)], -total[id(a)], -a["size"], a["folded"]))
        chosen.append(best)
        left = [a for a in left if a is not best]
        for a in left:
            s = like(a["key"], best["key"])
            far[id(a)] = min(far[id(a)], 1.0 - s)
            total[id(a)] += s
    return chosen


def _profile(limits: dict[str, int], most: int, threshold: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_id", "key"], kind="stable")
        raw = int(pdf["n"].sum())
        noisy = int(pdf["n"][pdf["alias"] == ""].sum())
        rows = [r for r in pdf.to_dict("records") if r["alias"] and r["key"]]  # one row per key
        doubles = sum(r["n"] - 1 for r in rows)
        kept = [r for r in rows if r["size"] <= threshold]  # a long one hides its equals
        long = len(rows) - len(kept)
        if not kept:
            kept = sorted(rows, key=lambda r: (r["priority"], r["language"], r["size"], r["folded"]))[:1]
        if not kept:
            return pd.DataFrame(columns=[c.split()[0] for c in SCHEMA.split(", ")])
        top = min((r["priority"], r["language"]) for r in kept)
        lead = min((r for r in kept if (r["priority"], r["language"]) == top), key=lambda r: tuple(r["order"].values()) if isinstance(r["order"], dict) else tuple(r["order"]))
        others = [r for r in kept if r["key"] != lead["key"]]
        known: dict = {}
        groups: dict[str, list[dict]] = {}
        ordered: list[dict] = []
        room = max(0, most)
        for kind in KINDS:
            groups[kind] = varied([r for r in others if r["kind"] == kind], min(limits.get(kind, 0), room), lead["key"], known)
            ordered += groups[kind]
            room -= len(groups[kind])
        covered = {lead["language"], *(r["language"] for r in ordered)}
        for language in dict.fromkeys(r["language"] for r in kept):
            if room <= 0:
                break
            if language in covered or language == "UNK":
                continue
            taken = {r["key"] for r in ordered}
            found = varied([r for r in others if r["language"] == language and r["key"] not in taken], 1, lead["key"], known)
            for r in found:
                ordered.append(r)
                groups[r["kind"]].append(r)
                room -= 1
                covered.add(language)
        taken = {r["key"] for r in ordered}
        rest = [r for kind in ("short_names", "multi_word", "long_variants", "abbreviations") for r in others if r["kind"] == kind and r["key"] not in taken]
        shown = [lead["normalized"], *(r["normalized"] for kind in KINDS for r in groups[kind])]
        ordered += varied(rest, room, lead["key"], known)  # listed, but not part of the text
        return pd.DataFrame(
            [
                {
                    "CUI": lead["CUI"],
                    "semantic_type": lead["semantic_type"],
                    "candidate_text": "; ".join(s for s in shown if s),
                    "representative_name": lead["alias"],
                    "representative_name_normalized": lead["normalized"],
                    "selected_aliases": [r["alias"] for r in ordered],
                    "selected_aliases_normalized": [r["normalized"] for r in ordered],
                    "selected_alias_count": len(ordered),
                    "num_aliases_raw": raw,
                    "num_aliases_kept": len(kept),
                    "num_duplicates_removed": doubles,
                    "num_long_removed": long,
                    "num_noisy_removed": noisy,
                    "languages": sorted({r["language"] for r in kept}),
                    "alias_length_threshold": threshold,
                }
            ]
        )

    return run


def concept_profiles(vocab: DataFrame, preferred: list[str], allowed: list[str] | None = None, most: int = 8, limits: dict[str, int] | None = None, compose: bool = True) -> DataFrame:
    """One profile per (CUI, semantic_type); the aliases of one concept meet in one task.

    Cleaning and all features are columns; only the sequential choice runs in the grouped function.
    Equal keys of a concept become one row (that of the least item_id) and a count before that, with
    partial sums; the distinct keys of one concept have to fit in a task.
    """
    threshold = int(alias_length_threshold(vocab).first()["threshold"])
    records = alias_records(vocab, preferred, allowed, compose)
    by = ["CUI", "semantic_type", "key"]
    row = F.struct(*[c for c in records.columns if c not in by])
    order = F.struct(F.col("item_id").isNull(), "item_id", "alias", "language")
    records = records.groupBy(*by, (F.col("alias") == "").alias("_none")).agg(F.min_by(row, order).alias("r"), F.count("*").alias("n")).select(*by, "n", "r.*")
    return records.groupBy("CUI", "semantic_type").applyInPandas(_profile(GROUP_LIMITS if limits is None else limits, most, threshold), SCHEMA)


def candidate_texts(profiles: DataFrame) -> DataFrame:
    """(CUI, semantic_type, candidate_text), one row per concept and type."""
    return profiles.groupBy("CUI", "semantic_type").agg(F.max("candidate_text").alias("candidate_text"))


__all__ = ["alias_length_threshold", "alias_records", "candidate_texts", "concept_profiles", "representatives", "varied"]


def profile_languages(dataset: str) -> tuple[list[str], list[str]]:
    """The languages a dataset's profiles prefer, in order, and those they are limited to (none: no limit)."""
    return (["ENG", "RUS"], ["ENG"]) if dataset == "en" else (["RUS", "ENG"], [])
