"""Alias rules: cleaning, kinds, quality, representative order, similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from termweave.functions.text import caseless, collapse_ends, collapse_spaces

# The marks of noisy dictionary entries, as patterns.
NOISE = ("&#x7c;", "@@")
PIPE_DOMAINS = ("radiology", "microbiology", "allergy", "serum", "urine", "plasma", "blood")
SUFFIXES = r"(?iU)(?:\s*\((?:body structure|finding|physical finding|substance|medication|disorder)\)\s*|\s*-\s*chemical\s*\(substance\)\s*)+$"
SOFT_SUFFIX = r"(?iU)\s*\((?:product|qualifier value)\)\s*$"
PARENTHESES = r"(?iU)\s*\((?:specimen|product|medicinal product|cell structure|body structure)\)\s*$"
LEADS = (r"(?iU)^\s*structure of\s+", r"(?iU)^\s*entire\s+", r"(?iU)^\s*set of\s+", r"(?iU)^\s*part of\s+")
TAILS = (r"(?iU)\s+structure\s*$", r"(?iU)\s+structures\s*$")
REJECTED = r"(?iU)\b(?:nos|nec|unspecified|not elsewhere classified|to be specified in another part of the message|xxx|specimen from|sample from|swab from|product containing|product$|containing product|medicinal product|dose form|only product|product in .+ dose form)\b"
VOWELS = "aeiouyаеёиоуыэюя"
KINDS = ("abbreviations", "short_names", "multi_word", "long_variants")
GROUP_LIMITS = {"abbreviations": 2, "short_names": 2, "multi_word": 3, "long_variants": 1}


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it: long rules stay linear in size."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def sanitize_alias(c: Column) -> Column:
    """The cleaned alias, or the empty text where it is to be rejected."""

    def noisy(text: Column) -> Column:
        low = F.lower(text)
        return low.contains(NOISE[0]) | low.contains(NOISE[1]) | (low.contains("|") & low.rlike("|".join(PIPE_DOMAINS)))

    def stripped(text: Column) -> Column:
        out = collapse_spaces(F.regexp_replace(text, SUFFIXES, ""))
        for pattern in (PARENTHESES, *LEADS):
            out = collapse_ends(F.regexp_replace(out, pattern, ""))
        return out

    def without_tail(pattern: str):
        return lambda t: F.when(t.rlike(r"(?U)\S\s+\S"), collapse_ends(F.regexp_replace(t, pattern, ""))).otherwise(t)

    def punctuated(text: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(text, r"(?U)\s*,\s*", ", "), r"(?U)\s*-\s*", "-")
        return F.regexp_replace(F.regexp_replace(out, r"\.{2,}", "."), r"^[ ,;:]+|[ ,;:]+$", "")

    def judged(out: Column) -> Column:
        low = F.lower(out)
        coded = out.rlike(r"(?U)\b[a-z0-9_]+\.[a-z0-9_.]+\b") & ~low.contains(" mg/") & ~low.contains(" ml/")
        bare = (F.length(out) <= 3) & ~has_cyrillic(out) & ~out.rlike("[A-Za-z]{2,}")
        return F.when(low.rlike(REJECTED) | coded | bare, "").otherwise(collapse_ends(out))

    def cleaned(text: Column) -> Column:
        out = stripped(text)
        for pattern in TAILS:
            out = bound(out, without_tail(pattern))
        return bound(punctuated(out), judged)

    return bound(collapse_ends(F.coalesce(c, F.lit(""))), lambda t: F.when(noisy(t), "").otherwise(cleaned(t)))


def has_cyrillic(c: Column) -> Column:
    return c.rlike("[А-Яа-яЁё]")


def has_mixed_scripts(c: Column) -> Column:
    return has_cyrillic(c) & c.rlike("[A-Za-z]")


def is_all_caps(c: Column) -> Column:
    """Three letters or more, all capitals."""
    letters = F.regexp_replace(c, r"\P{L}", "")
    return (F.length(letters) >= 3) & ~letters.rlike(r"[^\p{Lu}]")


def is_abbreviation(c: Column) -> Column:
    """Short aliases that behave like abbreviations; any single token of six characters or fewer is one."""

    def parts(text: Column) -> Column:
        compact = F.regexp_replace(text, r"(?U)[\s./_-]+", "")
        tokens = F.filter(F.split(text, r"(?U)[\s/,_-]+"), lambda t: t != "")
        return F.struct(compact.alias("compact"), tokens.alias("tokens"), F.regexp_replace(compact, r"\P{L}", "").alias("letters"))

    def judged(p: Column) -> Column:
        size, n, letters = F.length(p["compact"]), F.size(p["tokens"]), F.length(p["letters"])
        vowels = letters - F.length(F.regexp_replace(F.lower(p["letters"]), f"[{VOWELS}]", ""))
        widest = F.array_max(F.transform(p["tokens"], lambda t: F.length(t)))
        few = vowels <= F.greatest(F.lit(1), F.floor(letters / 5))
        one = (n == 1) & (size <= 6)
        digits = (n <= 2) & (size <= 8) & p["compact"].rlike(r"(?U)\d")
        return (size > 0) & (n > 0) & (one | digits | ((n <= 2) & (size <= 10) & (letters > 0) & ((widest <= 5) | few)))

    return bound(bound(collapse_ends(F.coalesce(c, F.lit(""))), parts), judged)


def alias_kind(c: Column) -> Column:
    text = collapse_ends(F.coalesce(c, F.lit("")))
    tokens = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""))
    size = F.length(text)
    return (
        F.when(is_abbreviation(text), KINDS[0])
        .when((tokens <= 2) & (size <= 24), KINDS[1])
        .when((tokens <= 5) & (size <= 80), KINDS[2])
        .otherwise(KINDS[3])
    )


def is_fragment(c: Column) -> Column:
    """A list with semicolons of which two parts or more have at most two words."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,:/]+"), collapse_ends), lambda p: p != "")
    short = F.filter(parts, lambda p: F.size(F.split(p, r"(?U)\s+")) <= 2)
    return c.contains(";") & (F.size(parts) >= 2) & (F.size(short) >= 2)


def is_too_short_abbreviation(c: Column) -> Column:
    compact = F.regexp_replace(c, r"(?U)[\s./_-]+", "")
    return is_abbreviation(c) & (F.length(F.regexp_replace(compact, r"\P{L}", "")) <= 3) & (F.length(compact) <= 5)


def quality_penalty(c: Column) -> list[Column]:
    return [x.cast("int") for x in (c.rlike(SOFT_SUFFIX), is_fragment(c), is_too_short_abbreviation(c))]


def representative_order(c: Column) -> Column:
    """Struct that orders aliases from the best representative."""
    flags = [~has_cyrillic(c), has_mixed_scripts(c)]
    return F.struct(*[f.cast("int") for f in flags], *quality_penalty(c), is_all_caps(c).cast("int"), is_abbreviation(c).cast("int"), F.length(c), caseless(c), c)


def similarity(left: str, right: str, words) -> float:
    """Mean of the Jaccard index of words and the matching-blocks ratio of two normalized aliases."""
    if not left or not right:
        return 0.0
    if left == right:
        return 1.0
    a, b = words(left), words(right)
    return 0.5 * len(a & b) / max(1, len(a | b)) + 0.5 * SequenceMatcher(None, left, right).ratio()


@pandas_udf(DoubleType())
def alias_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of alias keys; not symmetric in rare cases, as the ratio isn't."""
    import re

    def words(t: str) -> set[str]:
        return set(re.findall(r"\w+", t))

    return pd.Series([similarity(a or "", b or "", words) for a, b in zip(left, right)], dtype="float64")
