"""Text normalization, tokens, language codes, hashing and spans as Column expressions.

Unicode classes are spelled for Java (``(?U)``); nulls count as empty text unless a docstring says
otherwise.  The only steps no built-in offers, NFKC and casefold, are Arrow UDFs.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Quotation marks and what they become.
SINGLE_QUOTES = "‘’‚‛′´`"
DOUBLE_QUOTES = "“”„‟″«»"
SPACES = r"(?U)\s+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def caseless(c: Column | str) -> Column:
    """Casefold by built-ins: by way of upper case, so that letters that only upper case tells equal (sharp s and ss) are equal."""
    return F.lower(F.upper(_col(c)))


def plain_quotes(c: Column | str) -> Column:
    return F.translate(_col(c), SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))


def collapse_spaces(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(_col(c), SPACES, " "), "^ +| +$", "")


def normalize_text(c: Column | str, compose: bool = True) -> Column:
    """NFKC (unless ``compose`` is off: texts known to be composed), quotes, lower case, spaces, commas, no trailing dots or commas."""
    out = F.coalesce(_col(c), F.lit(""))
    out = collapse_spaces(F.lower(plain_quotes(nfkc(out) if compose else out)))
    out = F.regexp_replace(out, r"(?U)\s*,\s*", ", ")
    out = F.regexp_replace(out, r"(?U)(,\s*){2,}", ", ")
    return collapse_spaces(F.regexp_replace(out, r"(?U)[.,\s]+$", ""))


def alias_key(c: Column | str, compose: bool = True) -> Column:
    """The form by which aliases are told apart; without ``compose`` :func:`caseless` stands for NFKC and casefold."""
    out = F.coalesce(_col(c), F.lit(""))
    out = collapse_spaces(plain_quotes(nfkc_casefold(out) if compose else caseless(out)))
    return F.regexp_replace(out, r"(?U)[.,;:\s]+$", "")


def word_tokens(c: Column | str) -> Column:
    """Words (Unicode, case kept)."""
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"(?U)\w+"), F.lit(0))


def char_ngrams(c: Column | str, least: int, most: int) -> Column:
    """All character n-grams with least <= n <= most after runs of white space become one space."""
    spaced = F.regexp_replace(F.coalesce(_col(c), F.lit("")), SPACES, " ")

    def of(text: Column, n: int) -> Column:
        size = F.length(text)
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1)), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(size >= n, cut).otherwise(F.array().cast("array<string>"))

    # Bound to a lambda's variable the text is made once, not once for each n-gram.
    return F.element_at(F.transform(F.array(spaced), lambda t: F.concat(*[of(t, n) for n in range(least, most + 1)])), 1)


def language_code(c: Column | str, blank: str | None = None) -> Column:
    """Trimmed upper-case code; EN is ENG, RU is RUS; an empty one is ``blank``."""
    code = F.upper(F.trim(_col(c)))
    code = F.when(code == "EN", "ENG").when(code == "RU", "RUS").otherwise(code)
    return code if blank is None else F.coalesce(F.nullif(code, F.lit("")), F.lit(blank))


def language_priority(code: Column, preferred: list[str]) -> Column:
    """Place in the preferred list, or its length."""
    if not preferred:
        return F.lit(0)
    at = F.array_position(F.array(*map(F.lit, preferred)), F.coalesce(code, F.lit("")))
    return F.when(at > 0, at - 1).otherwise(len(preferred)).cast("int")


def unit_hash(c: Column) -> Column:
    """The first 64 bits of sha256 as a number in [0, 1]."""
    digest = F.sha2(c, 256)
    high, low = (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") for at in (1, 9))
    return (high * 4294967296.0 + low) / 18446744073709551615.0


def span_bounds(c: Column | str) -> Column:
    """Struct (start, stop) of ``"s-e[,s-e...]"``: the least start and the greatest end."""
    parts = F.transform(F.split(_col(c), ","), lambda p: F.split(F.trim(p), "-"))
    start = F.array_min(F.transform(parts, lambda p: F.get(p, F.lit(0)).cast("int")))
    stop = F.array_max(F.transform(parts, lambda p: F.get(p, F.lit(1)).cast("int")))
    return F.struct(start.alias("start"), stop.alias("stop"))


def text_window(text: Column, start: Column, stop: Column, left: int, right: int) -> Column:
    """Struct (left, right): the last and first words around [start, stop), without brackets and quotes next to it."""

    def words(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(r"(?U)\S+"), F.lit(0))

    def first(part: Column, n: int) -> Column:
        """The start of a text with its first words: the rest of a long text isn't taken apart."""
        return F.regexp_extract(part, rf"(?U)^\s*+((?:\S++\s++){{0,{max(0, n - 1)}}}\S++)", 1)

    before = words(F.reverse(first(F.reverse(F.substring(text, F.lit(1), start)), left)))
    after = words(first(F.substring(text, stop + 1, F.length(text)), right))
    n = F.size(before)
    lead = F.array_join(F.slice(before, F.greatest(F.lit(1), n - left + 1), F.lit(left)), " ") if left else F.lit("")
    tail = F.array_join(F.slice(after, 1, right), " ") if right else F.lit("")
    lead = F.regexp_replace(lead, r"""(?U)[(\[{«"']+\s*$""", "")
    tail = F.regexp_replace(tail, r"""(?U)^\s*[)\]}»"']+""", "")
    return F.struct(collapse_ends(lead).alias("left"), collapse_ends(tail).alias("right"))


def collapse_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_symbolic(mention: Column, kind: Column) -> Column:
    """Whether a mention is one short token of symbols, digits, Latin letters or capitals that needs its surroundings."""
    m = collapse_ends(F.coalesce(mention, F.lit("")))
    size = F.length(m)
    latin, digit, symbol, greek = m.rlike("[A-Za-z]"), m.rlike(r"(?U)\d"), m.rlike(r"[/\-+]"), m.rlike("[α-ωΑ-Ω]")
    upper, letters = F.regexp_replace(m, "[^A-ZА-ЯЁ]", ""), F.regexp_replace(m, "[^A-Za-zА-Яа-яЁё]", "")
    capital = F.length(upper) > 0
    plain = m.rlike(r"^[A-Za-zА-Яа-яЁё0-9/\-+α-ωΑ-Ω]+$")
    marked = latin | digit | symbol | greek
    short = size.between(2, 12) & plain & ((capital & (F.length(upper) >= F.greatest(F.lit(1), F.length(letters) - 1))) | marked)
    chem = (F.upper(F.trim(F.coalesce(kind, F.lit("")))) == "CHEM") & size.between(2, 10) & (greek | digit | symbol)
    return ~m.rlike(r"(?U)\s") & (size > 0) & (short | (size.between(2, 8) & marked) | (size.between(2, 4) & capital) | chem)


def query_key(*parts: str) -> Column:
    return F.concat_ws("|", *parts)
