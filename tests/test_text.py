"""Text functions and alias rules against small hand-written cases."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from termweave.functions import aliases as A
from termweave.functions import text as T


def values(spark, inputs, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def plain(text):
    out = unicodedata.normalize("NFKC", text or "")
    out = out.translate({ord(c): "'" for c in T.SINGLE_QUOTES} | {ord(c): '"' for c in T.DOUBLE_QUOTES}).lower()
    out = re.sub(r"\s+", " ", out).strip()
    out = re.sub(r"(,\s*){2,}", ", ", re.sub(r"\s*,\s*", ", ", out))
    return re.sub(r"\s+", " ", re.sub(r"[.,\s]+$", "", out)).strip()


def test_normalize_text(spark):
    inputs = ["  Heart   Attack ,,acute. ", "«Foo» ‘bar’", "Ⅳ ﬁne", "a b\tc", "", None, "x , , y,.", "´ ″", "Straße", "1,5 mg/ml..."]
    assert values(spark, inputs, T.normalize_text) == [plain(x) for x in inputs]


def test_alias_key_folds_case(spark):
    assert values(spark, ["Straße", "STRASSE", "Σίσυφος", "İ"], T.alias_key) == ["strasse", "strasse", "σίσυφοσ", "i̇"]


def test_tokens_keep_case_and_scripts(spark):
    assert values(spark, ["Гемо-глобин A1c_x", "", None], T.word_tokens) == [["Гемо", "глобин", "A1c_x"], [], []]


def test_char_ngrams(spark):
    got = values(spark, ["ab  cd", "a", "", None, "abc"], lambda c: T.char_ngrams(c, 2, 3))
    assert got[0] == ["ab", "b ", " c", "cd", "ab ", "b c", " cd"]
    assert got[1:4] == [[], [], []]
    assert got[4] == ["ab", "bc", "abc"]


def test_languages(spark):
    assert values(spark, [" en ", "RU", "deu", "", None], lambda c: T.language_code(c, "UNK")) == ["ENG", "RUS", "DEU", "UNK", "UNK"]
    assert values(spark, ["RUS", "ENG", "DEU", None], lambda c: T.language_priority(c, ["ENG", "RUS"])) == [1, 0, 2, 2]


def test_spans_and_windows(spark):
    got = values(spark, ["3-7", "10-15,2-4"], T.span_bounds)
    assert [(g["start"], g["stop"]) for g in got] == [(3, 7), (2, 15)]
    text = 'one two (three "four) five six'
    df = spark.createDataFrame([(text,)], "t string")
    start = text.index("three")
    w = df.select(T.text_window(F.col("t"), F.lit(start), F.lit(start + 5), 2, 2).alias("w")).first()["w"]
    assert (w["left"], w["right"]) == ("two", "four) five")  # the bracket was a word of its own
    w = df.select(T.text_window(F.col("t"), F.lit(0), F.lit(3), 0, 1).alias("w")).first()["w"]
    assert (w["left"], w["right"]) == ("", "two")


def test_unit_hash_is_stable(spark):
    import hashlib

    got = values(spark, ["a", "b|c"], T.unit_hash)
    assert got == [int(hashlib.sha256(x.encode()).hexdigest()[:16], 16) / 2**64 for x in ("a", "b|c")]


def test_symbolic_mentions(spark):
    df = spark.createDataFrame([("IL-6", "GENE", True), ("β2", "CHEM", True), ("heart attack", "DISO", False), ("", None, False), ("сердце", "ANAT", False), ("АД", "X", True)], "m string, k string, want boolean")
    rows = df.select(T.is_symbolic(F.col("m"), F.col("k")).alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("Asthma (disorder)", "Asthma"),
        ("Heart (body structure) (disorder)", "Heart"),
        ("Entire heart", "heart"),
        ("Lung structure", "Lung"),
        ("structure", "structure"),
        ("Pain, NOS", ""),
        ("serum | sodium", ""),
        ("a&#x7c;b", ""),
        ("Aspirin product", ""),
        ("code a1.b2", ""),
        ("x1", ""),
        ("ЭКГ", "ЭКГ"),
        ("one  ,two -three..", "one, two-three."),
        ("", ""),
        (None, ""),
    ],
)
def test_alias_cleaning(spark, raw, clean):
    assert values(spark, [raw], A.sanitize_alias) == [clean]


def test_alias_kinds(spark):
    assert values(spark, ["ECG", "heart", "myocardial infarction", "acute myocardial infarction", "x" * 90], A.alias_kind) == ["abbreviations", "abbreviations", "short_names", "multi_word", "long_variants"]


def test_similarity_matches_difflib(spark):
    df = spark.createDataFrame([("heart attack", "heart failure"), ("a", "a"), ("", "a")], "l string, r string")
    got = [r[0] for r in df.select(A.alias_similarity("l", "r")).collect()]
    from difflib import SequenceMatcher

    assert got == [0.5 * (1 / 3) + 0.5 * SequenceMatcher(None, "heart attack", "heart failure").ratio(), 1.0, 0.0]


def test_window_of_a_long_text(spark):
    """Only the words next to the span are taken apart; odd blanks, long words and both ends come out as before."""
    from termweave.functions.text import text_window

    texts = ["a  b\tc d\u00a0e SPAN f  g h\u2003i j ", "SPAN", " one SPAN ", "x" * 3000 + " SPAN " + "y" * 3000, "  SPAN  ", "\U0001d11e1 2 3 4 5 \U0001d11e SPAN \U0001d11e 7"]
    rows = [(t, t.index("SPAN"), t.index("SPAN") + 4) for t in texts]
    df = spark.createDataFrame(rows, "text string, start int, stop int")
    for n in (0, 1, 2, 4):
        got = [tuple(r[0]) for r in df.select(text_window(F.col("text"), F.col("start"), F.col("stop"), n, n)).collect()]
        assert got == [(" ".join(t[:a].split()[-n:] if n else []), " ".join(t[b:].split()[:n])) for t, a, b in rows]
    plan = df.select(text_window(F.col("text"), F.col("start"), F.col("stop"), 4, 4).alias("w"))._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract_all(substring(" not in plan  # not the words of all that is before and after
