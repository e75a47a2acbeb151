"""Mention context: enclosing mentions, word windows, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.text import is_symbolic, text_window

#: Width of the position buckets of the containment join.
BUCKET = 256


def enclosing_mentions(mentions: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(document_id, spans, left_text, right_text): for each mention the longest that encloses it and reaches further left, and right.

    Mentions are (document_id, spans, start, stop, text).  Both mentions lie in one document, have
    different spans, and the enclosing one starts no later and ends no earlier.  Of equally long
    ones the first start, then the last end, then the first text counts.  Where both sides name the
    same mention or text only the right one stays.  The join is on document and position bucket, so
    a document of many mentions is compared within neighbourhoods only.
    """
    own = mentions.select("document_id", "spans", "start", "stop").distinct()
    wide = mentions.select("document_id", F.col("spans").alias("o_spans"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop"), F.col("text").alias("o_text")).distinct()
    at = own.withColumn("_b", F.expr(f"start div {bucket}"))
    over = wide.withColumn("_b", F.explode(F.sequence(F.expr(f"o_start div {bucket}"), F.expr(f"greatest(o_start, o_stop) div {bucket}"))))
    pairs = at.join(over, ["document_id", "_b"]).where("o_spans <> spans and o_start <= start and o_stop >= stop")
    order = F.struct((F.col("o_start") - F.col("o_stop")).alias("w"), "o_start", (-F.col("o_stop")).alias("e"), "o_text", "o_spans")
    best = pairs.groupBy("document_id", "spans").agg(F.min(F.when(F.col("o_start") < F.col("start"), order)).alias("l"), F.min(F.when(F.col("o_stop") > F.col("stop"), order)).alias("r"))
    same = (F.col("l.o_spans") == F.col("r.o_spans")) | (F.col("l.o_text") == F.col("r.o_text"))
    left = F.when(F.coalesce(same, F.lit(False)), F.lit(None)).otherwise(F.col("l.o_text"))
    return own.select("document_id", "spans").distinct().join(best, ["document_id", "spans"], "left").select("document_id", "spans", left.alias("left_text"), F.col("r.o_text").alias("right_text"))


def format_mention(mention: Column, left: Column, right: Column, style: str = "explicit_markers", sep: str = "[SEP]") -> Column:
    """The mention with its context; context columns that are null or empty are left out."""
    left, right = (F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in (left, right))
    if style == "sep_token":
        return F.concat_ws(f" {sep} ", left, mention, right)
    if style == "explicit_markers":
        return F.concat_ws(" | ", mention, F.concat(F.lit("left: "), left), F.concat(F.lit("right: "), right))
    raise ValueError(f"unknown style: {style}")


def contextualize(mentions: DataFrame, documents: DataFrame | None, mode: str, left: int = 4, right: int = 4, style: str = "explicit_markers") -> DataFrame:
    """mentions with left_context_text, right_context_text, context_source, contextualized_mention_text.

    Mentions are (document_id, spans, start, stop, text, entity_type), documents (document_id,
    document_text).  Modes: nested_entities, text_window, and hybrid (nested, else a window for
    symbolic mentions, else nothing).  No mention is dropped.
    """
    if mode not in ("nested_entities", "text_window", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    out = mentions
    none = F.lit(None).cast("string")
    if mode != "text_window":
        nested = enclosing_mentions(mentions).withColumnsRenamed({"left_text": "_nl", "right_text": "_nr"})
        out = out.join(nested, ["document_id", "spans"], "left")
    else:
        out = out.withColumn("_nl", none).withColumn("_nr", none)
    nested_found = F.col("_nl").isNotNull() | F.col("_nr").isNotNull()
    if mode != "nested_entities":
        out = out.join(documents.select("document_id", "document_text"), "document_id", "left")
        window = text_window(F.coalesce("document_text", F.lit("")), F.col("start"), F.col("stop"), left, right)
        asked = F.lit(True) if mode == "text_window" else is_symbolic(F.col("text"), F.col("entity_type"))
        out = out.withColumn("_w", F.when(~nested_found & asked, window)).drop("document_text")
    else:
        out = out.withColumn("_w", F.lit(None).cast("struct<left:string,right:string>"))
    source = F.when(nested_found, "nested").when(F.col("_w").isNotNull(), "window").otherwise("none")
    out = out.withColumn("context_source", source)
    out = out.withColumn("left_context_text", F.coalesce(F.when(nested_found, F.col("_nl")).otherwise(F.col("_w.left")), F.lit("")))
    out = out.withColumn("right_context_text", F.coalesce(F.when(nested_found, F.col("_nr")).otherwise(F.col("_w.right")), F.lit("")))
    return out.withColumn("contextualized_mention_text", format_mention(F.col("text"), F.col("left_context_text"), F.col("right_context_text"), style)).drop("_nl", "_nr", "_w")


def context_coverage(contextualized: DataFrame) -> DataFrame:
    """One row: rows, with context, with left, with right, with both."""
    left, right = F.col("left_context_text") != "", F.col("right_context_text") != ""
    return contextualized.agg(F.count("*").alias("n_rows"), F.count_if(left | right).alias("n_context"), F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"), F.count_if(left & right).alias("n_both"))
