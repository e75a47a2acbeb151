"""Sparse retrieval as postings tables: BM25 over words and TF-IDF over character n-grams."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions.text import char_ngrams, word_tokens
from termweave.operators.ranking import top_k
from termweave.operators.sparse_blocks import Weighting, block_scores, count_grams, count_words, gram_text, term_counts, word_text

#: Characters of a block of texts.
WORD_CHARS, GRAM_CHARS = 8 << 20, 2 << 20


@dataclass
class Bm25Index:
    """items (item_id, text), postings (term, item_id, tf), lengths (item_id, len), stats (one row: n, avgdl), df (term, df, idf)."""

    items: DataFrame
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    df: DataFrame
    k1: float = 1.2
    b: float = 0.25

    def weighting(self) -> Weighting:
        return Weighting(count_words, WORD_CHARS, (self.k1, self.b))


def bm25_index(items: DataFrame, k1: float = 1.2, b: float = 0.25) -> Bm25Index:
    """Index of (item_id, text); items without words count in the statistics."""
    tokens = items.select("item_id", word_tokens("text").alias("w"))
    lengths = tokens.select("item_id", F.size("w").alias("len"))
    stats = lengths.agg(F.count("*").alias("n"), F.greatest(F.avg("len"), F.lit(1e-12)).alias("avgdl"))
    postings = tokens.select("item_id", F.explode("w").alias("term")).groupBy("term", "item_id").agg(F.count("*").alias("tf"))
    df = term_counts(_texts(items, "item_id", word_text("text")), Weighting(count_words, WORD_CHARS, (k1, b))).join(F.broadcast(stats), how="cross")
    df = df.select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return Bm25Index(items, postings, lengths, stats, df, k1, b)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(word_tokens("text"))).alias("term")).distinct()


def bm25_scores(index: Bm25Index, queries: DataFrame) -> DataFrame:
    """(query_id, item_id, score) of all pairs that share a word; a query's words count once.

    That is nearly every pair where texts share common words: for a query's best items see
    :func:`bm25_top_k`, for listed pairs :func:`bm25_pair_scores`.
    """
    terms = _asked(queries)
    wanted = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    weighted = wanted.join(index.df, "term").join(index.lengths, "item_id").join(F.broadcast(index.stats), how="cross")
    norm = F.lit(index.k1) * (1 - index.b + index.b * F.col("len") / F.col("avgdl"))
    weighted = weighted.select("term", "item_id", (F.col("idf") * F.col("tf") * (index.k1 + 1) / (F.col("tf") + norm)).alias("w"))
    return terms.join(weighted, "term").groupBy("query_id", "item_id").agg(F.round(F.sum("w"), 6).alias("score"))


def with_zero_scores(scores: DataFrame, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Fills queries of fewer than k scored items with the items of least id at score 0.

    The first k ids that a query lacks lie among the first k plus its own count, so a query is
    paired with 2 k items at most.
    """
    lack = queries.select("query_id").join(scores.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").where(F.coalesce("have", F.lit(0)) < k)
    first = items.select("item_id").orderBy("item_id").limit(2 * k)
    fill = lack.select("query_id").join(F.broadcast(first), how="cross").join(scores, ["query_id", "item_id"], "left_anti")
    return scores.unionByName(fill.withColumn("score", F.lit(0.0)))


def _texts(df: DataFrame, id_: str, text: Column) -> DataFrame:
    return df.select(F.col(id_).alias("id"), text.alias("text"), F.length("text").alias("chars"))


def ranked_or_zero(found: DataFrame, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score, other, rank): the k best, as if filled by :func:`with_zero_scores`, and all listed pairs, whose rank may be greater.

    ``found`` (see :func:`block_scores`) is read once and holds at least the k best of each query;
    scores are not negative.
    """
    n = max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    first = items.select("item_id").orderBy("item_id").limit(2 * k)
    fill = queries.select("query_id").distinct().join(F.broadcast(first), how="cross").select("query_id", "item_id", F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("other"), F.lit(0).alias("kind"))
    both = found.select("query_id", "item_id", "score", "other", F.when(F.col("listed"), -1).otherwise(1).alias("kind")).unionByName(fill)
    both = both.repartition(n, "query_id").groupBy("query_id", "item_id").agg(F.max("score").alias("score"), F.max("other").alias("other"), F.max("kind").alias("kind"))
    both = both.withColumn("have", F.count_if(F.col("kind") == 1).over(Window.partitionBy("query_id")))
    may = (F.col("kind") == 1) | ((F.col("kind") == 0) & (F.col("have") < k))
    w = Window.partitionBy("query_id").orderBy(F.desc("may"), F.desc("score"), "item_id")
    both = both.withColumn("may", may).withColumn("rank", F.row_number().over(w))
    rank = F.when(F.col("may"), F.col("rank")).otherwise(1 << 30)
    return both.select("query_id", "item_id", "score", "other", rank.alias("rank")).where((F.col("rank") <= k) | F.col("other").isNotNull())


def _texts(df: DataFrame, id_: str, text: Column) -> DataFrame:
    return df.select(F.col(id_).alias("id"), text.alias("text"), F.length("text").alias("chars"))


def bm25_blocks(index: Bm25Index, queries: DataFrame, k: int, listed: DataFrame | None = None, chars: int = WORD_CHARS) -> DataFrame:
    """:func:`block_scores` of the index's items: each query's k best of each block, and the listed pairs."""
    asked = F.array_join(F.array_distinct(word_tokens("text")), " ")
    return block_scores(_texts(index.items, "item_id", word_text("text")), _texts(queries, "query_id", asked), replace(index.weighting(), chars=chars), k, listed)


def bm25_top_k(index: Bm25Index, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    return ranked_or_zero(bm25_blocks(index, queries, k), queries, items, k).drop("other")


def bm25_pair_scores(index: Bm25Index, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, item_id, score) of those listed pairs that share a word.  Only the listed items' texts are taken apart."""
    terms = _asked(queries).join(pairs.select("query_id", "item_id").distinct(), "query_id")
    texts = index.items.join(pairs.select("item_id").distinct(), "item_id", "left_semi").select("item_id", word_tokens("text").alias("w"))
    lengths = texts.select("item_id", F.size("w").alias("len"))
    postings = texts.select("item_id", F.explode("w").alias("term")).groupBy("term", "item_id").agg(F.count("*").alias("tf"))
    found = terms.join(postings, ["term", "item_id"]).join(index.df, "term").join(lengths, "item_id").join(F.broadcast(index.stats), how="cross")
    norm = F.lit(index.k1) * (1 - index.b + index.b * F.col("len") / F.col("avgdl"))
    weight = F.col("idf") * F.col("tf") * (index.k1 + 1) / (F.col("tf") + norm)
    return found.groupBy("query_id", "item_id").agg(F.round(F.sum(weight), 6).alias("score"))


def score_pairs(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores of listed pairs, 0 where nothing is shared."""
    return pairs.join(scores, ["query_id", "item_id"], "left").select("query_id", "item_id", F.coalesce("score", F.lit(0.0)).alias("score"))


@dataclass
class TfidfIndex:
    """items (item_id, text), weights (gram, item_id, w) of unit norm and idf (gram, df, idf)."""

    items: DataFrame
    weights: DataFrame
    idf: DataFrame
    least: int
    most: int

    def weighting(self) -> Weighting:
        return Weighting(count_grams(self.least, self.most), GRAM_CHARS, None)


def tfidf_index(items: DataFrame, least: int = 3, most: int = 5) -> TfidfIndex:
    """Index of (item_id, text): raw counts, idf = ln((1 + n) / (1 + df)) + 1, rows of norm 1, case kept."""
    stats = items.agg(F.count("*").alias("n"))
    counts = items.select("item_id", F.explode(char_ngrams("text", least, most)).alias("gram")).groupBy("gram", "item_id").agg(F.count("*").alias("tf"))
    found = term_counts(_texts(items, "item_id", gram_text("text")), Weighting(count_grams(least, most), GRAM_CHARS, None))
    idf = found.withColumnRenamed("term", "gram").join(F.broadcast(stats), how="cross")
    idf = idf.select("gram", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return TfidfIndex(items, _unit_weights(counts, idf, "item_id"), idf, least, most)


def _unit_weights(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    raw = counts.join(idf, "gram").select("gram", key, (F.col("tf") * F.col("idf")).alias("r"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    return raw.join(norms, key).select("gram", key, (F.col("r") / F.col("norm")).alias("w"))


def tfidf_scores(index: TfidfIndex, queries: DataFrame) -> DataFrame:
    """(query_id, item_id, score) of all pairs that share an n-gram; n-grams the index lacks are ignored."""
    counts = queries.select("query_id", F.explode(char_ngrams("text", index.least, index.most)).alias("gram")).groupBy("gram", "query_id").agg(F.count("*").alias("tf"))
    mine = _unit_weights(counts, index.idf, "query_id").withColumnRenamed("w", "wq")
    return mine.join(index.weights, "gram").groupBy("query_id", "item_id").agg(F.round(F.sum(F.col("wq") * F.col("w")), 6).alias("score"))


def tfidf_top_k(index: TfidfIndex, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    found = block_scores(_texts(index.items, "item_id", gram_text("text")), _texts(queries, "query_id", gram_text("text")), index.weighting(), k)
    return ranked_or_zero(found, queries, items, k).drop("other")


SPARSE = {"bm25": (bm25_index, bm25_scores, bm25_top_k), "char_tfidf": (tfidf_index, tfidf_scores, tfidf_top_k)}


def build_sparse_index(name: str, items: DataFrame, **params):
    if name not in SPARSE:
        raise ValueError(f"unknown sparse index: {name}")
    return SPARSE[name][0](items, **params)
