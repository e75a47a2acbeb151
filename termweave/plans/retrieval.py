"""Queries on text functions, dense and sparse retrieval, fusion and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.text import normalize_text, word_tokens
from termweave.operators import fusion, metrics, sparse
from termweave.operators.dense import dense_top_k, pair_scores, unit_vector, with_dense_scores
from termweave.operators.ranking import first_per_key, merge_top_k, minmax, pad_to, retrieval_depth, top_k
from termweave.operators.sparse_blocks import gram_sizes, gram_text
from termweave.operators.training import lexical_score, rerank

WEIGHTS = [round(0.1 * i, 1) for i in range(11)]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select("vec_id", unit_vector(F.col("embedding")).alias("v"), "label")


def _dense(spark: SparkSession, sf_dir: str, k: int, skip_self: bool = True) -> DataFrame:
    v = _vectors(spark, sf_dir)
    queries = v.where("vec_id % 50 = 0").select(F.lit("all").alias("type"), F.col("vec_id").alias("query_id"), "v")
    return dense_top_k(queries, v.select(F.lit("all").alias("type"), F.col("vec_id").alias("item_id"), "v"), k, skip_self=skip_self)


def _by_label(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    labels = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("prediction"))
    ranked = _dense(spark, sf_dir, depth).drop("type").join(labels, "item_id")
    return first_per_key(ranked, 5, ["query_id"], "prediction").select("query_id", "rank", "prediction", "item_id", "score")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold"))


def dense_topk_dedup(spark, sf_dir):
    return _by_label(spark, sf_dir, retrieval_depth(5, 1 << 30, dedup=True))


def dense_metrics(spark, sf_dir):
    return metrics.ranking_metrics(dense_topk_dedup(spark, sf_dir), _gold(spark, sf_dir))


def predictions_padded(spark, sf_dir):
    return pad_to(_by_label(spark, sf_dir, 8).select("query_id", "rank", "prediction"), 5, ["query_id"])


def merged_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    queries = v.where("vec_id % 50 = 0").select(F.lit("all").alias("type"), F.col("vec_id").alias("query_id"), "v")
    items = v.select(F.lit("all").alias("type"), F.col("vec_id").alias("item_id"), "v", "label")
    parts = [dense_top_k(queries, items.where(c).drop("label"), 5).drop("type") for c in ("label < 5", "label >= 5")]
    return merge_top_k(*parts, 5, ["query_id"]).select("query_id", "rank", "item_id", "score")


def dense_pair_scores(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    pairs = v.select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("item_id"))
    return pair_scores(pairs, v.select(F.col("vec_id").alias("query_id"), "v"), v.select(F.col("vec_id").alias("item_id"), "v"))


def metrics_by_type(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("type"))
    v = _vectors(spark, sf_dir).join(docs, F.col("vec_id") == F.col("doc_id"))
    queries = v.where("vec_id % 50 = 0")
    ranked = dense_top_k(queries.select("type", F.col("vec_id").alias("query_id"), "v"), v.select("type", F.col("vec_id").alias("item_id"), "v"), 20, skip_self=True)
    ranked = ranked.join(v.select(F.col("vec_id").alias("item_id"), F.col("label").alias("prediction")), "item_id")
    return metrics.ranking_metrics(ranked, queries.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold"), "type"), by=["type"])


def pairwise_rank_metrics(spark, sf_dir):
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents"), "doc_id")
    rows = rows.select(F.col("source").alias("query_id"), F.col("quality").alias("label"), (F.col("n_chars") % 97).alias("score"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7).alias("retriever_score"), F.col("doc_id").alias("rank"))
    return metrics.pairwise_metrics(rows)


def normalized_documents(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", normalize_text("text").alias("normalized"))


def tokenize_counts(spark, sf_dir):
    t = _read(spark, sf_dir, "documents").select("doc_id", word_tokens("text").alias("w"))
    return t.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"))


def char_ngram_counts(spark, sf_dir):
    t = _read(spark, sf_dir, "conversations").select("conv_id", "turn", gram_text("text").alias("text"))
    return t.mapInArrow(gram_sizes(3, 5), "conv_id long, turn long, n_grams int, n_distinct int")


def _documents(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")


def _passages(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_stats(spark, sf_dir):
    return sparse.bm25_index(_documents(spark, sf_dir)).df.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf_dir):
    items, queries = _documents(spark, sf_dir), _passages(spark, sf_dir)
    return sparse.bm25_top_k(sparse.build_sparse_index("bm25", items), queries, items, 5).select("query_id", "rank", "item_id", "score")


def bm25_pair_scores(spark, sf_dir):
    queries = _passages(spark, sf_dir)
    pairs = queries.select("query_id", (F.col("query_id") * 3).alias("item_id"))
    return sparse.score_pairs(sparse.bm25_pair_scores(sparse.bm25_index(_documents(spark, sf_dir)), queries, pairs), pairs)


def _turns(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "text")


def tfidf_idf(spark, sf_dir):
    return sparse.tfidf_index(_turns(spark, sf_dir), 3, 5).idf.select("gram", "df", F.round("idf", 6).alias("idf"))


def tfidf_topk(spark, sf_dir):
    items = _turns(spark, sf_dir)
    index = sparse.build_sparse_index("char_tfidf", items, least=3, most=5)
    return sparse.tfidf_top_k(index, _passages(spark, sf_dir), items, 5).select("query_id", "rank", "item_id", "score")


def minmax_norm(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.round(minmax(F.col("value"), ["user_id"]), 6).alias("scaled"))


def _pool(spark, sf_dir):
    """Candidates of 50 dense and 50 sparse items per query, each with both scores."""
    both = _vectors(spark, sf_dir).join(_documents(spark, sf_dir), F.col("vec_id") == F.col("item_id"))
    items = both.select("item_id", "text", "v", F.lit("all").alias("type"))
    queries = items.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    dense = dense_top_k(queries.select("type", "query_id", "v"), items.select("type", "item_id", "v"), 50).select("query_id", "item_id", "score")
    index = sparse.bm25_index(items.select("item_id", "text"))
    asked = queries.select("query_id", "text")
    found = sparse.bm25_blocks(index, asked, 50, dense.withColumnRenamed("score", "other"), chars=2 * sparse.WORD_CHARS)
    pool = sparse.ranked_or_zero(found, asked, items, 50).select("query_id", "item_id", F.col("score").alias("s"), F.col("other").alias("d"))
    return fusion.scaled_pool(with_dense_scores(pool, queries, items))


def _label_keys(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("key"))


def hybrid_fuse(spark, sf_dir):
    return fusion.fuse(_pool(spark, sf_dir), [0.7], _label_keys(spark, sf_dir), 5).drop("weight")


def grid_search(spark, sf_dir):
    fused = fusion.fuse(_pool(spark, sf_dir), WEIGHTS, _label_keys(spark, sf_dir), 5).withColumn("prediction", F.col("key"))
    have = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"))
    gold = _gold(spark, sf_dir).join(have, "query_id").withColumn("weight", F.explode(F.array(*map(F.lit, WEIGHTS))))
    by = fused.select(F.concat_ws("|", F.col("weight").cast("string"), F.col("query_id").cast("string")).alias("query_id"), "rank", "prediction")
    gold = gold.select(F.concat_ws("|", F.col("weight").cast("string"), F.col("query_id").cast("string")).alias("query_id"), "gold", "weight")
    return metrics.ranking_metrics(by, gold, by=["weight"]).select("weight", "n_queries", "acc_1", "acc_5", "mrr")


def grid_best(spark, sf_dir):
    return fusion.best_of_grid(grid_search(spark, sf_dir), "acc_1", ["mrr", "acc_5"], ["weight"])


def rerank_with_scorer(spark, sf_dir):
    lists = bm25_topk(spark, sf_dir).join(_documents(spark, sf_dir), "item_id").join(_passages(spark, sf_dir).withColumnRenamed("text", "query"), "query_id")
    out = rerank(lists, lexical_score(F.col("query"), F.col("text")), 3, ["query_id"])
    return out.select("query_id", F.col("new_rank").alias("rank"), "item_id", "rerank_score")


QUERIES = [
    dense_topk_dedup, dense_metrics, predictions_padded, merged_topk, dense_pair_scores, metrics_by_type, pairwise_rank_metrics, normalized_documents, tokenize_counts,
    char_ngram_counts, bm25_stats, bm25_topk, bm25_pair_scores, tfidf_idf, tfidf_topk, minmax_norm, hybrid_fuse, grid_search, grid_best, rerank_with_scorer,
]

COSINE = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


def _dense_sql(depth: int) -> str:
    return f"""scored AS (
    SELECT a.vec_id AS query_id, b.vec_id AS item_id, b.label AS prediction, {COSINE} AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), listed AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM scored QUALIFY r <= {depth}
), firsts AS (
    SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY query_id, prediction ORDER BY r) = 1
), ranked AS (
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY r))::INTEGER AS rank, prediction, item_id, score FROM firsts QUALIFY rank <= 5
)"""


def _metrics_sql(ranked: str, gold: str, by: str = "") -> str:
    """Metrics over CTEs ranked (query_id, rank, prediction) and gold (query_id, gold[, by])."""
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    of = lambda k: f"round(CASE WHEN max(deep) >= {k} THEN avg(CASE WHEN pos <= {k} THEN 1.0 ELSE 0.0 END) END, 6) AS acc_{k}"
    return f"""hits AS (
    SELECT {lead}g.query_id, min(CASE WHEN r.prediction = g.gold THEN r.rank END) AS pos, max(r.rank) AS deep
    FROM {gold} g LEFT JOIN {ranked} r ON g.query_id = r.query_id GROUP BY {lead}g.query_id
) SELECT {lead}count(*) AS n_queries, {of(1)}, {of(5)}, {of(10)}, {of(20)}, round(avg(coalesce(1.0 / pos, 0.0)), 6) AS mrr FROM hits{group}"""


WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"
GRAMS = "list_concat(" * 2 + ", ".join(f"list_transform(range(1, greatest(1, len(t) - {n - 2})), lambda i: substr(t, i, {n}))" + (")" if n > 3 else "") for n in (3, 4, 5))
BM25 = f"""tokens AS (SELECT item_id, {WORDS} AS w FROM items),
stats AS (SELECT count(*) AS n, greatest(avg(len(w)), 1e-12) AS avgdl FROM tokens),
postings AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(w) AS term FROM tokens) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
idfs AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM dfs, stats),
asked AS (SELECT DISTINCT query_id, unnest({WORDS}) AS term FROM queries),
scores AS (
    SELECT query_id, p.item_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.75 + 0.25 * len(w) / avgdl))), 6) AS score
    FROM asked JOIN postings p USING (term) JOIN idfs USING (term) JOIN tokens k ON k.item_id = p.item_id, stats GROUP BY ALL
)"""
DOCS = "items AS (SELECT doc_id AS item_id, text FROM documents), queries AS (SELECT item_id AS query_id, text FROM benchmark)"
TURNS = "items AS (SELECT conv_id * 1000 + turn AS item_id, text FROM conversations), queries AS (SELECT item_id AS query_id, text FROM benchmark)"
TFIDF = f"""spaced AS (SELECT item_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM items),
grams AS (SELECT item_id, gram, count(*) AS tf FROM (SELECT item_id, unnest({GRAMS}) AS gram FROM spaced) GROUP BY ALL),
idfs AS (SELECT gram, count(*) AS df, ln((1 + (SELECT count(*) FROM items)) / (1 + count(*))) + 1 AS idf FROM grams GROUP BY gram)"""
POOL = f"""joined AS (SELECT vec_id AS item_id, embedding, text FROM embeddings JOIN documents ON vec_id = doc_id),
items AS (SELECT item_id, text FROM joined), queries AS (SELECT item_id AS query_id, text FROM joined WHERE item_id % 50 = 0),
{BM25},
every AS (
    SELECT a.item_id AS query_id, b.item_id, {COSINE} AS d, coalesce(s.score, 0) AS s
    FROM joined a CROSS JOIN joined b LEFT JOIN scores s ON s.query_id = a.item_id AND s.item_id = b.item_id WHERE a.item_id % 50 = 0
), lists AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, item_id) AS rd, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rs FROM every
), spread AS (
    SELECT *, min(d) OVER q AS d0, max(d) OVER q AS d1, min(s) OVER q AS s0, max(s) OVER q AS s1 FROM lists WHERE rd <= 50 OR rs <= 50 WINDOW q AS (PARTITION BY query_id)
), pool AS (
    SELECT query_id, item_id,
        round(CASE WHEN d1 - d0 < 1e-12 THEN CASE WHEN d1 > 0 THEN 1.0 ELSE 0.0 END ELSE (d - d0) / (d1 - d0) END, 6) AS dense,
        round(CASE WHEN s1 - s0 < 1e-12 THEN CASE WHEN s1 > 0 THEN 1.0 ELSE 0.0 END ELSE (s - s0) / (s1 - s0) END, 6) AS sparse FROM spread
), mixed AS (
    SELECT weight, query_id, item_id, label AS key, round(weight * dense + (1 - weight) * sparse, 6) AS score
    FROM pool JOIN embeddings ON item_id = vec_id, (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS weight)
), firsts AS (
    SELECT * FROM mixed QUALIFY row_number() OVER (PARTITION BY weight, query_id, key ORDER BY score DESC, item_id) = 1
), fused AS (
    SELECT weight, query_id, (row_number() OVER (PARTITION BY weight, query_id ORDER BY score DESC, item_id))::INTEGER AS rank, key, item_id, score FROM firsts QUALIFY rank <= 5
)"""
GRID = f"""{POOL}, hits AS (
    SELECT f.weight, q.item_id AS query_id, min(CASE WHEN f.key = e.label THEN f.rank END) AS pos
    FROM joined q JOIN embeddings e ON e.vec_id = q.item_id JOIN fused f ON f.query_id = q.item_id WHERE q.item_id % 50 = 0 GROUP BY ALL
), grid AS (
    SELECT weight, count(*) AS n_queries, round(avg(CASE WHEN pos <= 1 THEN 1.0 ELSE 0.0 END), 6) AS acc_1,
        round(avg(CASE WHEN pos <= 5 THEN 1.0 ELSE 0.0 END), 6) AS acc_5, round(avg(coalesce(1.0 / pos, 0.0)), 6) AS mrr FROM hits GROUP BY weight
)"""
TOP5 = "SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id))::INTEGER AS rank, item_id, score FROM scores QUALIFY rank <= 5"

SQL = {
    "dense_topk_dedup": f"WITH {_dense_sql(20)} SELECT * FROM ranked",
    "dense_metrics": f"WITH {_dense_sql(20)}, gold AS (SELECT vec_id AS query_id, label AS gold FROM embeddings WHERE vec_id % 50 = 0), {_metrics_sql('ranked', 'gold')}",
    "predictions_padded": f"""WITH {_dense_sql(8)}, deep AS (SELECT query_id, max(rank) AS m FROM ranked GROUP BY query_id)
        SELECT query_id, unnest(CASE WHEN rank = m THEN range(rank, greatest(rank, 5) + 1) ELSE [rank] END)::INTEGER AS rank, prediction FROM ranked JOIN deep USING (query_id)""",
    "merged_topk": f"""SELECT a.vec_id AS query_id, (row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id))::INTEGER AS rank, b.vec_id AS item_id, {COSINE} AS score
        FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 5""",
    "dense_pair_scores": f"SELECT a.vec_id AS query_id, b.vec_id AS item_id, {COSINE} AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "metrics_by_type": f"""WITH typed AS (SELECT e.*, lang AS type FROM embeddings e JOIN documents ON vec_id = doc_id), ranked AS (
        SELECT a.vec_id AS query_id, (row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id))::INTEGER AS rank, b.label AS prediction
        FROM typed a JOIN typed b ON a.type = b.type AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rank <= 20
        ), gold AS (SELECT vec_id AS query_id, label AS gold, type FROM typed WHERE vec_id % 50 = 0), {_metrics_sql('ranked', 'gold', 'type')}""",
    "pairwise_rank_metrics": """WITH placed AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars % 97 DESC, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 7 END DESC NULLS LAST, doc_id) AS p
        FROM labels JOIN documents USING (doc_id)), firsts AS (SELECT source, min(CASE WHEN quality > 0 THEN p END) AS pos FROM placed GROUP BY source)
        SELECT round(avg(CASE WHEN pos <= 1 THEN 1.0 ELSE 0.0 END), 6) AS acc_1, round(avg(CASE WHEN pos <= 5 THEN 1.0 ELSE 0.0 END), 6) AS acc_5, round(avg(coalesce(1.0 / pos, 0.0)), 6) AS mrr, count(*) AS n_queries FROM firsts""",
    "normalized_documents": r"""WITH a AS (SELECT doc_id, trim(regexp_replace(lower(translate(coalesce(text, ''), '‘’‚‛′´`“”„‟″«»', '''''''''''''''"""
    + '"""""""'
    + r"""')), '\s+', ' ', 'g')) AS t FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\s*,\s*', ', ', 'g'), '(,\s*){2,}', ', ', 'g') AS t FROM a)
        SELECT doc_id, trim(regexp_replace(regexp_replace(t, '[.,\s]+$', ''), '\s+', ' ', 'g')) AS normalized FROM b""",
    "tokenize_counts": f"SELECT doc_id, len({WORDS})::INTEGER AS n_tokens, len(list_distinct({WORDS}))::INTEGER AS n_distinct FROM documents",
    "char_ngram_counts": f"SELECT conv_id, turn, len(g)::INTEGER AS n_grams, len(list_distinct(g))::INTEGER AS n_distinct FROM (SELECT conv_id, turn, {GRAMS} AS g FROM (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM conversations))",
    "bm25_stats": f"WITH {DOCS}, {BM25} SELECT term, df, round(idf, 6) AS idf FROM idfs",
    "bm25_topk": f"WITH {DOCS}, {BM25} {TOP5}",
    "bm25_pair_scores": f"WITH {DOCS}, {BM25} SELECT query_id, query_id * 3 AS item_id, coalesce(score, 0.0) AS score FROM queries LEFT JOIN scores s USING (query_id) WHERE s.item_id = query_id * 3 UNION ALL SELECT query_id, query_id * 3, 0.0 FROM queries q WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.query_id = q.query_id AND s.item_id = q.query_id * 3)",
    "tfidf_idf": f"WITH {TURNS}, {TFIDF} SELECT gram, df, round(idf, 6) AS idf FROM idfs",
    "tfidf_topk": f"""WITH {TURNS}, {TFIDF}, raw AS (SELECT item_id, gram, tf * idf AS r FROM grams JOIN idfs USING (gram)),
        norms AS (SELECT item_id, sqrt(sum(r * r)) AS n FROM raw GROUP BY item_id),
        asked AS (SELECT query_id, gram, count(*) AS tf FROM (SELECT query_id, unnest({GRAMS}) AS gram FROM (SELECT query_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM queries)) GROUP BY ALL),
        qraw AS (SELECT query_id, gram, tf * idf AS r FROM asked JOIN idfs USING (gram)), qnorms AS (SELECT query_id, sqrt(sum(r * r)) AS n FROM qraw GROUP BY query_id),
        scores AS (SELECT query_id, item_id, round(sum(q.r / qn.n * d.r / dn.n), 6) AS score FROM qraw q JOIN raw d USING (gram) JOIN norms dn USING (item_id) JOIN qnorms qn USING (query_id) GROUP BY ALL) {TOP5}""",
    "minmax_norm": "SELECT event_id, round(CASE WHEN hi - lo < 1e-12 THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (value - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT *, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)",
    "hybrid_fuse": f"WITH {POOL} SELECT query_id, rank, key, item_id, score FROM fused WHERE weight = 0.7",
    "grid_search": f"WITH {GRID} SELECT * FROM grid",
    "grid_best": f"WITH {GRID} SELECT * FROM grid ORDER BY acc_1 DESC, mrr DESC, acc_5 DESC, weight LIMIT 1",
    "rerank_with_scorer": f"""WITH {DOCS}, {BM25}, listed AS ({TOP5}), worded AS (SELECT l.*, list_distinct(regexp_extract_all(lower(q.text), '[\\p{{L}}\\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(lower(i.text), '[\\p{{L}}\\p{{N}}_]+')) AS b
        FROM listed l JOIN queries q USING (query_id) JOIN items i USING (item_id)), rescored AS (SELECT *, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0.0 END, 6) AS rerank_score FROM worded)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, rank))::INTEGER AS rank, item_id, rerank_score FROM rescored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, rank) <= 3""",
}
