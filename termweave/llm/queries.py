"""The registered queries of the training-data operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.quality import classify

    return classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.voronoi_knn import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=5, scale=256.0, query_mod=50)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.sharding import byte_shards

    return byte_shards(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.html_extract import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.permutation_index import embedding_near_duplicates

    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library ids of all texts and their decoding.  The model file is of the BPE kind: its fold merges by score.

    Null texts count as empty; repeated rows are encoded each; no rows give none.
    """
    return _pieces(spark, sf_dir, unigram=False)


def sentencepiece_best_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op6, with the same pieces and scores read as a unigram model, whose fold is Viterbi."""
    return _pieces(spark, sf_dir, unigram=True)


def _pieces(spark: SparkSession, sf_dir: str, unigram: bool) -> DataFrame:
    from termweave.llm.piece_model import PieceModel
    from termweave.llm.sentencepiece import encode

    model = PieceModel.load(tokenizer_file("piece_bpe_32k.model"))
    model = model.as_unigram() if unigram else model
    back = encode(table(spark, sf_dir, "documents"), model, keep=["doc_id", "text"], decoded=True)
    return back.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.crc32(F.encode("decoded", "UTF-8")).alias("decoded_crc32"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("restored"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.repeats import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return found | {"sentencepiece_best_path": sentencepiece_best_path}


OP3_SQL = """
WITH poly AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS c
        FROM range(256) r(i))
), hexed AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
        regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h
    FROM documents
), sized AS (
    SELECT doc_id, size::BIGINT AS size,
        xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(h, lambda x: ('0x' || x)::UBIGINT)),
            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
    FROM hexed, poly
), line AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start,
        sum(size) OVER () AS total,
        row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS rn
    FROM sized
), cut AS (
    SELECT *, least(39, (2 * start + size) * 40 // (2 * total))::INTEGER AS shard FROM line
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
    (rn - min(rn) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""

OP2_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
    FROM whole q JOIN whole d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP5_SQL = """
WITH RECURSIVE whole AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM whole a JOIN whole b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach(x, y) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), roots AS (
    SELECT x, min(y) AS root FROM reach GROUP BY x
), degree AS (
    SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, e.vec_id = root AS kept
FROM embeddings e JOIN roots r ON e.vec_id = r.x LEFT JOIN degree d ON e.vec_id = d.x
"""

OP8_SQL = """
WITH hexed AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
    SELECT doc_id, h, unnest(range(greatest(0, len(h) // 2 - 49))) AS i FROM hexed
), windows AS (
    SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM starts
), marked AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first_doc FROM windows) WHERE first_doc < doc_id
), gaps AS (
    SELECT doc_id, i, i - lag(i, 1, i - 1000) OVER (PARTITION BY doc_id ORDER BY i) > 50 AS opens FROM marked
), runs AS (
    SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gaps
), spans AS (
    SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY ALL
), pieces AS (
    SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM spans
), kept AS (
    SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
        string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS front
    FROM pieces JOIN hexed USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM hexed LEFT JOIN kept USING (doc_id)
"""

OP9_SQL = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM worded
), flat AS (
    SELECT doc_id, unnest(s) AS g FROM sets
), useful AS (
    SELECT f.doc_id, f.g FROM flat f JOIN (SELECT g FROM flat GROUP BY g HAVING count(*) > 1) c ON f.g = c.g
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM useful a JOIN useful b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
    WHERE 100 * n >= 85 * (len(a.s) + len(b.s) - n)
), both_ways AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
), roots AS (
    SELECT x, min(y) AS root FROM reach GROUP BY x
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, root AS component_id, doc_id = root AS kept
FROM sets JOIN roots ON doc_id = x
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": OP2_SQL, "op3_sharding": OP3_SQL, "op5_embedding_near_dedup": OP5_SQL, "op8_suffix_array_dedup": OP8_SQL, "op9_minhash_near_dedup": OP9_SQL}
