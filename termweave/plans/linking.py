"""Queries on dictionary upkeep, mention context, concept profiles, training sets and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.aliases import alias_kind, is_abbreviation, is_all_caps, is_fragment, sanitize_alias
from termweave.functions.text import span_bounds, text_window, unit_hash
from termweave.operators import context, metrics, profiles, training, vocabulary
from termweave.streaming.linking import link_mentions, windowed_counts


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocab(spark, sf_dir):
    """The part table as a dictionary: names, brands as concepts, types, two languages."""
    p = _read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("concept_name"), F.col("p_brand").alias("CUI"), F.col("p_type").alias("semantic_type"), F.when(F.col("p_size") % 2 == 0, "EN").otherwise("ru").alias("lang"))


def _mentions(spark, sf_dir):
    """Suppliers as linked mentions; some unlinkable, some of concepts the dictionary lacks."""
    s = _read(spark, sf_dir, "supplier")
    kind = F.element_at(F.array(*map(F.lit, ("ECONOMY", "STANDARD", "MEDIUM", "PROMO", "LARGE", "SMALL"))), (F.col("s_suppkey") % 6 + 1).cast("int"))
    cui = F.when(F.col("s_nationkey") % 5 == 0, "CUILESS").otherwise(F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 10).cast("string")))
    return s.select("s_suppkey", F.concat(F.lit("maker "), F.col("s_nationkey").cast("string")).alias("text"), cui.alias("UMLS_CUI"), kind.alias("entity_type"))


def vocab_lang_filter(spark, sf_dir):
    return vocabulary.filter_language(_vocab(spark, sf_dir), "en").select("item_id", "concept_name", "lang")


def enrich_missing_cui(spark, sf_dir):
    return vocabulary.enrichment_rows(_vocab(spark, sf_dir), _mentions(spark, sf_dir), True, "EN")


def enrich_all_pairs(spark, sf_dir):
    return vocabulary.enrichment_rows(_vocab(spark, sf_dir), _mentions(spark, sf_dir), False)


def vocab_eval_union(spark, sf_dir):
    _, test = vocabulary.prepare_vocabularies(_vocab(spark, sf_dir), _mentions(spark, sf_dir), "en")
    return test.groupBy("semantic_type").agg(F.count("*").alias("n_names"), F.countDistinct("CUI").alias("n_concepts"), F.count_if(F.col("item_id").isNull()).alias("n_added"))


def _spans(spark, sf_dir):
    """Events as mentions of one document per user."""
    stop = F.col("event_id") + F.floor("value") + 1
    e = _read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("document_id"), F.col("event_id").cast("int").alias("start"), stop.cast("int").alias("stop"), F.col("event_type").alias("text"))
    return e.withColumn("spans", F.concat_ws("-", F.col("start").cast("string"), F.col("stop").cast("string"))).withColumn("entity_type", F.lit("CHEM"))


def span_parse(spark, sf_dir):
    e = _spans(spark, sf_dir)
    spans = F.concat(F.col("spans"), F.lit(","), (F.col("stop") + 5).cast("string"), F.lit("-"), (F.col("stop") + 9).cast("string"))
    return e.select("event_id", span_bounds(spans).alias("b")).select("event_id", "b.start", "b.stop")


def nested_context(spark, sf_dir):
    return context.enclosing_mentions(_spans(spark, sf_dir))


def text_windows(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    n = F.length("text")
    w = text_window(F.col("text"), F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"), 4, 4)
    return d.select("doc_id", w.alias("w")).select("doc_id", F.col("w.left").alias("left_context"), F.col("w.right").alias("right_context"))


def _contextualized(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("document_text"))
    return context.contextualize(_spans(spark, sf_dir), docs, "hybrid")


def hybrid_context(spark, sf_dir):
    return _contextualized(spark, sf_dir).select("event_id", "context_source", "left_context_text", "right_context_text")


def context_coverage(spark, sf_dir):
    return context.context_coverage(_contextualized(spark, sf_dir))


def alias_length_threshold(spark, sf_dir):
    return profiles.alias_length_threshold(_read(spark, sf_dir, "benchmark"), "text")


def _aliases(spark, sf_dir):
    names = [("part", "p_name"), ("part", "p_type"), ("customer", "c_name"), ("customer", "c_mktsegment"), ("events", "event_type"), ("region", "r_name"), ("nation", "n_name"), ("orders", "o_orderpriority"), ("benchmark", "text")]
    out = None
    for t, c in names:
        one = _read(spark, sf_dir, t).select(F.col(c).alias("alias")).distinct()
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def alias_class(spark, sf_dir):
    a = F.col("alias")
    return _aliases(spark, sf_dir).select("alias", alias_kind(a).alias("kind"), is_abbreviation(a).alias("abbreviation"), is_all_caps(a).alias("all_caps"), is_fragment(a).alias("fragment"))


def alias_cleaning(spark, sf_dir):
    """Names wrapped in the marks that cleaning takes off or rejects."""
    p = _read(spark, sf_dir, "part")
    marks = ["{} (disorder)", "entire {}", "{} structure", "{} , NOS", "serum | {}", "{} (product)", "{}  -  {} (finding) (substance)", "a.b {}"]
    wrap = F.element_at(F.array(*[F.concat(*[F.lit(part) if i == 0 else F.concat(F.col("p_name"), F.lit(part)) for i, part in enumerate(m.split("{}"))]) for m in marks]), (F.col("p_partkey") % len(marks) + 1).cast("int"))
    return p.select("p_partkey", sanitize_alias(wrap).alias("cleaned"))


def representative_alias(spark, sf_dir):
    return profiles.representatives(_vocab(spark, sf_dir), ["ENG", "RUS"])


def concept_profiles(spark, sf_dir):
    return profiles.concept_profiles(_vocab(spark, sf_dir), ["ENG", "RUS"])


def _synonyms(spark, sf_dir):
    return training.concept_synonyms(_vocab(spark, sf_dir))


def concept_synonyms(spark, sf_dir):
    return _synonyms(spark, sf_dir).withColumn("synonyms", F.array_join("synonyms", "|"))


def vocabulary_subset(spark, sf_dir):
    v = _vocab(spark, sf_dir).withColumn("lang", F.when(F.col("CUI") == "Brand#7", "RU").otherwise("EN"))
    return training.vocabulary_subset(v, _mentions(spark, sf_dir), 3).groupBy("CUI").agg(F.count("*").alias("n"))


def _pseudo(spark, sf_dir):
    return training.pseudo_queries(_synonyms(spark, sf_dir), limit=5)


def pseudo_queries(spark, sf_dir):
    return _pseudo(spark, sf_dir).select("CUI", "semantic_type", "representative_name", F.array_join("pseudo_queries", "|").alias("pseudo_queries"), "num_pseudo_queries")


def _concepts(spark, sf_dir):
    return training.hash_split(_pseudo(spark, sf_dir), F.concat_ws("|", "semantic_type", "CUI"), 0.2)


def hash_split(spark, sf_dir):
    return _concepts(spark, sf_dir).select("CUI", "semantic_type", "split", F.round(unit_hash(F.concat_ws("|", "semantic_type", "CUI")), 9).alias("h"))


def pretrain_queries(spark, sf_dir):
    return training.pretrain_queries(_concepts(spark, sf_dir))


def _candidates(spark, sf_dir):
    """Concepts of a query's type by lexical score."""
    texts = _concepts(spark, sf_dir).select("CUI", "semantic_type", F.col("representative_name").alias("text"))
    return training.lexical_top_k(training.pretrain_queries(_concepts(spark, sf_dir)), texts, 20)


def _pairs(spark, sf_dir):
    texts = _concepts(spark, sf_dir).select("CUI", "semantic_type", F.col("representative_name").alias("candidate_text"))
    return training.pretrain_pairs(training.pretrain_queries(_concepts(spark, sf_dir)), _candidates(spark, sf_dir).drop("text"), texts, 4)


def pretrain_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("query_id", "candidate_cui", "candidate_text", "label", "candidate_rank", "retriever_score", "split")


def pair_split_summary(spark, sf_dir):
    return training.pair_summary(_pairs(spark, sf_dir))


def pair_hit_rate(spark, sf_dir):
    return training.negative_share(_pairs(spark, sf_dir))


def size_estimate(spark, sf_dir):
    return training.random_pair_estimate(_pseudo(spark, sf_dir), 20)


def dense_pairs(spark, sf_dir):
    return training.dense_pairs(_mentions(spark, sf_dir), _vocab(spark, sf_dir))


def hard_negatives(spark, sf_dir):
    """Names of other concepts retrieved by the pair's own name: the mentions of these tables share no word with names."""
    names = _vocab(spark, sf_dir).select("semantic_type", "CUI", F.col("concept_name").alias("text")).distinct()
    pairs = training.dense_pairs(_mentions(spark, sf_dir), _vocab(spark, sf_dir)).withColumn("pair_id", F.concat_ws("|", "mention_text", "CUI", "entity_type", "concept_name"))
    asked = pairs.select(F.concat_ws("|", "entity_type", "concept_name").alias("query_id"), F.col("concept_name").alias("query_text"), F.col("entity_type").alias("semantic_type")).distinct()
    found = training.lexical_top_k(asked, names, 30).withColumnRenamed("text", "name")
    lists = pairs.select("pair_id", F.concat_ws("|", "entity_type", "concept_name").alias("query_id")).join(found, "query_id").select("pair_id", "rank", "CUI", "name")
    out = training.hard_negatives(pairs, lists, 3, skip=1)
    return out.select("pair_id", F.array_join("hard_negatives", ";").alias("hard_negatives"))


def _lists(spark, sf_dir):
    q = training.pretrain_queries(_concepts(spark, sf_dir)).select(F.col("query_id").alias("row_id"), F.col("query_text").alias("query"), F.col("CUI").alias("gold_cui"))
    c = _candidates(spark, sf_dir).select(F.col("query_id").alias("row_id"), "rank", "CUI", "text")
    names = _vocab(spark, sf_dir).select("CUI", F.col("concept_name").alias("text")).distinct()
    return training.listwise(q, c, names, 5)


def listwise_rows(spark, sf_dir):
    return _lists(spark, sf_dir).select("row_id", "query", F.array_join("docs", "|").alias("docs"), F.array_join(F.transform("labels", lambda x: x.cast("int").cast("string")), "").alias("labels"))


def pairwise_rows(spark, sf_dir):
    return training.pairwise(_lists(spark, sf_dir))


def batch_layout(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("CUI"))
    return training.batch_layout(rows, 8).select("row_id", "round", "batch")


def pos_weight(spark, sf_dir):
    return training.positive_weight(_read(spark, sf_dir, "labels").select(F.col("toxic").alias("label")))


def matched_alias(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    text = F.concat_ws("; ", "p_name", "p_type")
    alias = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.lit(" "))
    return p.select("p_partkey", training.with_matched_alias(text, alias).alias("rendered"))


def best_epochs(spark, sf_dir):
    """Days of orders as epochs of one run per priority, their mean price as the metric."""
    o = _read(spark, sf_dir, "orders")
    history = o.groupBy(F.col("o_orderpriority").alias("run"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("epoch")).agg(F.round(F.max("o_totalprice"), 2).alias("value"))
    return metrics.best_epoch(history, "value", 30)


def windowed_event_counts(spark, sf_dir):
    return windowed_counts(_read(spark, sf_dir, "events"))


def linked_mentions(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("name"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).otherwise("SMALL").alias("type"))
    return link_mentions(p, _vocab(spark, sf_dir)).select("p_partkey", "CUI")


QUERIES = [
    vocab_lang_filter, enrich_missing_cui, enrich_all_pairs, vocab_eval_union, span_parse, nested_context, text_windows, hybrid_context, context_coverage, alias_length_threshold,
    alias_class, alias_cleaning, representative_alias, concept_profiles, concept_synonyms, vocabulary_subset, pseudo_queries, hash_split, pretrain_queries, pretrain_pairs,
    pair_split_summary, pair_hit_rate, size_estimate, dense_pairs, hard_negatives, listwise_rows, pairwise_rows, batch_layout, pos_weight, matched_alias, best_epochs,
    windowed_event_counts, linked_mentions,
]

VOCAB = "vocab AS (SELECT p_partkey AS item_id, p_name AS concept_name, p_brand AS CUI, p_type AS semantic_type, CASE WHEN p_size % 2 = 0 THEN 'EN' ELSE 'ru' END AS lang FROM part)"
MENTIONS = "mentions AS (SELECT s_suppkey, 'maker ' || s_nationkey AS text, CASE WHEN s_nationkey % 5 = 0 THEN 'CUILESS' ELSE 'Brand#' || (s_nationkey + 10) END AS cui, ['ECONOMY', 'STANDARD', 'MEDIUM', 'PROMO', 'LARGE', 'SMALL'][s_suppkey % 6 + 1] AS entity_type FROM supplier)"
ADDED = "SELECT DISTINCT text AS concept_name, cui AS CUI, entity_type AS semantic_type FROM mentions m WHERE cui <> 'CUILESS'"
SPANS = "mentions AS (SELECT event_id, user_id AS document_id, event_id::INTEGER AS start, (event_id + floor(value) + 1)::INTEGER AS stop, event_type AS text, event_id || '-' || (event_id + floor(value) + 1)::INTEGER AS spans FROM events)"
NESTED = f"""{SPANS}, pairs AS (
    SELECT a.document_id, a.spans, a.start, a.stop, b.spans AS os, b.start AS o0, b.stop AS o1, b.text AS ot
    FROM (SELECT DISTINCT document_id, spans, start, stop FROM mentions) a JOIN mentions b
    ON a.document_id = b.document_id AND a.spans <> b.spans AND b.start <= a.start AND b.stop >= a.stop
), best AS (
    SELECT document_id, spans, min(CASE WHEN o0 < start THEN (o0 - o1, o0, -o1, ot, os) END) AS l, min(CASE WHEN o1 > stop THEN (o0 - o1, o0, -o1, ot, os) END) AS r FROM pairs GROUP BY ALL
), nested AS (
    SELECT DISTINCT m.document_id, m.spans, CASE WHEN coalesce(l[5] = r[5] OR l[4] = r[4], false) THEN NULL ELSE l[4] END AS left_text, r[4] AS right_text
    FROM mentions m LEFT JOIN best USING (document_id, spans)
)"""
LEFT = "trim(regexp_replace(array_to_string(list_slice(lw, greatest(1, len(lw) - 3), len(lw)), ' '), '[(\\[{«\"'']+\\s*$', ''))"
RIGHT = "trim(regexp_replace(array_to_string(list_slice(rw, 1, 4), ' '), '^\\s*[)\\]}»\"'']+', ''))"
HYBRID = f"""{NESTED}, cutted AS (
    SELECT m.*, left_text, right_text, regexp_extract_all(substr(coalesce(d.text, ''), 1, start), '\\S+') AS lw, regexp_extract_all(substr(coalesce(d.text, ''), stop + 1), '\\S+') AS rw
    FROM mentions m LEFT JOIN nested USING (document_id, spans) LEFT JOIN documents d ON d.doc_id = m.document_id
), hybrid AS (
    SELECT event_id, CASE WHEN left_text IS NOT NULL OR right_text IS NOT NULL THEN 'nested' ELSE 'window' END AS context_source,
        CASE WHEN left_text IS NOT NULL OR right_text IS NOT NULL THEN coalesce(left_text, '') ELSE {LEFT} END AS left_context_text,
        CASE WHEN left_text IS NOT NULL OR right_text IS NOT NULL THEN coalesce(right_text, '') ELSE {RIGHT} END AS right_context_text
    FROM cutted
)"""
COMPACT = r"regexp_replace(a, '[\s./_-]+', '', 'g')"
LETTERS = r"regexp_replace(" + COMPACT + r", '\P{L}', '', 'g')"
TOKENS = r"list_filter(regexp_split_to_array(a, '[\s/,_-]+'), lambda t: t <> '')"
ABBREVIATION = f"""(len({COMPACT}) > 0 AND len({TOKENS}) > 0 AND (
    (len({TOKENS}) = 1 AND len({COMPACT}) <= 6) OR (len({TOKENS}) <= 2 AND len({COMPACT}) <= 8 AND regexp_matches({COMPACT}, '\\d'))
    OR (len({TOKENS}) <= 2 AND len({COMPACT}) <= 10 AND len({LETTERS}) > 0 AND (list_max(list_transform({TOKENS}, lambda t: len(t))) <= 5
        OR len({LETTERS}) - len(regexp_replace(lower({LETTERS}), '[aeiouyаеёиоуыэюя]', '', 'g')) <= greatest(1, len({LETTERS}) // 5)))))"""
WORDS_OF = r"len(list_filter(regexp_split_to_array(a, '\s+'), lambda t: t <> ''))"
CAPS = r"(len(regexp_replace(a, '\P{L}', '', 'g')) >= 3 AND NOT regexp_matches(regexp_replace(a, '\P{L}', '', 'g'), '[^\p{Lu}]'))"
SYNONYMS = f"""{VOCAB}, synonyms AS (
    SELECT CUI, semantic_type, arg_min(concept_name, (len(concept_name), lower(concept_name), concept_name)) AS representative_name, list_sort(list(DISTINCT concept_name)) AS synonyms,
        count(DISTINCT concept_name)::INTEGER AS num_vocab_synonyms FROM vocab GROUP BY CUI, semantic_type)"""
PSEUDO = f"""{SYNONYMS}, pseudo AS (
    SELECT *, list_slice(list_filter(synonyms, lambda s: s <> representative_name), 1, 5) AS pq, len(list_slice(list_filter(synonyms, lambda s: s <> representative_name), 1, 5))::INTEGER AS n
    FROM synonyms WHERE len(synonyms) > 1)"""
CONCEPTS = f"""{PSEUDO}, hashed AS (SELECT *, ('0x' || substr(sha256(semantic_type || '|' || CUI), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615.0 AS h FROM pseudo),
concepts AS (SELECT *, CASE WHEN h < 0.2 OR h = (SELECT min(h) FROM hashed) THEN 'dev' ELSE 'train' END AS split FROM hashed),
asked AS (SELECT semantic_type || '|' || CUI || '|' || i AS query_id, pq[i + 1] AS query_text, CUI, semantic_type, split FROM (SELECT *, unnest(range(len(pq))) AS i FROM concepts))"""
LEXICAL = r"CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len({a}) ELSE 0.0 END".format(
    a=r"list_distinct(regexp_extract_all(lower(query_text), '[\p{L}\p{N}_]+'))", b=r"list_distinct(regexp_extract_all(lower(c.representative_name), '[\p{L}\p{N}_]+'))"
)
CANDIDATES = f"""{CONCEPTS}, scored AS (
    SELECT q.query_id, c.CUI AS c, round({LEXICAL}, 6) AS score, c.representative_name AS text FROM asked q JOIN concepts c ON q.semantic_type = c.semantic_type
), candidates AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, c))::INTEGER AS rank FROM scored QUALIFY rank <= 20)"""
PAIRS = f"""{CANDIDATES}, wrong AS (
    SELECT q.query_id, c AS candidate_cui, text AS candidate_text, 0 AS label, rank AS candidate_rank, score AS retriever_score, split FROM asked q JOIN candidates k USING (query_id) WHERE c <> q.CUI
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 4
), pairs AS (
    SELECT q.query_id, q.CUI AS candidate_cui, representative_name AS candidate_text, 1 AS label, 0 AS candidate_rank, NULL::DOUBLE AS retriever_score, q.split FROM asked q JOIN concepts USING (CUI, semantic_type)
    UNION ALL SELECT * FROM wrong
)"""
DENSE = f"{VOCAB}, {MENTIONS}, dense AS (SELECT DISTINCT text AS mention_text, concept_name, v.CUI, entity_type FROM mentions m JOIN vocab v ON m.cui = v.CUI AND m.entity_type = v.semantic_type WHERE m.cui <> 'CUILESS')"
LISTS = f"""{CANDIDATES}, listed AS (
    SELECT q.query_id AS row_id, query_text AS query, q.CUI AS gold, list(text ORDER BY rank) AS docs, list(CASE WHEN c = q.CUI THEN 1 ELSE 0 END ORDER BY rank) AS labels
    FROM asked q JOIN candidates k USING (query_id) WHERE rank <= 5 GROUP BY ALL
), golds AS (
    SELECT row_id, arg_min(concept_name, sha256(row_id || '|' || concept_name)) AS g FROM listed JOIN (SELECT DISTINCT CUI, concept_name FROM vocab) ON gold = CUI WHERE NOT list_contains(labels, 1) GROUP BY row_id
), lists AS (
    SELECT row_id, query, CASE WHEN g IS NULL THEN docs ELSE list_append(docs[1:len(docs) - 1], g) END AS docs, CASE WHEN g IS NULL THEN labels ELSE list_append(labels[1:len(labels) - 1], 1) END AS labels
    FROM listed LEFT JOIN golds USING (row_id) WHERE list_contains(labels, 1) OR g IS NOT NULL
)"""

SQL = {
    "vocab_lang_filter": f"WITH {VOCAB} SELECT item_id, concept_name, lang FROM vocab WHERE lang = 'EN'",
    "enrich_missing_cui": f"WITH {VOCAB}, {MENTIONS} SELECT *, 'EN' AS lang FROM ({ADDED} AND cui NOT IN (SELECT CUI FROM vocab)) a",
    "enrich_all_pairs": f"WITH {VOCAB}, {MENTIONS} SELECT *, NULL::VARCHAR AS lang FROM ({ADDED} AND NOT EXISTS (SELECT 1 FROM vocab v WHERE v.concept_name = m.text AND v.CUI = m.cui AND v.semantic_type = m.entity_type)) a",
    "vocab_eval_union": f"""WITH {VOCAB}, {MENTIONS}, grown AS (SELECT item_id, concept_name, CUI, semantic_type, lang FROM vocab UNION ALL
        SELECT NULL, concept_name, CUI, semantic_type, 'EN' FROM ({ADDED} AND NOT EXISTS (SELECT 1 FROM vocab v WHERE v.concept_name = m.text AND v.CUI = m.cui AND v.semantic_type = m.entity_type)) a)
        SELECT semantic_type, count(*) AS n_names, count(DISTINCT CUI) AS n_concepts, count(*) FILTER (item_id IS NULL) AS n_added FROM grown WHERE lang = 'EN' GROUP BY semantic_type""",
    "span_parse": f"WITH {SPANS} SELECT event_id, start, stop + 9 AS stop FROM mentions",
    "nested_context": f"WITH {NESTED} SELECT * FROM nested",
    "text_windows": f"""WITH cutted AS (SELECT doc_id, regexp_extract_all(substr(text, 1, len(text) // 3), '\\S+') AS lw, regexp_extract_all(substr(text, len(text) // 2 + 1), '\\S+') AS rw FROM documents)
        SELECT doc_id, {LEFT} AS left_context, {RIGHT} AS right_context FROM cutted""",
    "hybrid_context": f"WITH {HYBRID} SELECT * FROM hybrid",
    "context_coverage": f"WITH {HYBRID} SELECT count(*) AS n_rows, count(*) FILTER (left_context_text <> '' OR right_context_text <> '') AS n_context, count(*) FILTER (left_context_text <> '') AS n_left, count(*) FILTER (right_context_text <> '') AS n_right, count(*) FILTER (left_context_text <> '' AND right_context_text <> '') AS n_both FROM hybrid",
    "alias_length_threshold": """WITH n AS (SELECT len(trim(text)) AS n FROM benchmark WHERE len(trim(text)) > 0), q AS (SELECT count(*) AS num_aliases, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3, quantile_cont(n, 0.995) AS quantile_value,
        quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, max(n)::DOUBLE AS longest FROM n), i AS (SELECT *, q3 + 3.0 * greatest(q3 - q1, 1.0) AS iqr_value FROM q)
        SELECT num_aliases, quantile_value, median, p95, p99, longest, iqr_value::DOUBLE AS iqr_value, greatest(96, least(256, round_even(least(quantile_value, iqr_value), 0)))::DOUBLE AS threshold FROM i""",
    "alias_class": f"""WITH aliases AS (SELECT DISTINCT a FROM (SELECT p_name AS a FROM part UNION SELECT p_type FROM part UNION SELECT c_name FROM customer UNION SELECT c_mktsegment FROM customer UNION SELECT event_type FROM events
        UNION SELECT r_name FROM region UNION SELECT n_name FROM nation UNION SELECT o_orderpriority FROM orders UNION SELECT text FROM benchmark))
        SELECT a AS alias, CASE WHEN {ABBREVIATION} THEN 'abbreviations' WHEN {WORDS_OF} <= 2 AND len(a) <= 24 THEN 'short_names' WHEN {WORDS_OF} <= 5 AND len(a) <= 80 THEN 'multi_word' ELSE 'long_variants' END AS kind,
        {ABBREVIATION} AS abbreviation, {CAPS} AS all_caps, contains(a, ';') AND false AS fragment FROM aliases""",
    "alias_cleaning": """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name WHEN 3 THEN '' WHEN 4 THEN '' WHEN 5 THEN p_name WHEN 6 THEN p_name || '-' || p_name ELSE '' END AS cleaned FROM part""",
    "representative_alias": f"""WITH {VOCAB}, ranked AS (SELECT CUI, semantic_type, concept_name AS a, CASE lang WHEN 'EN' THEN 0 ELSE 1 END AS priority, item_id FROM vocab),
        firsts AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY CUI, semantic_type, a ORDER BY item_id) = 1),
        keyed AS (SELECT *, {ABBREVIATION} AS ab FROM firsts)
        SELECT CUI, semantic_type, arg_min(a, (priority, (ab AND len({LETTERS}) <= 3 AND len({COMPACT}) <= 5)::INT, ab::INT, len(a), lower(a), a)) AS representative FROM keyed GROUP BY CUI, semantic_type""",
    "concept_synonyms": f"WITH {SYNONYMS} SELECT CUI, semantic_type, representative_name, array_to_string(synonyms, '|') AS synonyms, num_vocab_synonyms FROM synonyms",
    "vocabulary_subset": f"""WITH {VOCAB}, {MENTIONS}, named AS (SELECT cui AS CUI FROM mentions UNION SELECT 'Brand#7'),
        others AS (SELECT DISTINCT CUI FROM vocab WHERE CUI NOT IN (SELECT CUI FROM named) ORDER BY sha256('42|' || CUI), CUI LIMIT 3)
        SELECT CUI, count(*) AS n FROM vocab WHERE CUI IN (SELECT CUI FROM named) OR CUI IN (SELECT CUI FROM others) GROUP BY CUI""",
    "pseudo_queries": f"WITH {PSEUDO} SELECT CUI, semantic_type, representative_name, array_to_string(pq, '|') AS pseudo_queries, n AS num_pseudo_queries FROM pseudo",
    "hash_split": f"WITH {CONCEPTS} SELECT CUI, semantic_type, split, round(h, 9) AS h FROM concepts",
    "pretrain_queries": f"WITH {CONCEPTS} SELECT * FROM asked",
    "pretrain_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
    "pair_split_summary": f"WITH {PAIRS} SELECT split, count(DISTINCT query_id) AS n_queries, count(*) AS n_pairs, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative FROM pairs GROUP BY split",
    "pair_hit_rate": f"WITH {PAIRS} SELECT round(avg(has), 6) AS hit_rate FROM (SELECT max(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS has FROM pairs GROUP BY query_id)",
    "size_estimate": f"WITH {PSEUDO}, by_type AS (SELECT semantic_type, sum(n)::BIGINT AS n_queries, count(*) AS n_concepts FROM pseudo GROUP BY semantic_type) SELECT *, (n_queries * (1 + least(20, greatest(0, n_concepts - 1))))::BIGINT AS n_pairs, (n_queries * (1 + least(20, greatest(0, n_concepts - 1))) * 512)::BIGINT AS n_bytes FROM by_type",
    "dense_pairs": f"WITH {DENSE} SELECT * FROM dense",
    "hard_negatives": f"""WITH {DENSE}, texts AS (SELECT DISTINCT semantic_type AS t, CUI AS c, concept_name AS name, list_distinct(regexp_extract_all(lower(concept_name), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM vocab),
        asked AS (SELECT DISTINCT entity_type AS et, concept_name AS qn, list_distinct(regexp_extract_all(lower(concept_name), '[\\p{{L}}\\p{{N}}_]+')) AS qw FROM dense),
        names AS (SELECT et, qn, c, name, row_number() OVER (PARTITION BY et, qn ORDER BY round(CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, w)) / len(qw) ELSE 0.0 END, 6) DESC, c, name) AS rank FROM asked JOIN texts ON et = t QUALIFY rank <= 30),
        pairs AS (SELECT *, mention_text || '|' || CUI || '|' || entity_type || '|' || concept_name AS pair_id FROM dense),
        usable AS (SELECT pair_id, rank, name FROM pairs JOIN names ON entity_type = et AND concept_name = qn WHERE c <> CUI AND lower(name) <> lower(mention_text) AND lower(name) <> lower(concept_name)
            QUALIFY row_number() OVER (PARTITION BY pair_id, lower(name) ORDER BY rank) = 1),
        placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY rank) AS p FROM usable QUALIFY p > 1 AND p <= 4),
        lists AS (SELECT pair_id, list(name ORDER BY p) AS l FROM placed GROUP BY pair_id)
        SELECT pair_id, array_to_string(list_resize(l, 3, l[-1]), ';') AS hard_negatives FROM pairs LEFT JOIN lists USING (pair_id)""",
    "listwise_rows": f"WITH {LISTS} SELECT row_id, query, array_to_string(docs, '|') AS docs, array_to_string(labels, '') AS labels FROM lists",
    "pairwise_rows": f"WITH {LISTS} SELECT row_id, query, (i + 1)::INTEGER AS rank, docs[i + 1] AS doc, labels[i + 1]::DOUBLE AS label FROM (SELECT *, unnest(range(len(docs))) AS i FROM lists)",
    "batch_layout": """WITH h AS (SELECT p_partkey AS row_id, p_brand, sha256('42|' || p_partkey) AS h FROM part), r AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY h, row_id))::INTEGER AS round FROM h)
        SELECT row_id, round, ((row_number() OVER (PARTITION BY round ORDER BY h, row_id) - 1) // 8)::INTEGER AS batch FROM r""",
    "pos_weight": "SELECT round(count(*) FILTER (toxic <= 0) / count(*) FILTER (toxic > 0), 6) AS pos_weight FROM labels",
    "matched_alias": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 AND lower(p_brand) NOT IN (lower(p_name), lower(p_type)) THEN p_brand || '; ' || p_name || '; ' || p_type ELSE p_name || '; ' || p_type END AS rendered FROM part",
    "best_epochs": """WITH h AS (SELECT o_orderpriority AS run, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::INTEGER AS epoch, round(max(o_totalprice), 2) AS value FROM orders GROUP BY ALL),
        b AS (SELECT *, arg_max(epoch, (value, -epoch)) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best_epoch FROM h) SELECT *, epoch - best_epoch >= 30 AS stop FROM b""",
    "windowed_event_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "linked_mentions": "WITH d AS (SELECT lower(p_name) AS n, p_type AS t, min(p_brand) AS CUI FROM part GROUP BY ALL) SELECT p_partkey, CUI FROM part LEFT JOIN d ON lower(p_name) = n AND t = CASE WHEN p_partkey % 4 <> 0 THEN p_type ELSE 'SMALL' END",
}
