"""Training sets for retrievers and rerankers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions.text import caseless, language_code, unit_hash
from termweave.operators.ranking import top_k


# --- dictionary pseudo-queries -------------------------------------------------------------------


def vocabulary_subset(vocab: DataFrame, entities: DataFrame, extra: int, seed: int = 42) -> DataFrame:
    """Rows of concepts that entities name, of Russian names, and of ``extra`` others picked by a hash of (seed, concept)."""
    named = entities.select(F.col("UMLS_CUI").alias("CUI")).unionByName(vocab.where(language_code("lang") == "RUS").select("CUI")).where("CUI is not null").distinct()
    others = vocab.select("CUI").where("CUI is not null").distinct().join(named, "CUI", "left_anti")
    picked = others.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), "CUI"), 256), "CUI").limit(extra)
    return vocab.join(named.unionByName(picked), "CUI", "left_semi")


def concept_synonyms(vocab: DataFrame) -> DataFrame:
    """(CUI, semantic_type, representative_name, synonyms, num_vocab_synonyms): distinct names of each concept in order, and the shortest."""
    names = vocab.select("CUI", "semantic_type", F.col("concept_name").alias("name")).where("name is not null and name <> ''").distinct()
    order = F.struct(F.length("name"), caseless("name"), "name")
    return names.groupBy("CUI", "semantic_type").agg(F.min_by("name", order).alias("representative_name"), F.sort_array(F.collect_list("name")).alias("synonyms")).withColumn("num_vocab_synonyms", F.size("synonyms"))


def pseudo_queries(synonyms: DataFrame, limit: int = 5, least: int = 1) -> DataFrame:
    """Names of a concept other than its representative, in order, up to ``limit``; concepts with fewer than ``least`` go."""
    others = F.filter("synonyms", lambda s: s != F.col("representative_name"))
    out = synonyms.withColumn("pseudo_queries", F.slice(others, 1, limit))
    return out.withColumn("num_pseudo_queries", F.size("pseudo_queries")).where(F.col("num_pseudo_queries") >= least)


def hash_split(rows: DataFrame, key: Column, dev_fraction: float) -> DataFrame:
    """split = dev where the key's hash lies below the fraction (clamped to [0, 0.5]), else train.

    With a positive fraction at least one row is dev: the one of the least hash.
    """
    fraction = min(0.5, max(0.0, dev_fraction))
    out = rows.withColumn("_h", unit_hash(key))
    if fraction == 0:
        return out.drop("_h").withColumn("split", F.lit("train"))
    least = out.agg(F.min("_h").alias("_least"))
    out = out.join(F.broadcast(least), how="cross")  # one row
    return out.withColumn("split", F.when((F.col("_h") < fraction) | (F.col("_h") == F.col("_least")), "dev").otherwise("train")).drop("_h", "_least")


def pretrain_queries(concepts: DataFrame) -> DataFrame:
    """(query_id, query_text, CUI, semantic_type, split): one row per pseudo-query."""
    return concepts.select("CUI", "semantic_type", "split", F.posexplode("pseudo_queries").alias("n", "query_text")).select(
        F.concat_ws("|", "semantic_type", "CUI", F.col("n").cast("string")).alias("query_id"), "query_text", "CUI", "semantic_type", "split"
    )


def pretrain_pairs(queries: DataFrame, candidates: DataFrame, texts: DataFrame, negatives: int) -> DataFrame:
    """One positive (rank 0) per query and its first ``negatives`` distinct wrong concepts, with their texts.

    queries (query_id, query_text, CUI, semantic_type, split), candidates (query_id, rank, CUI,
    score), texts (CUI, semantic_type, candidate_text).
    """
    gold = queries.withColumnRenamed("CUI", "gold_cui")
    wrong = gold.join(candidates.select("query_id", "rank", F.col("CUI").alias("candidate_cui"), "score"), "query_id").where("candidate_cui <> gold_cui")
    wrong = wrong.withColumn("_f", F.row_number().over(Window.partitionBy("query_id", "candidate_cui").orderBy("rank"))).where("_f = 1")
    wrong = wrong.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_n") <= negatives)
    columns = ["query_id", "query_text", "gold_cui", "candidate_cui", "semantic_type", "split", "label", "candidate_rank", "retriever_score"]
    wrong = wrong.withColumns({"label": F.lit(0), "candidate_rank": F.col("rank"), "retriever_score": F.col("score")}).select(columns)
    right = gold.withColumns({"candidate_cui": F.col("gold_cui"), "label": F.lit(1), "candidate_rank": F.lit(0), "retriever_score": F.lit(None).cast("double")}).select(columns)
    return right.unionByName(wrong).join(texts.withColumnRenamed("CUI", "candidate_cui"), ["candidate_cui", "semantic_type"])


def pair_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("split").agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_pairs"), F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(F.col("label") == 0).alias("n_negative"))


def negative_share(pairs: DataFrame) -> DataFrame:
    """Share of queries with a negative at all."""
    return pairs.groupBy("query_id").agg(F.max((F.col("label") == 0).cast("double")).alias("has")).agg(F.round(F.avg("has"), 6).alias("hit_rate"))


def random_pair_estimate(concepts: DataFrame, negatives: int, bytes_per_pair: int = 512) -> DataFrame:
    """Pairs per type if each query drew random negatives, and their bytes."""
    by = concepts.groupBy("semantic_type").agg(F.sum("num_pseudo_queries").alias("n_queries"), F.count("*").alias("n_concepts"))
    out = by.withColumn("n_pairs", F.col("n_queries") * (1 + F.least(F.lit(negatives), F.greatest(F.lit(0), F.col("n_concepts") - 1))))
    return out.withColumn("n_bytes", F.col("n_pairs") * bytes_per_pair)


# --- retriever ------------------------------------------------------------------------------------


def dense_pairs(mentions: DataFrame, vocab: DataFrame) -> DataFrame:
    """(mention_text, concept_name, CUI, entity_type): distinct mentions with every name of their concept."""
    m = mentions.select(F.col("text").alias("mention_text"), F.col("UMLS_CUI").alias("CUI"), "entity_type").dropna().where("mention_text <> '' and CUI <> 'CUILESS'").distinct()
    v = vocab.select("concept_name", "CUI", F.col("semantic_type").alias("entity_type")).dropna().where("concept_name <> ''").distinct()
    return m.join(v, ["CUI", "entity_type"]).select("mention_text", "concept_name", "CUI", "entity_type")


def hard_negatives(pairs: DataFrame, candidates: DataFrame, n: int, skip: int = 0) -> DataFrame:
    """pairs with hard_negatives, ``n`` texts: the first candidates of other concepts and other text.

    pairs (pair_id, mention_text, concept_name, CUI), candidates (pair_id, rank, CUI, name).  The
    first ``skip`` usable names are passed over and not used later either; too few names repeat the
    last; with none the array is null.
    """
    usable = pairs.join(candidates.select("pair_id", "rank", F.col("CUI").alias("_c"), "name"), "pair_id")
    usable = usable.where("_c <> CUI and name is not null")
    usable = usable.withColumn("_key", caseless("name")).where((F.col("_key") != caseless("mention_text")) & (F.col("_key") != caseless("concept_name")))
    usable = usable.withColumn("_t", F.row_number().over(Window.partitionBy("pair_id", "_key").orderBy("rank"))).where("_t = 1")
    usable = usable.withColumn("_p", F.row_number().over(Window.partitionBy("pair_id").orderBy("rank"))).where((F.col("_p") > skip) & (F.col("_p") <= skip + n))
    lists = usable.groupBy("pair_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "name"))), lambda x: x["name"]).alias("_l"))
    padded = F.concat("_l", F.array_repeat(F.element_at("_l", -1), n - F.size("_l")))
    return pairs.join(lists, "pair_id", "left").withColumn("hard_negatives", padded).drop("_l")


def example_text_keys(examples: DataFrame) -> DataFrame:
    """examples with text_keys: the distinct non-empty texts of the raw mention (else the mention) and the concept name."""
    mention = "raw_mention_text" if "raw_mention_text" in examples.columns else "mention_text"
    texts = F.array(*[F.col(c).cast("string") for c in (mention, "concept_name") if c in examples.columns])
    return examples.withColumn("text_keys", F.array_distinct(F.filter(texts, lambda t: t.isNotNull() & (t != ""))))


def batch_layout(examples: DataFrame, batch_size: int, seed: int = 42, key: str = "CUI", row_id: str = "row_id") -> DataFrame:
    """examples with round and batch: each concept gives one row per round, rounds are cut in batches.

    Order within a round follows a hash of the seed, so the layout is the same for any partitioning.
    A batch lies within one round and so never holds a concept twice.
    """
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")), 256)
    out = examples.withColumn("_h", h)
    out = out.withColumn("round", F.row_number().over(Window.partitionBy(key).orderBy("_h", row_id)))
    # A round may hold every concept: ranks are local to a hash prefix, and prefixes are in order.
    out = out.withColumn("_b", F.substring("_h", 1, 2))
    counts = out.groupBy("round", "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("round").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("round", "_b", F.coalesce(before, F.lit(0)).alias("_base"))
    at = F.row_number().over(Window.partitionBy("round", "_b").orderBy("_h", row_id)) - 1
    out = out.join(base, ["round", "_b"]).withColumn("_at", F.col("_base") + at)
    out = out.withColumn("batch", F.expr(f"cast(_at div {batch_size} as int)")).drop("_b", "_base", "_at")
    return out.drop("_h")


# --- reranker -------------------------------------------------------------------------------------


def listwise(mentions: DataFrame, candidates: DataFrame, gold_texts: DataFrame, k: int) -> DataFrame:
    """(row_id, query, docs, labels): k candidates per mention; where the right one is missing it takes the last place.

    mentions (row_id, query, gold_cui), candidates (row_id, rank, CUI, text), gold_texts (CUI,
    text).  The gold text is the one of least hash of (row, text).  Mentions whose concept has no
    text and no candidate are dropped, as are those without candidates.
    """
    lists = candidates.where(F.col("rank") <= k).join(mentions.select("row_id", "gold_cui"), "row_id")
    docs = lists.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text", (F.col("CUI") == F.col("gold_cui")).cast("double").alias("label")))).alias("d"))
    out = mentions.join(docs, "row_id")
    missing = out.where(~F.exists("d", lambda x: x["label"] > 0)).select("row_id", "gold_cui")
    gold = missing.join(gold_texts.withColumnRenamed("CUI", "gold_cui"), "gold_cui")
    gold = gold.groupBy("row_id").agg(F.min_by("text", F.sha2(F.concat_ws("|", F.col("row_id").cast("string"), "text"), 256)).alias("_g"))
    out = out.join(gold, "row_id", "left").where(F.exists("d", lambda x: x["label"] > 0) | F.col("_g").isNotNull())
    n = F.size("d")
    last = lambda own, new: F.when(F.col("_g").isNotNull(), F.concat(F.slice(own, F.lit(1), F.greatest(F.lit(0), n - 1)), F.array(new))).otherwise(own)
    texts, labels = F.transform("d", lambda x: x["text"]), F.transform("d", lambda x: x["label"])
    return out.select("row_id", "query", last(texts, F.col("_g")).alias("docs"), last(labels, F.lit(1.0)).alias("labels"))


def pairwise(lists: DataFrame) -> DataFrame:
    """(row_id, query, rank, doc, label): one row per document of a list."""
    return lists.select("row_id", "query", F.posexplode(F.arrays_zip("docs", "labels")).alias("_n", "_z")).select("row_id", "query", (F.col("_n") + 1).alias("rank"), F.col("_z.docs").alias("doc"), F.col("_z.labels").alias("label"))


def positive_weight(pairs: DataFrame) -> DataFrame:
    """Negatives per positive; 1 without positives."""
    pos, neg = F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)
    return pairs.agg(F.round(F.when(pos > 0, neg / pos).otherwise(1.0), 6).alias("pos_weight"))


# --- rerank ---------------------------------------------------------------------------------------


def rerank(candidates: DataFrame, score: Column, k: int, query: list[str]) -> DataFrame:
    """Candidates ordered by a scorer's column, then by the retriever's score; ``score`` may be an Arrow UDF of a model."""
    scored = candidates.withColumn("rerank_score", F.round(score, 6))
    w = Window.partitionBy(*query).orderBy(F.desc("rerank_score"), F.desc("score"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k)


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def lexical_top_k(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, CUI, text, score): each query's k texts of its type with the highest :func:`lexical_score`.

    queries (query_id, query_text, semantic_type), texts (CUI, semantic_type, text), both without
    repeats.  Ties go to the smaller concept, then text.  Only texts that share a word with the query
    are scored; where they are fewer than k, the first texts of the type follow at score 0: those a
    query lacks lie among the first 2 k.
    """
    asked = queries.select("query_id", "semantic_type", _words(F.col("query_text")).alias("w"))
    asked = asked.select("query_id", "semantic_type", F.size("w").alias("size"), F.explode("w").alias("word"))
    held = texts.select("semantic_type", "CUI", "text", F.explode(_words(F.col("text"))).alias("word"))
    found = asked.join(held, ["semantic_type", "word"]).groupBy("query_id", "CUI", "text").agg(F.round(F.count("*") / F.max("size"), 6).alias("score"))
    best = top_k(found.withColumn("item", F.struct("CUI", "text")), k, ["query_id"], item="item")
    lack = queries.select("query_id", "semantic_type").join(best.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").where(F.coalesce("have", F.lit(0)) < k)
    first = texts.withColumn("at", F.row_number().over(Window.partitionBy("semantic_type").orderBy("CUI", "text"))).where(F.col("at") <= 2 * k)
    fill = lack.join(first, "semantic_type").select("query_id", F.struct("CUI", "text").alias("item")).join(best.select("query_id", "item"), ["query_id", "item"], "left_anti")
    both = best.select("query_id", "item", "score").unionByName(fill.withColumn("score", F.lit(0.0)))
    return top_k(both, k, ["query_id"], item="item").select("query_id", "rank", "item.CUI", "item.text", "score")


def lexical_score(left: Column, right: Column) -> Column:
    """Share of the query's words that a text holds: a scorer that needs no model."""
    a, b = _words(left), _words(right)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def with_matched_alias(text: Column, alias: Column) -> Column:
    """The candidate's text led by the alias that matched, unless it is the text or one of its parts."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: caseless(F.trim(p)))
    blank = F.coalesce(F.trim(alias), F.lit("")) == ""
    return F.when(blank | F.array_contains(parts, caseless(F.trim(alias))), text).when(F.coalesce(text, F.lit("")) == "", alias).otherwise(F.concat(alias, F.lit("; "), text))


def candidate_texts(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """candidates (CUI, entity_type, name, ...) with candidate_text: the profile led by the matched name, or the name where no profile is known.

    ``texts`` holds one (CUI, semantic_type, candidate_text) per concept and type.
    """
    known = texts.select(F.col("CUI"), F.col("semantic_type").alias("entity_type"), F.col("candidate_text").alias("_t"))
    joined = candidates.join(known, ["CUI", "entity_type"], "left")
    return joined.withColumn("candidate_text", F.when(F.col("_t").isNull(), F.col("name")).otherwise(with_matched_alias(F.col("_t"), F.col("name")))).drop("_t")
