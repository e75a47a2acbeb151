"""Operators on fixtures with one trap each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.operators import context, metrics, profiles, ranking, sparse, training, vocabulary
from termweave.operators.dense import dense_top_k
from termweave.operators.fusion import fuse, fusion_pool
from termweave.sources.readers import read_documents, read_entities
from termweave.sources.store import ArtifactStore, fingerprint


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_top_k_ties_go_to_the_smaller_item(spark):
    df = spark.createDataFrame([(1, 9, 0.5), (1, 2, 0.5), (1, 5, 0.9)], "query_id int, item_id int, score double")
    assert [(r["item_id"], r["rank"]) for r in ranking.top_k(df, 2, ["query_id"]).orderBy("rank").collect()] == [(5, 1), (2, 2)]


def test_overfetch_then_dedup_can_lose_keys(spark):
    df = spark.createDataFrame([(1, i, 1.0 - i / 100, "a" if i < 8 else "b") for i in range(10)], "query_id int, item_id int, score double, key string")
    cut = ranking.first_per_key(ranking.top_k(df, ranking.retrieval_depth(2, 10, True), ["query_id"]), 2, ["query_id"], "key")
    whole = ranking.first_per_key(ranking.top_k(df, 10, ["query_id"]), 2, ["query_id"], "key")
    assert [r["key"] for r in cut.collect()] == ["a"]
    assert rows(whole.select("rank", "key"), "rank") == [(1, "a"), (2, "b")]


def test_padding_repeats_the_last(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id int, rank int, prediction string")
    assert rows(ranking.pad_to(df, 4, ["query_id"]).select("rank", "prediction"), "rank") == [(1, "a"), (2, "b"), (3, "b"), (4, "b")]


@pytest.mark.parametrize(("scores", "want"), [([2.0, 2.0], [1.0, 1.0]), ([0.0, 0.0], [0.0, 0.0]), ([-1.0, -1.0], [0.0, 0.0]), ([1.0, 3.0], [0.0, 1.0])])
def test_minmax_flat_lists(spark, scores, want):
    df = spark.createDataFrame([(1, float(s)) for s in scores], "q int, s double")
    assert [r[0] for r in df.select("s", ranking.minmax(F.col("s"), ["q"]).alias("n")).orderBy("s").select("n").collect()] == want


def test_dense_blocks_equal_one_block(spark):
    rng = np.random.RandomState(0)
    v = rng.randn(60, 8)
    items = spark.createDataFrame([("a" if i % 3 else "b", i, v[i].tolist()) for i in range(60)], "type string, item_id long, v array<double>")
    queries = items.where("item_id < 20").withColumnRenamed("item_id", "query_id")
    one = rows(dense_top_k(queries, items, 3, skip_self=True), "query_id", "rank")
    many = rows(dense_top_k(queries, items, 3, skip_self=True, query_block=4, item_block=7), "query_id", "rank")
    assert one == many and len(one) == 60
    for _, q, i, s, r in one:
        same = [j for j in range(60) if (j % 3 > 0) == (q % 3 > 0) and j != q]
        best = sorted(((-round(float(v[q] @ v[j]), 6), j) for j in same))[r - 1]
        assert (i, s) == (best[1], -best[0])


def test_dense_without_items_of_a_type(spark):
    q = spark.createDataFrame([("x", 1, [1.0]), (None, 2, [1.0])], "type string, query_id long, v array<double>")
    i = spark.createDataFrame([("y", 1, [1.0]), (None, 2, [1.0])], "type string, item_id long, v array<double>")
    assert dense_top_k(q, i, 2).count() == 0


def test_bm25_fills_with_zero_scores(spark):
    items = spark.createDataFrame([(3, "alpha"), (1, "beta"), (2, "gamma gamma"), (4, "")], "item_id long, text string")
    queries = spark.createDataFrame([(1, "zeta"), (2, "gamma gamma Gamma"), (3, None)], "query_id long, text string")
    got = rows(sparse.bm25_top_k(sparse.bm25_index(items), queries, items, 2).select("query_id", "rank", "item_id", "score"), "query_id", "rank")
    assert [g[:3] for g in got] == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (3, 1, 1), (3, 2, 2)]
    assert got[0][3] == 0.0 and got[2][3] > 0


def test_tfidf_against_plain_python(spark):
    import math
    from collections import Counter

    texts = {1: "abc abd", 2: "abd", 3: "zzz", 4: "a"}
    grams = lambda t: Counter(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1))
    df = Counter(g for t in texts.values() for g in grams(t))
    idf = {g: math.log((1 + len(texts)) / (1 + c)) + 1 for g, c in df.items()}

    def vec(t):
        w = {g: c * idf[g] for g, c in grams(t).items() if g in idf}
        n = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / n for g, x in w.items()} if n else {}

    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    q = spark.createDataFrame([(1, "xabd")], "query_id long, text string")
    got = dict(rows(sparse.tfidf_scores(sparse.tfidf_index(items, 2, 3), q).select("item_id", "score"), "item_id"))
    a = vec("xabd")
    want = {i: round(sum(a.get(g, 0) * x for g, x in vec(t).items()), 6) for i, t in texts.items()}
    assert got == {i: s for i, s in want.items() if s}


def test_unknown_sparse_index(spark):
    with pytest.raises(ValueError):
        sparse.build_sparse_index("other", spark.createDataFrame([(1, "a")], "item_id long, text string"))


def test_fusion_weight_one_is_the_dense_order(spark):
    dense = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5)], "query_id long, item_id long, score double")
    lexical = spark.createDataFrame([(1, 3, 7.0), (1, 2, 9.0)], "query_id long, item_id long, score double")
    keys = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "item_id long, key string")
    out = fuse(fusion_pool(dense, lexical), [1.0, 0.0], keys, 5)
    assert rows(out.where("weight = 1").select("rank", "key", "item_id"), "rank") == [(1, "a", 1), (2, "b", 2)]
    assert rows(out.where("weight = 0").select("rank", "key", "item_id"), "rank") == [(1, "b", 2), (2, "a", 1)]


def test_metrics_denominator_and_cutoffs(spark):
    p = spark.createDataFrame([("q1", 1, "x"), ("q1", 2, "a"), ("q2", 1, "b")], "query_id string, rank int, prediction string")
    g = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "c"), ("q4", None), ("q5", "CUILESS")], "query_id string, gold string")
    r = metrics.ranking_metrics(p, metrics.without_unlinkable(g)).first()
    assert (r["n_queries"], r["acc_1"], r["acc_5"], r["mrr"]) == (4, 0.25, None, 0.375)


def test_nested_context(spark):
    m = spark.createDataFrame(
        [("d", "0-20", 0, 20, "whole"), ("d", "5-10", 5, 10, "in"), ("d", "5-30", 5, 30, "right"), ("d", "5-6,9-10", 5, 10, "gap"), ("e", "5-10", 5, 10, "alone")],
        "document_id string, spans string, start int, stop int, text string",
    )
    got = {(r[0], r[1]): (r[2], r[3]) for r in context.enclosing_mentions(m, bucket=4).collect()}
    assert got[("d", "5-10")] == ("whole", "right")
    assert got[("d", "5-6,9-10")] == ("whole", "right")
    assert got[("d", "0-20")] == (None, None)
    assert got[("d", "5-30")] == (None, None)
    assert got[("e", "5-10")] == (None, None)


def test_nested_context_prefers_one_copy(spark):
    m = spark.createDataFrame([("d", "0-9", 0, 9, "o"), ("d", "3-5", 3, 5, "i")], "document_id string, spans string, start int, stop int, text string")
    assert {r[1]: (r[2], r[3]) for r in context.enclosing_mentions(m).collect()}["3-5"] == (None, "o")


def test_enrichment(spark):
    v = spark.createDataFrame([("heart", "C1", "ANAT", "ENG"), (None, "C9", "ANAT", None)], "concept_name string, CUI string, semantic_type string, lang string")
    e = spark.createDataFrame([("heart", "C1", "ANAT"), ("cor", "C1", "ANAT"), ("lung", "C2", "ANAT"), ("lung", "C2", "ANAT"), ("x", "CUILESS", "ANAT"), ("", "C3", "ANAT"), (None, "C4", "ANAT")], "text string, UMLS_CUI string, entity_type string")
    assert rows(vocabulary.enrichment_rows(v, e, True, "EN"), "concept_name") == [("lung", "C2", "ANAT", "EN")]
    assert [r[0] for r in rows(vocabulary.enrichment_rows(v, e, False), "concept_name")] == ["cor", "lung"]
    # without a language the English filter drops what was added
    assert vocabulary.filter_language(vocabulary.enrich(v, e, False), "en").count() == 1


def test_profiles(spark):
    data = [
        (1, "Heart attack", "C1", "DISO", "EN"),
        (2, "heart  attack", "C1", "DISO", "EN"),
        (3, "MI", "C1", "DISO", "EN"),
        (4, "Myocardial infarction (disorder)", "C1", "DISO", "EN"),
        (5, "Инфаркт миокарда", "C1", "DISO", "RU"),
        (6, "infarct, NOS", "C1", "DISO", "EN"),
        (7, "y " * 200, "C2", "DISO", None),
    ]
    v = spark.createDataFrame(data, "item_id long, concept_name string, CUI string, semantic_type string, lang string")
    got = {r["CUI"]: r for r in profiles.concept_profiles(v, ["ENG", "RUS"]).collect()}
    one = got["C1"]
    assert one["representative_name"] == "Heart attack"
    assert (one["num_aliases_raw"], one["num_noisy_removed"], one["num_duplicates_removed"], one["num_aliases_kept"]) == (6, 1, 1, 4)
    assert one["candidate_text"].startswith("heart attack; mi") and "инфаркт миокарда" in one["candidate_text"]
    assert one["languages"] == ["ENG", "RUS"]
    assert got["C2"]["num_long_removed"] == 1 and got["C2"]["num_aliases_kept"] == 1


def test_profiles_limit_and_leftovers(spark):
    names = ["alpha beta gamma", "alpha beta delta", "omega sigma kappa", "alpha beta epsilon", "iota theta zeta", "one two three"]
    v = spark.createDataFrame([(i, n, "C", "T", "EN") for i, n in enumerate(names)], "item_id long, concept_name string, CUI string, semantic_type string, lang string")
    r = profiles.concept_profiles(v, ["ENG"], most=5, limits={"multi_word": 2}).first()
    assert r["selected_alias_count"] == 5 and len(r["candidate_text"].split("; ")) == 3


def test_hash_split(spark):
    df = spark.createDataFrame([(f"c{i}",) for i in range(50)], "k string")
    assert training.hash_split(df, F.col("k"), 0).where("split = 'dev'").count() == 0
    small = training.hash_split(df.limit(1), F.col("k"), 0.001)
    assert [r["split"] for r in small.collect()] == ["dev"]
    assert training.hash_split(df, F.col("k"), 0.9).where("split = 'dev'").count() == training.hash_split(df, F.col("k"), 0.5).where("split = 'dev'").count()


def test_hard_negatives(spark):
    pairs = spark.createDataFrame([("p", "mi", "heart attack", "C1"), ("q", "a", "b", "C2")], "pair_id string, mention_text string, concept_name string, CUI string")
    c = spark.createDataFrame([("p", 1, "C1", "other"), ("p", 2, "C3", "MI"), ("p", 3, "C4", "skip"), ("p", 4, "C5", "SKIP"), ("p", 5, "C6", "use")], "pair_id string, rank int, CUI string, name string")
    got = {r["pair_id"]: r["hard_negatives"] for r in training.hard_negatives(pairs, c, 2, skip=1).collect()}
    assert got == {"p": ["use", "use"], "q": None}


def test_listwise_inserts_gold(spark):
    m = spark.createDataFrame([(1, "a", "G"), (2, "b", "G"), (3, "c", "NONE")], "row_id long, query string, gold_cui string")
    c = spark.createDataFrame([(1, 1, "X", "x"), (1, 2, "G", "g"), (2, 1, "X", "x"), (2, 2, "Y", "y"), (3, 1, "X", "x")], "row_id long, rank int, CUI string, text string")
    g = spark.createDataFrame([("G", "gold")], "CUI string, text string")
    lists = training.listwise(m, c, g, 2)
    assert rows(lists.select("row_id", "docs", "labels"), "row_id") == [(1, ["x", "g"], [0.0, 1.0]), (2, ["x", "gold"], [0.0, 1.0])]
    assert training.pairwise(lists).count() == 4


def test_batches_never_repeat_a_concept(spark):
    df = spark.createDataFrame([(i, f"c{i % 7}") for i in range(60)], "row_id long, CUI string")
    out = training.batch_layout(df, 4)
    assert out.groupBy("round", "batch").agg((F.count("*") - F.countDistinct("CUI")).alias("d"), F.count("*").alias("n")).where("d > 0 or n > 4").count() == 0
    assert out.count() == 60


def test_store_reuses_deeper_lists(spark, tmp_path):
    built = []

    def build(depth):
        def run():
            built.append(depth)
            return spark.range(1, depth + 1).withColumnRenamed("id", "rank")

        return run

    store = ArtifactStore(spark, str(tmp_path))
    assert store.get("l", {"a": 1}, build(10), 10).count() == 10
    assert store.get("l", {"a": 1}, build(4), 4).count() == 4
    assert store.get("l", {"a": 1}, build(12), 12).count() == 12
    assert store.get("l", {"a": 2}, build(4), 4).count() == 4
    assert built == [10, 12, 4]


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    assert fingerprint(a) == fingerprint(a.orderBy(F.desc("i"))) != fingerprint(a.where("i = 1"))


def test_readers(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("document_id\ttext\tspans\n1_en\tfoo \"bar\t0-3\n")
    r = read_entities(spark, str(tmp_path / "e.tsv")).first()
    assert (r["text"], r["spans"], r["UMLS_CUI"]) == ('foo "bar', "0-3", None)
    d = tmp_path / "texts" / "en" / "dev"
    d.mkdir(parents=True)
    (d / "7_en.txt").write_text("line one\nline two")
    r = read_documents(spark, str(tmp_path / "texts")).first()
    assert (r["document_id"], r["language"], r["split"], r["document_text"]) == ("7_en", "en", "dev", "line one\nline two")
