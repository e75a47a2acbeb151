"""Search over sparse parameters, text keys, descriptions and the last gold row."""

from __future__ import annotations

import json

import pytest

from termweave.operators.metrics import ranking_metrics
from termweave.operators.profiles import profile_languages
from termweave.operators.training import candidate_texts, example_text_keys
from termweave.operators.tuning import best_parameters, parameter_grid, search_parameters, valid_parameters
from termweave.sources.store import config_key, list_description


def test_grid_leaves_out_impossible_ranges():
    assert parameter_grid({"min_ngram": [2, 4], "dense_weight": [0.1], "max_ngram": [3, 5]}) == [{"min_ngram": 2, "max_ngram": 3}, {"min_ngram": 2, "max_ngram": 5}, {"min_ngram": 4, "max_ngram": 5}]
    assert valid_parameters({"b": 1}) and not valid_parameters({"min_ngram": "5", "max_ngram": "4"})


def test_search_evaluates_each_combination(spark):
    lists = "query_id long, item_id long, score double"
    dense = spark.createDataFrame([(1, 10, 1.0), (1, 11, 0.5), (2, 10, 0.9), (2, 12, 0.2)], lists)
    keys = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c")], "item_id long, key string")
    gold = spark.createDataFrame([(1, "b"), (2, "c"), (3, "a")], "query_id long, gold string")

    def sparse(p):
        return spark.createDataFrame([(1, 11, float(p["b"])), (2, 10, 1.0), (2, 12, 2.0 * p["b"])], lists)

    choices = {"b": [0, 1], "dense_weight": [0.0, 1.0]}
    rows = {(json.loads(r["parameters"])["b"], r["dense_weight"]): (r["n_queries"], r["acc_1"], r["mrr"]) for r in search_parameters(dense, sparse, keys, gold, choices, 5).collect()}
    # With b = 1 the sparse side alone puts b and c first; query 3 has no list.
    assert rows[(1, 0.0)] == (3, 0.666667, 0.666667) and rows[(0, 1.0)] == rows[(1, 1.0)] == (3, 0.0, 0.333333)
    best = best_parameters(search_parameters(dense, sparse, keys, gold, choices, 5)).first()
    assert (best["parameters"], best["dense_weight"]) == ('{"b": 1}', 0.0)
    with pytest.raises(ValueError):
        search_parameters(dense, sparse, keys, gold, {"min_ngram": [3], "max_ngram": [2], "dense_weight": [0.0]}, 5)


def test_last_gold_row_counts(spark):
    predictions = spark.createDataFrame([(1, 1, "a")], "query_id long, rank int, prediction string")
    gold = spark.createDataFrame([(1, "z", 1), (1, "a", 2)], "query_id long, gold string, at int")
    assert ranking_metrics(predictions, gold, order="at").first()["acc_1"] == 1.0
    assert ranking_metrics(predictions, gold).first()["acc_1"] == 0.0


def test_text_keys(spark):
    df = spark.createDataFrame([("m", "c", "r"), ("x", "x", "x"), ("m", None, "")], "mention_text string, concept_name string, raw_mention_text string")
    assert [r["text_keys"] for r in example_text_keys(df).collect()] == [["r", "c"], ["x"], []]
    assert [r["text_keys"] for r in example_text_keys(df.drop("raw_mention_text")).collect()] == [["m", "c"], ["x"], ["m"]]


def test_descriptions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    one = list_description(df, df, ["name"], topk=5, split="dev")
    assert one == list_description(df.orderBy("name", ascending=False), df, ["name"], split="dev", topk=5)
    assert one != list_description(df, df.limit(1), ["name"], topk=5, split="dev")
    assert config_key({"a": 1, "b": 2}) == config_key({"b": 2, "a": 1}) != config_key({"a": 2, "b": 2})
    assert profile_languages("en") == (["ENG", "RUS"], ["ENG"]) and profile_languages("ru")[1] == []


def test_candidate_texts(spark):
    rows = spark.createDataFrame([("C1", "D", "ache"), ("C1", "D", "Pain"), ("C2", "D", "lone"), ("C1", "X", "other")], "CUI string, entity_type string, name string")
    texts = spark.createDataFrame([("C1", "D", "pain; dolor")], "CUI string, semantic_type string, candidate_text string")
    got = {(r["entity_type"], r["name"]): r["candidate_text"] for r in candidate_texts(rows, texts).collect()}
    assert got == {("D", "ache"): "ache; pain; dolor", ("D", "Pain"): "pain; dolor", ("D", "lone"): "lone", ("X", "other"): "other"}
