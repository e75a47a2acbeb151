"""Block-wise retrieval against plain loops, with small blocks and odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termweave.operators import sparse, sparse_blocks
from termweave.operators.best import Best
from termweave.operators.dense import ROWS, _block_top


@pytest.fixture()
def tables(spark, monkeypatch):
    """60 texts, one id on two rows, one without words, one null; 9 queries, one id on two rows; four blocks and more."""
    rng = random.Random(5)
    words = [f"w{int(30 * rng.random() ** 2)}" for _ in range(4000)]
    texts = [(i if i != 41 else 40, " ".join(rng.sample(words, rng.randrange(1, 30)))) for i in range(58)] + [(58, ""), (59, None)]
    queries = [(i % 8, " ".join(rng.sample(words, 4))) for i in range(9)] + [(9, "nothing")]
    monkeypatch.setattr(sparse_blocks, "ROWS", 16)
    return texts, queries, spark.createDataFrame(texts, "item_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")


def filled(scores, queries, ids, k):
    out = []
    for q in sorted({q for q, _ in queries}):
        have = scores.get(q, {})
        lists = have if len(have) >= k else {**{i: 0.0 for i in sorted(ids)}, **have}
        out += [(q, r, i, s) for r, (s, i) in enumerate(sorted(((s, i) for i, s in lists.items()), key=lambda x: (-x[0], x[1]))[:k], 1)]
    return out


def got(df):
    return [tuple(r) for r in df.select("query_id", "rank", "item_id", "score").orderBy("query_id", "rank").collect()]


def close(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(a, b))


def test_bm25_in_blocks(spark, tables):
    texts, queries, items, asked = tables
    size = [len(re.findall(r"\w+", t or "")) for _, t in texts]
    average = sum(size) / len(size)
    tf = defaultdict(Counter)
    for i, t in texts:
        tf[i].update(re.findall(r"\w+", t or ""))
    df = Counter(w for c in tf.values() for w in c)
    scores = defaultdict(dict)
    for q in {q for q, _ in queries}:
        terms = {w for p, t in queries if p == q for w in t.split()}
        for i in tf:
            s = sum(math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * tf[i][w] * 2.2 / (tf[i][w] + 1.2 * (0.75 + 0.25 * n / average)) for w in terms if tf[i][w] for (j, _), n in zip(texts, size) if j == i)
            if s:
                scores[q][i] = round(s, 6)
    index = sparse.bm25_index(items)
    found = sparse.bm25_top_k(index, asked, items, 4)
    close(got(found), filled(scores, queries, tf, 4))
    assert {r["term"]: r["df"] for r in index.df.collect()} == df
    # Postings of all texts and scores of all pairs stay within a block.
    assert "explode(regexp" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "FlatMapCoGroupsInArrow" in plan
    pairs = spark.createDataFrame([(q, i) for q in range(10) for i in (0, 3, 17, 58)], "query_id long, item_id long")
    want = {(q, i): scores[q][i] for q in range(10) for i in (0, 3, 17, 58) if i in scores[q]}
    assert {(r[0], r[1]): r[2] for r in sparse.bm25_pair_scores(index, asked, pairs).collect()} == pytest.approx(want, abs=2e-6)
    listed = pairs.withColumn("other", F.lit(7.0))
    both = sparse.ranked_or_zero(sparse.bm25_blocks(index, asked, 4, listed), asked, items, 4)
    close(got(both.where("rank <= 4")), filled(scores, queries, tf, 4))
    assert {(r["query_id"], r["item_id"]): r["score"] for r in both.where("other = 7").collect()} == pytest.approx({(q, i): want.get((q, i), 0.0) for q in {q for q, _ in queries} for i in (0, 3, 17, 58)}, abs=2e-6)


def test_tfidf_in_blocks(spark, tables):
    texts, queries, items, asked = tables
    grams = lambda t: Counter(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1))
    tf, of_query = defaultdict(Counter), defaultdict(Counter)
    for i, t in texts:
        tf[i].update(grams(t or ""))
    for q, t in queries:
        of_query[q].update(grams(t))
    df = Counter(g for c in tf.values() for g in c)
    idf = {g: math.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(c):
        v = {g: n * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    scores = defaultdict(dict)
    for q, c in of_query.items():
        a = unit(c)
        for i, d in tf.items():
            b = unit(d)
            if s := sum(x * b.get(g, 0.0) for g, x in a.items()):
                scores[q][i] = round(s, 6)
    found = sparse.tfidf_top_k(sparse.tfidf_index(items, 2, 3), asked, items, 4)
    close(got(found), filled(scores, queries, tf, 4))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "gram#" not in plan and "FlatMapCoGroupsInArrow" in plan  # n-grams of all texts don't travel
    assert {r["gram"]: r["df"] for r in sparse.tfidf_index(items, 2, 3).idf.collect()} == df


def test_grams_of_many_characters():
    texts = ["".join(chr(0x4E00 + (i * 37 + j * j) % 9000) for j in range(300)) for i in range(60)] + ["", "a\0b\0", "𝄞a𝄞b"]
    c = sparse_blocks.count_grams(1, 6)(pa.array(texts))
    want = {(r, g): n for r, t in enumerate(texts) for g, n in Counter(t[i : i + n] for n in range(1, 7) for i in range(len(t) - n + 1)).items()}
    terms = c.terms.to_pylist()
    assert {(int(r), terms[k]): int(n) for r, k, n in zip(c.row, c.code, c.n)} == want
    assert c.size.tolist() == [sum(max(0, len(t) - n + 1) for n in range(1, 7)) for t in texts]


def test_products_of_common_and_rare_terms(monkeypatch):
    monkeypatch.setattr(sparse_blocks, "QUERY_TILE", 7)
    monkeypatch.setattr(sparse_blocks, "ITEM_TILE", 11)
    rng = np.random.default_rng(0)
    a, b = (rng.random((n, 700)) * (rng.random((n, 700)) < np.linspace(0.9, 0.01, 700) ** 2) for n in (23, 40))
    parts = [(*np.nonzero(x), x[np.nonzero(x)]) for x in (a, b)]
    out = np.zeros((23, 40))
    for q, i, s in sparse_blocks.products(parts[0], 23, parts[1], 40, 700):
        out[q : q + s.shape[0], i : i + s.shape[1]] = s
    assert np.allclose(out, a @ b.T)


def test_best_with_ties_and_rounding():
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 6, (30, 500)) / 10 + rng.integers(-3, 4, (30, 500)) * 1e-8
    scores[3] = np.nan
    scores[4, 7:] = -np.inf
    best = Best(30, 5)
    for q in range(0, 30, 8):
        for i in range(0, 500, 60):
            best.add(q, i, scores[q : q + 8, i : i + 60])
    have = defaultdict(list)
    for q, i, s in zip(best.query, best.item, best.score):
        have[int(q)].append((-float(s), int(i)))
    for q in range(30):
        assert sorted(have[q]) == sorted((-round(float(s), 6), i) for i, s in enumerate(scores[q]) if s > -np.inf)[:5]


def test_a_dense_block_needs_little_memory():
    """A full block's scores are never there at once (4096 x 16384 of them would be 512 MB)."""
    import tracemalloc

    rng = np.random.default_rng(2)

    def side(n, name):
        v = pa.FixedSizeListArray.from_arrays(pa.array(rng.random(n * 8)), 8).cast(pa.list_(pa.float64()))
        return pa.table({name: pa.array(np.arange(n)), "v": v})

    queries, items = side(1024, "query_id"), side(8192, "item_id")
    tracemalloc.start()
    out = _block_top(20, True, ROWS)((pa.scalar("all"),), queries, items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 1024 * 20 and peak < 60 << 20


def test_gram_sizes_in_slices(monkeypatch):
    monkeypatch.setattr(sparse_blocks, "SLICE", 10)
    texts = ["abcabc", "", "ab", "x" * 40, "abcdefg", "aaaa"]
    out = pa.Table.from_batches(list(sparse_blocks.gram_sizes(3, 5)(iter([pa.RecordBatch.from_pydict({"id": list(range(6)), "text": texts})]))))
    grams = [[t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)] for t in texts]
    assert out.to_pydict() == {"id": list(range(6)), "n_grams": [len(g) for g in grams], "n_distinct": [len(set(g)) for g in grams]}
