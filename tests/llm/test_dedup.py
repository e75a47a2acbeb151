"""Near-duplicates, repeats, embeddings and top-k against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termweave.llm import minhash
from termweave.llm.column_bwt import collection_bwt, window_minima
from termweave.llm.components import connected_components
from termweave.llm.minhash import near_duplicates
from termweave.llm.permutation_index import _heads, embedding_near_duplicates, spread
from termweave.llm.repeats import remove_repeats
from termweave.llm.shingles import shingle_sets
from termweave.llm.voronoi_knn import top_k

WORDS = "the of and to in it is was for on are as with his they at be this from have or by one had not".split()


def find_roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def texts(n=120, seed=3):
    rng = np.random.RandomState(seed)
    out = {}
    for i in range(n):
        kind = rng.randint(5)
        if kind == 0 or not out:
            out[i] = " ".join(rng.choice(WORDS, rng.randint(1, 80)))
        elif kind == 4:
            out[i] = out[rng.choice(list(out))]
        else:
            w = out[rng.choice(list(out))].split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randint(len(w))] = str(rng.choice(WORDS)).upper()
            out[i] = "  ".join(w)
    return out | {n: "", n + 1: "  \t ", n + 2: "É", n + 3: "é", n + 4: "one TWO", n + 5: "One two", n + 6: "x " * 20000}


def test_shingle_sets_have_the_size_of_real_sets():
    t = list(texts().values())
    data = [x.encode() for x in t]
    flat, offs = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])
    for k in (1, 3, 5):
        assert [len(s) for s in shingle_sets(flat, offs, k)] == [len(shingles(x, k)) for x in t]


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80), (2, 60)])
def test_near_duplicates_equal_brute_force(spark, k, num):
    t = texts()
    df = spark.createDataFrame([(i, x, 7) for i, x in t.items()], "doc_id long, text string, component_id int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, k, num, 100).collect()}
    sets = {i: shingles(x, k) for i, x in t.items()}
    links = [(a, b) for a in t for b in t if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    roots = find_roots(t, links)
    assert got == {i: (len(sets[i]), roots[i], roots[i] == i) for i in t}


def test_near_duplicates_edges(spark):
    long = " ".join(WORDS)
    df = spark.createDataFrame([(5, long), (5, long), (None, long), (9, None), (7, long), (7, "other words here entirely"), (8, "other words here entirely")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    n = len(shingles(long, 3))
    assert got == sorted([(5, n, 5, True), (5, n, 5, True), (-1, n, None, False), (9, 0, 9, True), (7, n, 5, False), (7, 2, 5, False), (8, 2, 5, False)])
    assert near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_an_id_with_several_texts(spark):
    rng = np.random.RandomState(2)
    one = " ".join(f"w{i}" for i in range(60))
    rows = [(1, one), (2, one + " tail"), (2, " ".join(f"z{i}" for i in rng.permutation(400))), (3, " ".join(f"y{i}" for i in range(50)))]
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)}


def test_texts_that_share_no_bucket_are_left_out_before_they_move(spark, monkeypatch):
    rows = spark.range(-5000, 5000).select(F.col("id").alias("doc"), F.lit("t").alias("t")).unionAll(spark.createDataFrame([(None, "t"), (7, "u")], "doc long, t string"))
    wanted = spark.createDataFrame([(i,) for i in (-5000, -1, 0, 7, 7, 4999, 9999)], "doc long")
    found = [(r["doc"], r["t"]) for r in minhash.likely(rows, wanted).collect()]
    assert {(-5000, "t"), (-1, "t"), (0, "t"), (7, "t"), (7, "u"), (4999, "t")} <= set(found) and len(found) < 12
    full = minhash.likely(rows, rows.where("doc is not null"), bits=6).collect()  # every bit is set
    assert len([r for r in full if r["doc"] is not None]) == 10_001
    assert minhash.likely(rows, wanted.limit(0)).count() == 0

    asked = []
    real = minhash.likely
    monkeypatch.setattr(minhash, "likely", lambda rows, wanted: asked.append(real(rows, wanted).count()) or real(rows, wanted))
    docs = [(i, f"only {i} has these words {i * i} and {i + 500} too {i % 7}") for i in range(200)] + [(900, "a copy but for its end " * 9), (901, "a copy but for its end " * 9 + "x")]
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {i: i for i, _ in docs} | {901: 900} and len(asked) == 1 and 2 <= asked[0] < 100


def test_histograms_are_short_and_left_out_where_they_do_not_fit(monkeypatch):
    monkeypatch.setattr(minhash, "MOST", 2)
    texts = pa.array(["a b c d", " ".join(map(str, range(2000))), "", None])
    (out,) = minhash._sets(3)(iter([pa.record_batch([pa.array([1, 2, 3, 4]), texts], ["doc", "t"])]))
    assert out.schema.field("bins").type == pa.list_(pa.int16())
    assert [b if b is None else sum(b) for b in out.column("bins").to_pylist()] == [2, None, 0, 0] and len(out.column("shingles")[1]) == 1998


def test_components(spark):
    rng = np.random.RandomState(1)
    for n, m in ((50, 20), (50, 60), (30, 29)):
        e = rng.randint(0, n, (m, 2)) if m != 29 else np.stack([np.arange(29), np.arange(1, 30)], 1)
        df = spark.createDataFrame([(int(a), int(b)) for a, b in e] + [(None, 1), (3, 3)], "u long, v long")
        want = find_roots(range(n), e.tolist())
        got = {r["node"]: r["component"] for r in connected_components(df).collect()}
        assert got == {x: r for x, r in want.items() if r != x}


def test_bwt_of_a_collection():
    rng = np.random.RandomState(0)
    for trial in range(40):
        strings = [bytes(rng.choice([97, 98, 99] if trial % 2 else [97], rng.randint(1, 20)).astype(np.uint8)) for _ in range(rng.randint(1, 9))]
        flat, size = np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings)))
        bwt, lcp = collection_bwt(flat, size, 6)
        order = sorted((([x + 1 for x in s[i:]] + [-1], k, i) for k, s in enumerate(strings) for i in range(len(s) + 1)))
        assert bwt.tolist() == [strings[k][i - 1] + 1 if i else 0 for _, k, i in order]
        owner = rng.randint(0, 50, len(strings))
        want = [min(owner[j] for j, t in enumerate(strings) if s[i : i + 3] in t) for s in strings for i in range(len(s) - 2)]
        assert window_minima(flat, size, owner, 3).tolist() == want
        assert lcp.max(initial=0) <= 6


def brute_repeats(docs, n=50):
    first: dict[bytes, int] = {}
    for i, t in docs:
        b = (t or "").encode()
        if i is not None:
            for a in range(len(b) - n + 1):
                w = b[a : a + n]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for a in range(len(b) - n + 1):
                if first[b[a : a + n]] < i:
                    gone[a : a + n] = True
        edge = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0)).reshape(-1, 2)
        out.append((i, len(b), [tuple(e) for e in edge.tolist()], bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("hot", [1 << 16, 1, 6])
def test_repeats_equal_brute_force(spark, hot):
    rng = np.random.RandomState(5)
    base = [" ".join(rng.choice(WORDS, 60)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            b = base[rng.randint(6)]
            a = rng.randint(len(b))
            parts += [b[a : a + rng.randint(20, 200)], " ".join(rng.choice(WORDS, rng.randint(1, 10)))]
        docs.append((int(rng.permutation(200)[0]), " ".join(parts)))
    docs += [(None, base[0]), (500, None), (501, ""), (502, "é" * 100), (503, "é" * 99 + "x"), (504, "a" * 3000), (505, "a" * 60), (506, "ab" * 1000), (506, "ab" * 1000), (507, base[0][:49])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spans string")
    got = sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) for r in remove_repeats(df, hot=hot).collect()), key=repr)
    assert got == sorted(brute_repeats(docs), key=repr)
    assert remove_repeats(df.limit(0)).count() == 0


def test_only_strings_with_equal_windows_are_built(monkeypatch):
    import pandas as pd
    import zstandard

    from termweave.llm import repeats

    rng = np.random.RandomState(4)
    noise = lambda n: bytes(rng.randint(97, 123, n).astype(np.uint8))
    seed = b"a common phrase of old.."
    strings = [noise(20) + seed + noise(20) for _ in range(300)]
    strings += [b"!" + strings[7], strings[9][1:] + b"?", strings[7]]
    docs = np.array([*range(10, 310), 3, 400, 500])
    press = zstandard.ZstdCompressor(level=1).compress
    sizes = np.array(list(map(len, strings)), np.int32)
    pdf = pd.DataFrame({"bucket": [0], "block": [0], "strings": [press(b"".join(strings))], "sizes": [sizes.tobytes()], "value": [np.full(303, 5, np.uint64).tobytes()], "owner": [press(docs.tobytes())]})
    built = []
    monkeypatch.setattr(repeats, "window_minima", lambda flat, size, *more: built.append(len(size)) or window_minima(flat, size, *more))
    got = np.frombuffer(zstandard.ZstdDecompressor().decompress(repeats._build(50)(pdf)["least"][0]), np.int64)
    first: dict[bytes, int] = {}
    windows = [(s[a : a + 50], d) for s, d in zip(strings, docs.tolist()) for a in range(len(s) - 49)]
    for w, d in windows:
        first[w] = min(first.get(w, d), d)
    assert got.tolist() == [first[w] for w, _ in windows]
    assert sum(built) == 4


def test_distinct_strings_by_bytes():
    from termweave.llm import repeats

    rng = np.random.RandomState(6)
    flat = rng.randint(0, 2, 3000).astype(np.uint8)
    start, size = rng.randint(0, 2900, 4000), rng.randint(8, 90, 4000)
    strings = [flat[a : a + n].tobytes() for a, n in zip(start, size)]
    for same_hash in (False, True):
        with pytest.MonkeyPatch.context() as m:
            if same_hash:
                m.setattr(repeats, "mix", lambda h: h & np.uint64(15))
            which, first = repeats._distinct(flat, start, size)
        assert len(first) == len(set(strings)) and [strings[first[k]] for k in which] == strings


def test_repeats_as_text_keeps_whole_characters(spark):
    shared = "x" * 10 + "é" * 30
    df = spark.createDataFrame([(1, "è" + shared), (2, "ê" + shared)], "doc_id long, text string")
    r = remove_repeats(df, as_text=True).where("doc_id = 2").first()
    assert r["kept"] in ("", "ê") and len(r["spans"]) == 1


def vectors(n=300, d=16, seed=2):
    rng = np.random.RandomState(seed)
    v = rng.randn(n, d)
    v[50:90] = v[:40] + 0.25 * rng.randn(40, d)
    v[90:100] = v[5]
    return np.round(v, 3)


def test_embedding_links_equal_brute_force(spark):
    v = vectors()
    rows = [(i, v[i].tolist()) for i in range(len(v))] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_near_duplicates(df, block=16).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.9
    links = [(a, b) for a in range(len(v)) for b in range(len(v)) if a < b and near[a, b]]
    found = sum(n for n, _, _ in got.values())
    assert found >= 0.97 * 2 * len(links)
    assert all(got[i][0] <= near[i].sum() - 1 for i in range(len(v)))
    if found == 2 * len(links):
        roots = find_roots(range(len(v)), links)
        assert {i: got[i][1:] for i in range(len(v))} == {i: (roots[i], roots[i] == i) for i in range(len(v))}
    assert all(got[i] == (0, i, True) for i in (900, 901, 902, 903, 904))
    assert embedding_near_duplicates(df.limit(0)).count() == 0


def test_embedding_links_of_several_lengths(spark):
    rng = np.random.RandomState(5)
    rows = [(i, rng.randn(8).tolist()) for i in range(40)] + [(100 + i, [1.0, 0.02 * i]) for i in range(5)] + [(200, [3.0]), (201, [-1.0]), (202, [7.0])]
    df = spark.createDataFrame(rows + [(39, rows[38][1])], "vec_id long, embedding array<double>").withColumn("unit", F.lit(1)).withColumn("rep", F.lit(2))
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_near_duplicates(df).where("vec_id >= 100").collect()}
    assert got == {(100 + i, 4, 100) for i in range(5)} | {(200, 1, 200), (201, 0, 201), (202, 1, 200)}


def test_heads_of_linked_vectors_meet_at_4096_reference_vectors():
    rng = np.random.RandomState(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    pivots, a = spread(rng.randn(8192, 64), 4096), unit(rng.randn(2000, 64))
    assert len(pivots) == 4096
    away = rng.randn(2000, 64)
    away = unit(away - (away * a).sum(1)[:, None] * a)
    c = rng.uniform(0.9, 0.905, 2000)[:, None]
    b = c * a + np.sqrt(1 - c * c) * away
    batch = lambda v: pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(v.tolist()), pa.array([1] * 2000)], ["rep", "v", "weight"])
    heads = [next(_heads(pivots, 8, 0.9)(iter([batch(v)]))).column("head").to_pylist() for v in (a, b)]
    assert np.mean([bool(set(x) & set(y)) for x, y in zip(*heads)]) >= 0.97


def test_embedding_recall_on_pairs_at_the_threshold(spark):
    rng = np.random.RandomState(8)
    base = rng.randn(1500, 64)
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = rng.randn(1500, 64)
    noise -= (noise * base).sum(1)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    c = rng.uniform(0.9, 1, 1500)[:, None]
    v = np.concatenate([base, c * base + np.sqrt(1 - c * c) * noise])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = embedding_near_duplicates(df).agg(F.sum("n_links")).first()[0]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    assert found >= 0.95 * ((u @ u.T >= 0.9).sum() - len(v))


def test_embedding_links_inside_a_large_group(spark):
    rng = np.random.RandomState(12)
    n, m = 30600, 10200
    v = rng.randn(n, 64)
    v[:m] = rng.randn(64) + 0.2 * v[:m]
    v = v[rng.permutation(n)]
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(v)}))
    got = embedding_near_duplicates(df).toPandas().sort_values("vec_id")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = np.concatenate([(p @ u.T >= 0.9).sum(1) - 1 for p in np.array_split(u, 30)])
    assert (near > 0).sum() >= m
    assert got["n_links"].tolist() == near.tolist()
    assert got["component_id"].tolist() == np.where(near > 0, np.flatnonzero(near)[0], np.arange(n)).tolist()


def test_top_k_equals_brute_force(spark):
    v = vectors(400, 8)
    v[100:120] = v[0]
    rows = [(i, v[i].tolist()) for i in range(400)] + [(1000, None), (1050, [float("inf")] * 8), (None, v[0].tolist()), (450, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(df, 5, 256.0, 50).collect())
    q = np.floor(v * 256).astype(np.int64)
    want = []
    for i in range(0, 400, 50):
        s = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:5]
        want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert got == want
    assert top_k(df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert sorted((r["query_id"], r["vec_id"]) for r in top_k(few).collect()) == [(0, 1), (0, 2)]


def test_top_k_with_repeated_ids_and_several_lengths(spark):
    rng = np.random.RandomState(3)
    rows = [(i, np.round(rng.randn(6), 3).tolist()) for i in range(1, 300)]
    rows += [(0, [9.0] * 6)] * 4 + [(7, rows[6][1])] * 3 + [(400 + i, np.round(rng.randn(3), 3).tolist()) for i in range(60)] + [(50, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(df, 5, 256.0, 50).collect())
    q = [(i, np.floor(np.array(v) * 256).astype(np.int64)) for i, v in rows]
    want = set()
    for i, v in q:
        if i % 50 == 0:
            s = sorted((-int(v @ w), j) for j, w in q if j != i and len(w) == len(v))[:5]
            want |= {(i, k + 1, j, -x) for k, (x, j) in enumerate(s)}
    assert got == sorted(want)
    assert top_k(df.where("vec_id = 0")).count() == 0


def test_top_k_with_wide_numbers(spark):
    df = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [1e9, 3.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in top_k(df, 2, 1.0).orderBy("rank").collect()]
    assert got == [(2, 10**18 + 3), (1, 10**18 + 2)]


def test_op8_digest(spark, tmp_path):
    from termweave.llm.queries import queries

    t = " ".join(WORDS * 2)
    spark.createDataFrame([(1, t), (2, "HEAD" + t)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = queries()["op8_suffix_array_dedup"](spark, str(tmp_path)).where("doc_id = 2").first()
    assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), 1, hashlib.sha256(b"HEAD").hexdigest())
