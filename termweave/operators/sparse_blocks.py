"""Sparse retrieval in blocks: terms are counted, weighted and multiplied where a block's texts are.

Postings of all texts never travel, nor do scores of all pairs: what is shuffled are the texts, one
row per block and distinct term, and each query's k best of a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from termweave.functions.text import SPACES, word_tokens
from termweave.operators.best import Best

#: Scores of so many queries and items are in memory at once (8 MB).
QUERY_TILE, ITEM_TILE = 256, 4096
ROWS = 16384  # texts of a block at most, on average


def word_text(c: Column | str) -> Column:
    """A text's words with one blank between; words hold none."""
    return F.array_join(word_tokens(c), " ")


def gram_text(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), SPACES, " ")


@dataclass
class Counts:
    """Distinct (row, code) in order with their counts; ``terms`` names the codes, ``size`` is each row's count of all terms."""

    row: np.ndarray
    code: np.ndarray
    n: np.ndarray
    terms: pa.Array
    size: np.ndarray


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and their counts."""
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def count_words(texts: pa.Array) -> Counts:
    """Words of texts made by :func:`word_text`."""
    words = pc.split_pattern(texts.cast(pa.large_string()), " ")
    flat, row = words.flatten(), np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(words)))
    real = pc.not_equal(flat, "")
    flat, row = flat.filter(real).dictionary_encode(), row[np.asarray(real)]
    terms = flat.dictionary.cast(pa.string())
    wide = max(1, len(terms))
    keys, n = _runs(row * wide + np.asarray(flat.indices))
    return Counts(keys // wide, keys % wide, n, terms, np.bincount(row, minlength=len(texts)))


def count_grams(least: int, most: int) -> Callable[[pa.Array], Counts]:
    """Character n-grams with least <= n <= most of texts made by :func:`gram_text`."""

    def run(texts: pa.Array) -> Counts:
        import pandas as pd

        size = np.asarray(pc.utf8_length(texts)).astype(np.int64)
        whole = "".join(texts.to_pylist())
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the row's end
        row_of = np.repeat(np.arange(len(size), dtype=np.int32), size)
        seen = np.zeros(0x110000, bool)
        seen[code] = True
        digit = (np.cumsum(seen) - 1).astype(np.int32)[code].astype(np.int64)
        base = max(1, int(seen.sum()))
        packed, top = digit, base  # the n-gram that starts at each place as a number below top; beyond a row's end any
        rows, codes, counts, names, known = [], [], [], [], 0
        total = np.zeros(len(size), np.int64)
        for n in range(1, most + 1):
            if n > 1:
                if top > (1 << 62) // base:
                    packed = pd.factorize(packed)[0].astype(np.int64)
                    top = len(packed)
                following = np.zeros(len(digit), np.int64)
                following[: len(digit) - n + 1] = digit[n - 1 :]
                packed, top = packed * base + following, top * base
            at = np.flatnonzero(left >= n)
            if n < least or not len(at):
                continue
            number, distinct = pd.factorize(packed[at])
            first = np.empty(len(distinct), np.int64)
            first[number[::-1]] = at[::-1]
            names.append(pa.array([whole[i : i + n] for i in first.tolist()], pa.string()))
            total += np.maximum(size - n + 1, 0)
            keys, times = _runs(row_of[at].astype(np.int64) * len(distinct) + number)
            rows.append((keys // len(distinct)).astype(np.int32))
            codes.append((keys % len(distinct) + known).astype(np.int32))
            counts.append(times.astype(np.int32))
            known += len(distinct)
        none = [np.zeros(0, np.int32)]
        return Counts(*(np.concatenate(x or none) for x in (rows, codes, counts)), pa.concat_arrays(names) if names else pa.array([], pa.string()), total)

    return run


#: Characters of texts whose n-grams are counted at once, but for a longer text.
SLICE = 1 << 20


def gram_sizes(least: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows whose last column is a text made by :func:`gram_text`: the other columns, n_grams and n_distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = count_grams(least, most)
        for batch in batches:
            ends = np.cumsum(np.asarray(pc.utf8_length(batch.columns[-1]))).astype(np.int64)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
                part = batch.slice(lo, hi - lo)
                c = count(part.columns[-1])
                sizes = [c.size, np.bincount(c.row, minlength=hi - lo)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(x, pa.int32()) for x in sizes)], [*part.schema.names[:-1], "n_grams", "n_distinct"])
                lo = hi

    return run


@dataclass
class Weighting:
    """How texts are counted and weighted.  ``bm25`` is (k1, b) or None for TF-IDF of unit norm."""

    count: Callable[[pa.Array], Counts]
    chars: int  # characters of a block, but for a longer text
    bm25: tuple[float, float] | None


def _numbers(ids: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct ids in order, null last, and each row's number there."""
    distinct = ids.unique()
    distinct = distinct.take(pc.sort_indices(distinct))
    return distinct, np.asarray(pc.index_in(ids, distinct)).astype(np.int64)


def _by_id(c: Counts, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, code, n): counts of rows with one id together."""
    wide = max(1, len(c.terms))
    number = who[c.row]
    if len(np.unique(who)) == len(who):
        order = np.argsort(number, kind="stable")
        return number[order], c.code[order], c.n[order]
    keys, back = np.unique(number * wide + c.code, return_inverse=True)
    return keys // wide, keys % wide, np.bincount(back, weights=c.n).astype(np.int64)


def _codes(c: Counts, who: np.ndarray) -> np.ndarray:
    """The code of each distinct pair of an id and a term."""
    return c.code if len(np.unique(who)) == len(who) else _by_id(c, who)[1]


TERMS = "side boolean, block int, term string, n long, rows long, size long"


def _terms(count: Callable[[pa.Array], Counts]):
    """Of a block: each term with the count of ids that hold it, and a row without term: rows and their terms.  Those of queries count as 0."""
    schema = pa.schema([("side", pa.bool_()), ("block", pa.int32()), ("term", pa.string()), ("n", pa.int64()), ("rows", pa.int64()), ("size", pa.int64())])

    def run(key, table):
        c = count(table.column("text").combine_chunks())
        who = _numbers(table.column("id").combine_chunks())[1]
        n, m = (np.zeros(len(c.terms), np.int64), 0) if key[0].as_py() else (np.bincount(_codes(c, who), minlength=len(c.terms)), 1)
        k = len(c.terms) + 1
        last = lambda x: pa.array(np.append(np.zeros(k - 1, np.int64), m * x))
        columns = [pa.array([key[0].as_py()] * k), pa.array([key[1].as_py()] * k, pa.int32()), pa.concat_arrays([c.terms, pa.nulls(1, pa.string())]), pa.array(np.append(n, 0)), last(len(who)), last(int(c.size.sum()))]
        return pa.table(columns, schema=schema)

    return run


def _blocks(texts: DataFrame, chars: int, name: str) -> DataFrame:
    """One row: the count of blocks of texts (id, text, chars); ``chars`` is about the text's length and needs no work on it."""
    return texts.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / ROWS), F.ceil(F.sum("chars") / chars)).cast("int").alias(name))


def _block(id_: Column | str, blocks: str) -> Column:
    """Rows of one id are in one block."""
    return F.pmod(F.xxhash64(id_), F.col(blocks)).cast("int")


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _block_terms(rows: DataFrame, w: Weighting) -> DataFrame:
    return rows.repartition(_partitions(rows), "side", "block").groupBy("side", "block").applyInArrow(_terms(w.count), TERMS)


def term_counts(items: DataFrame, w: Weighting) -> DataFrame:
    """(term, df) of texts (id, text, chars): the count of ids that hold each term."""
    rows = items.crossJoin(F.broadcast(_blocks(items, w.chars, "ni"))).select(F.lit(False).alias("side"), _block("id", "ni").alias("block"), "id", "text")
    return _block_terms(rows, w).where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))


def products(queries, n_queries: int, items, n_items: int, terms: int):
    """Tiles (first query, first item, scores) of the products of two sparse matrices, each (number, code, weight) by number.

    Terms that many of a tile's texts hold are multiplied as dense columns, others pair by pair.
    """
    for i in range(0, n_items, ITEM_TILE):
        wide = min(ITEM_TILE, n_items - i)
        a, b = np.searchsorted(items[0], [i, i + wide])
        x, xc, xw = items[0][a:b] - i, items[1][a:b], items[2][a:b]
        in_items = np.bincount(xc, minlength=terms)
        for q in range(0, n_queries, QUERY_TILE):
            high = min(QUERY_TILE, n_queries - q)
            a, b = np.searchsorted(queries[0], [q, q + high])
            y, yc, yw = queries[0][a:b] - q, queries[1][a:b], queries[2][a:b]
            in_queries = np.bincount(yc, minlength=terms)
            pairs = in_items * in_queries
            out = np.zeros((high, wide))
            common = np.flatnonzero(pairs * 50 > out.size)
            place = np.full(terms, -1)
            for lo in range(0, len(common), 512):
                some = common[lo : lo + 512]
                place[:] = -1
                place[some] = np.arange(len(some))
                left, right = np.zeros((high, len(some))), np.zeros((len(some), wide))
                k = np.flatnonzero(place[yc] >= 0)
                left[y[k], place[yc[k]]] = yw[k]
                k = np.flatnonzero(place[xc] >= 0)
                right[place[xc[k]], x[k]] = xw[k]
                out += left @ right
            pairs[common] = 0
            rare = pairs > 0
            k = np.flatnonzero(rare[yc])
            k = k[np.argsort(yc[k], kind="stable")]
            begin = np.cumsum(np.where(rare, in_queries, 0)) - np.where(rare, in_queries, 0)
            j = np.flatnonzero(rare[xc])
            times = in_queries[xc[j]]
            ends = np.cumsum(times)
            lo = 0
            while lo < len(j):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 2_000_000, "right")))
                t, z = times[lo:hi], j[lo:hi]
                from_q = k[np.repeat(begin[xc[z]] - (np.cumsum(t) - t), t) + np.arange(t.sum())]
                out += np.bincount(y[from_q] * wide + np.repeat(x[z], t), weights=yw[from_q] * np.repeat(xw[z], t), minlength=out.size).reshape(out.shape)
                lo = hi
            yield q, i, out


def _item_weights(w: Weighting, c: Counts, who: np.ndarray, n_ids: int, df: np.ndarray, rows: int, total: int):
    number, code, n = _by_id(c, who)
    if w.bm25 is None:
        r = n * (np.log((1 + rows) / (1 + df[code])) + 1)
        return number, code, r / np.sqrt(np.bincount(number, weights=r * r, minlength=n_ids))[number]
    k1, b = w.bm25
    norm = k1 * (1 - b + b * c.size / max(total / rows, 1e-12))
    order = np.argsort(who, kind="stable")
    times = np.bincount(who, minlength=n_ids)
    begin = np.cumsum(times) - times
    weight = np.zeros(len(n))
    for j in range(int(times.max(initial=0))):  # each of the rows of an id counts with its length
        have = np.flatnonzero(times[number] > j)
        weight[have] += n[have] * (k1 + 1) / (n[have] + norm[order[begin[number[have]] + j]])
    return number, code, weight


def _query_weights(w: Weighting, c: Counts, who: np.ndarray, n_ids: int, df: np.ndarray, rows: int):
    number, code, n = _by_id(c, who)
    known = df[code] > 0
    number, code, n = number[known], code[known], n[known]
    if w.bm25 is None:
        r = n * (np.log((1 + rows) / (1 + df[code])) + 1)
        return number, code, r / np.sqrt(np.bincount(number, weights=r * r, minlength=n_ids))[number]
    return number, code, np.log(1 + (rows - df[code] + 0.5) / (df[code] + 0.5))


def _side(table: pa.Table, w: Weighting):
    """Texts' counts, ids and numbers; of each term the count of ids; the listed pairs."""
    texts = table.filter(pc.is_valid(table.column("text")))
    c = w.count(texts.column("text").combine_chunks())
    ids, who = _numbers(texts.column("id").combine_chunks())
    terms = table.filter(pc.is_valid(table.column("term")))
    at = np.asarray(pc.fill_null(pc.index_in(c.terms, terms.column("term").combine_chunks()), -1))
    df = np.append(np.asarray(terms.column("df")), 0)[at] if len(at) else np.zeros(0, np.int64)
    return c, ids, who, df.astype(np.int64)


def _top(w: Weighting, k: int, schema: pa.Schema):
    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ci, item_ids, item_of, df_i = _side(left, w)
        cq, query_ids, query_of, df_q = _side(right, w)
        facts = right.filter(pc.and_(pc.is_valid(right.column("rows")), pc.is_null(right.column("term"))))
        if not len(item_of) or not len(query_of) or not facts.num_rows:
            return schema.empty_table()
        rows, total = facts.column("rows")[0].as_py(), facts.column("size")[0].as_py()
        q = _query_weights(w, cq, query_of, len(query_ids), df_q, rows)
        x = _item_weights(w, ci, item_of, len(item_ids), df_i, rows, total)
        same = np.asarray(pc.fill_null(pc.index_in(ci.terms, cq.terms), -1)).astype(np.int64)[x[1]] if len(ci.terms) else x[1]
        shared = np.flatnonzero(same >= 0)
        x = x[0][shared], same[shared], x[2][shared]
        null_item = item_ids.null_count  # it is the last
        n_items, n_queries = len(item_ids) - null_item, len(query_ids) - query_ids.null_count
        asked = left.filter(pc.is_valid(left.column("query_id")))
        listed = [np.asarray(pc.fill_null(pc.index_in(asked.column(c).combine_chunks(), ids), -1)).astype(np.int64) for c, ids in (("query_id", query_ids), ("id", item_ids))]
        of_list = np.zeros(asked.num_rows)
        tile = listed[0] // QUERY_TILE + (listed[1] // ITEM_TILE) * (1 << 32)
        tile[(listed[0] < 0) | (listed[1] < 0)] = -1
        order = np.argsort(tile, kind="stable")
        best = Best(n_queries, k)
        for q0, i0, scores in products(q, n_queries, x, n_items, len(cq.terms)):
            here = q0 // QUERY_TILE + (i0 // ITEM_TILE) * (1 << 32)
            a, b = np.searchsorted(tile, [here, here + 1], sorter=order)
            of_list[order[a:b]] = scores[listed[0][order[a:b]] - q0, listed[1][order[a:b]] - i0]
            scores[scores <= 0] = -np.inf  # nothing shared
            best.add(q0, i0, scores)
        there = np.flatnonzero(tile >= 0)
        n, m = len(best.query), len(there)
        columns = [
            pa.concat_arrays([query_ids.take(pa.array(best.query)), query_ids.take(pa.array(listed[0][there]))]),
            pa.concat_arrays([item_ids.take(pa.array(best.item)), item_ids.take(pa.array(listed[1][there]))]),
            pa.array(np.append(best.score, np.round(of_list[there], 6))),
            pa.concat_arrays([pa.nulls(n, pa.float64()), asked.column("other").combine_chunks().take(pa.array(there))]),
            pa.array(np.arange(n + m) >= n),
        ]
        return pa.table(columns, schema=schema)

    return run


def block_scores(items: DataFrame, queries: DataFrame, w: Weighting, k: int, listed: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, score, other, listed): each query's k best items of each block, and the listed pairs.

    ``items`` and ``queries`` are (id, text, chars), ``listed`` (query_id, item_id, other).  Only pairs that
    share a term are among the best; a listed pair of known ids that shares none has 0.  Counts of terms are those
    of all items.  Rows without an id count in these only.
    """
    n, id_ = _partitions(items), items.schema["id"].dataType
    grid = F.broadcast(_blocks(items, w.chars, "ni").crossJoin(_blocks(queries, w.chars if w.bm25 is None else 4 * w.chars, "nq")))  # one row
    texts = items.select(F.lit(False).alias("side"), "id", "text").crossJoin(grid).withColumn("block", _block("id", "ni"))
    texts = texts.unionByName(queries.select(F.lit(True).alias("side"), "id", "text").crossJoin(grid).withColumn("block", _block("id", "nq")))
    terms = _block_terms(texts.select("side", "block", "id", "text"), w)
    sums = {"df": F.sum("n"), "rows": F.sum("rows"), "size": F.sum("size")}
    if w.bm25 is None:
        by = Window.partitionBy("term")
        terms = terms.select("side", "block", "term", *[c.over(by).alias(name) for name, c in sums.items()])
    else:  # items' weights need no count of their terms
        terms = terms.groupBy("term").agg(*[c.alias(name) for name, c in sums.items()], F.collect_set(F.when(F.col("side"), F.col("block"))).alias("blocks"))
        terms = terms.select(F.lit(True).alias("side"), F.explode("blocks").alias("block"), "term", *sums)
    null = lambda kind: F.lit(None).cast(kind)
    q_id = queries.schema["id"].dataType
    columns = ["ib", "qb", "id", "text", "term", "df", "rows", "size", "query_id", "other"]

    def side(of_queries: bool) -> DataFrame:
        own, far, n_far = ("qb", "ib", "ni") if of_queries else ("ib", "qb", "nq")
        mine = F.col("side") if of_queries else ~F.col("side")
        rows = texts.where(mine).select("block", "id", "text", "ni", "nq")
        if of_queries or w.bm25 is None:
            rows = rows.unionByName(terms.where(mine).crossJoin(grid).select("block", "term", "df", "rows", "size", "ni", "nq"), allowMissingColumns=True)
        else:
            rows = rows.select("*", null("string").alias("term"), *[null("long").alias(c) for c in sums])
        rows = rows.withColumn(own, F.col("block")).withColumn(far, F.explode(F.sequence(F.lit(0), F.col(n_far) - 1)))
        return rows.withColumn("query_id", null(q_id)).withColumn("other", null("double")).select([F.col(c).alias(c) for c in columns])

    left, right = side(False), side(True)
    if listed is not None:
        pairs = listed.select(F.col("item_id").cast(id_).alias("id"), F.col("query_id").cast(q_id).alias("query_id"), "other").crossJoin(grid)
        left = left.unionByName(pairs.select(_block("id", "ni").alias("ib"), _block("query_id", "nq").alias("qb"), "id", "query_id", "other"), allowMissingColumns=True)
    keys = ["ib", "qb"]
    kinds = f"query_id {q_id.simpleString()}, item_id {id_.simpleString()}, score double, other double, listed boolean"
    schema = to_arrow_schema(StructType.fromDDL(kinds))
    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInArrow(_top(w, k, schema), kinds)
