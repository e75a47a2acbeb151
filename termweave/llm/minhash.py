"""MinHash near-duplicates: universal hash minima, banding, signature and set verification, components.

Documents with equal shingle sets form one class, so copies never meet in pairs.  Classes that share
a band bucket are compared with the bucket's centre first (the class that meets most others), then,
where a bucket still spans several components, the classes outside its largest component are compared
with those of other components.  Every pair of a bucket that could join two components is therefore
compared, and no bucket is expanded into all its pairs.  Before, sets that have too many shingles of
their own to reach the threshold with any other leave, and pairs that can't reach it are not built.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import byte_buffers, cut, drop_cut, lean, slices
from termweave.llm.components import connected_components
from termweave.llm.shingles import mix, shingle_sets

ROWS = 5  # minima per band
BINS = 128  # of a set's histogram; two sets share at most the sum of the lesser counts
MOST = np.iinfo(np.int16).max  # of a bin's count; a set beyond it has no histogram
BITS = 24  # of a hash of an id by which texts are left out before they move


def bands_for(threshold: float, rows: int = ROWS, miss: float = 1e-6) -> int:
    """Bands with which a pair at the threshold shares no bucket with probability ``miss`` at most."""
    s = threshold**rows
    return max(1, ceil(log(miss) / log(1 - s))) if 0 < s < 1 else 1


def hash_family(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of the multiply-shift universal family."""
    rng = np.random.RandomState(seed)
    a, b = (rng.randint(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) for _ in range(2))
    return a * np.uint64(2) + np.uint64(1), b


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set, as unsigned 32-bit words."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 512):
            part = s[at : at + 512]
            np.minimum(least, (a[:, None] * part + b[:, None]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _signatures(k: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        a, b = hash_family(bands * ROWS)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            sets = (s for _, _, *part in slices(*byte_buffers(batch.column(1))) for s in shingle_sets(*part, k))
            sizes, keys, sigs, keys_of_bands = [], [], [], []
            for s in sets:
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    sig = signature(s, a, b)
                    sigs.append(sig.view(np.int32))
                    h = salt.copy()
                    with np.errstate(over="ignore"):
                        for col in sig.reshape(bands, ROWS).T:
                            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + col)
                    keys_of_bands.append(h.view(np.int64))
                else:
                    sigs.append(None)
                    keys_of_bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array(keys_of_bands, pa.list_(pa.int64()))],
                ["doc", "n", "key", "sig", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for _, _, *part in slices(*byte_buffers(batch.column(1))) for s in shingle_sets(*part, k)]
            bins = [np.bincount(s & (BINS - 1), minlength=BINS) for s in sets]
            bins = [b.astype(np.int16) if b.max() <= MOST else None for b in bins]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(bins, pa.list_(pa.int16()))], ["doc", "shingles", "bins"])

    return run


def likely(rows: DataFrame, wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows whose ``doc`` may be one of ``wanted``, without moving them: all that are, and others of the same hash.

    The bits set are told to all tasks as words of 64, at most 2 ** (bits - 6) of them however many ids are wanted.
    """
    spot = F.shiftrightunsigned(F.xxhash64("doc"), 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(63).cast("int"))
    words = wanted.groupBy(F.shiftright(spot, 6).alias("word")).agg(F.bit_or(bit).alias("set"))
    return rows.join(F.broadcast(words), (F.shiftright(spot, 6) == F.col("word")) & (F.col("set").bitwiseAND(bit) != 0), "left_semi")


def _estimated(share: float):
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same >= share * F.size("sig_a")


def near_duplicates(docs: DataFrame, k: int = 3, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Two documents are linked if den * |intersection| >= num * |union| of their sets of k-word
    shingles, confirmed on the full sets.  A null or empty text, or one without words, has an empty
    set and no links.  Rows with the same id are one node; rows with a null id are compared with
    nothing and have a null component_id and kept = false.  An empty table gives no rows.
    """
    threshold = num / den
    bands = bands_for(threshold)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t"))
    signed = cut(texts.mapInArrow(lean(_signatures(k, bands)), "doc long, n long, key binary, sig array<int>, bands array<long>"), "signatures")
    known = signed.where("n > 0 and doc is not null")

    # Classes of equal sets, each named by its smallest document; the minimum is taken before the shuffle.
    classes = known.groupBy("key").agg(F.min("doc").alias("rep"))
    member = cut(known.select("doc", "key").distinct().join(classes, "key").select("doc", "key", "rep"), "members")
    reps = known.join(member.where("doc = rep").select("key", "rep"), "key").where("doc = rep")
    reps = reps.dropDuplicates(["doc", "key"])
    # A document listed with several texts ties their classes together.
    again = member.groupBy("doc").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most")
    ties = member.join(again, "doc").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))

    spread = reps.select("doc", F.explode("bands").alias("bucket"))
    # Sums by bucket are written before rows are joined to them: a join of plain shuffles can be split where a bucket is large.
    crowded = cut(spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "crowded")
    shared = cut(spread.join(crowded, "bucket").select("bucket", "doc"), "shared")
    sharing = shared.select("doc").distinct()
    # Texts are large and few share a bucket: only those that may do so are joined by a shuffle.
    sets = cut(likely(texts, shared).join(sharing, "doc", "left_semi").mapInArrow(lean(_sets(k)), "doc long, shingles array<long>, bins array<short>").dropDuplicates(["doc", "shingles"]), "sets")
    # A shingle that no other of these sets has is in no intersection: what a set can share is bounded by the rest.
    single = sets.select("doc", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("doc").alias("doc")).where("c = 1")
    # An id with several texts, or a set without one, has no histogram and no count of its own shingles: it is compared with all it meets.
    kinds = cut(sets.groupBy("doc").agg(F.when(F.count("*") == 1, F.first("bins")).alias("bins")), "kinds")
    own = single.groupBy("doc").agg(F.count("*").alias("own")).join(kinds.where("bins is not null"), "doc", "left_semi")
    able = reps.join(sharing, "doc").join(own, "doc", "left").select("doc", "n", "sig", (F.col("n") - F.coalesce("own", F.lit(0))).alias("m")).where(F.col("m") * den >= F.col("n") * num)
    able = cut(able, "able")
    left = cut(shared.join(able.groupBy("doc").agg(F.max("n").alias("n"), F.max("m").alias("m")), "doc").join(kinds, "doc"), "left")
    again_crowded = cut(left.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "crowded")
    buckets = cut(left.join(again_crowded, "bucket").select("bucket", "doc", "n", "m", "bins", "size"), "buckets")
    meets = buckets.groupBy("doc").agg(F.sum("size").alias("meets"))
    sigs = able.select("doc", "n", "sig")

    def possible(n_x, m_x, b_x, n_y, m_y, b_y):
        enough = lambda most: most * den >= (F.col(n_x) + F.col(n_y) - most) * num
        most = F.aggregate(F.zip_with(b_x, b_y, lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda a, b: a + b)
        return F.col(b_x).isNull() | F.col(b_y).isNull() | (enough(F.least(m_x, m_y)) & enough(most))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) those whose signatures, then full sets, are similar enough."""
        a = sigs.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
        b = sigs.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
        near = pairs.join(b, "b").join(a, "a")
        near = near.where((F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & _estimated(threshold - 5 * (threshold * (1 - threshold) / (bands * ROWS)) ** 0.5))
        near = near.select("a", "b").distinct()
        near = near.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("s_b")), "b")
        near = near.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("s_a")), "a")
        both = F.size(F.array_intersect("s_a", "s_b")).cast("long")
        return near.where(both * den >= (F.size("s_a") + F.size("s_b") - both) * num).select("a", "b").distinct()

    ranked = buckets.join(meets, "doc")
    centre = F.max_by(F.struct("doc", "n", "m", "bins"), F.struct("meets", -F.col("doc")))
    centres = ranked.groupBy("bucket").agg(centre.alias("c")).select("bucket", F.col("c.doc").alias("centre"), F.col("c.n").alias("n_c"), F.col("c.m").alias("m_c"), F.col("c.bins").alias("b_c"))
    centres = cut(centres, "centres")
    met = buckets.join(centres, "bucket").where((F.col("doc") != F.col("centre")) & possible("n", "m", "bins", "n_c", "m_c", "b_c"))
    tested = cut(met.select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct(), "tested")
    links = cut(confirmed(tested).unionAll(ties), "near")
    found = connected_components(links, "a", "b")

    # Buckets that still span several components: what lies outside the largest one is compared with all else.
    placed = buckets.where("size > 2").join(found, buckets["doc"] == found["node"], "left").select("bucket", "doc", "n", "m", "bins", F.coalesce("component", "doc").alias("component"))
    placed = cut(placed, "placed")
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    main = parts.groupBy("bucket").agg(F.max_by("component", F.struct("c", -F.col("component"))).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    main = cut(main, "main")
    open_ = placed.join(main, "bucket")
    rest = open_.where("component <> main").select("bucket", F.col("doc").alias("x"), F.col("component").alias("of_x"), F.col("n").alias("n_x"), F.col("m").alias("m_x"), F.col("bins").alias("b_x"))
    others = open_.select("bucket", F.col("doc").alias("y"), F.col("component").alias("of_y"), F.col("n").alias("n_y"), F.col("m").alias("m_y"), F.col("bins").alias("b_y"))
    pairs = rest.join(others, (rest["bucket"] == others["bucket"]) & (F.col("of_x") != F.col("of_y")) & possible("n_x", "m_x", "b_x", "n_y", "m_y", "b_y"))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    more = cut(confirmed(pairs).unionAll(links), "near")
    final = connected_components(more, "a", "b")

    roots = member.groupBy("doc").agg(F.min("rep").alias("rep"))
    roots = roots.join(final, roots["rep"] == final["node"], "left").select("doc", F.coalesce("component", "rep").alias("root"))
    out = signed.select("doc", "n").join(roots, "doc", "left").select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("root", "doc").alias("component_id"),
        F.coalesce(F.col("doc") == F.coalesce("root", "doc"), F.lit(False)).alias("kept"),
    )
    drop_cut(crowded, again_crowded, left, kinds, centres, main, shared, able, buckets, sets, tested, links, placed, more)
    return out
