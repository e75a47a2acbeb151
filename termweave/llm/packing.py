"""Sequence packing by non-negative least squares over a length histogram.

Documents are tokenised, cut at the window, and their lengths binned.  The histogram has a fixed
number of bins, so everything solved on the driver has a fixed size: all combinations of at most
``depth`` lengths that fill a window exactly, the repeat counts that reproduce the histogram best
(non-negative least squares), rounding down, and a greedy packing of what is left.  The resulting
plan says which ranks of each bin go to which sequences; a piece finds its place by its rank.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.common import cut, lean

END_ID = 1


class FastBpe:
    """Byte-level BPE ids of a tokenizers JSON file, encoded word by word with a bounded cache.

    Tokens never cross from a non-blank to a following space, so a text may be cut before each space
    if none follows white space of any kind; other texts are encoded whole.  Files whose merges
    don't follow the id order, and texts that hold a special token, go through ``tokenizers``.
    """

    CACHE = 400_000
    #: A space after white space; Python's class holds all that the tokenizer's pattern takes for it.
    RUN = re.compile(r"\s ")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._ranks(spec)
        outer = self

        class Cache(dict):
            def __missing__(self, piece: str) -> tuple:
                ids = tuple(outer.fast.encode_ordinary(piece))
                if len(self) >= outer.CACHE:
                    self.clear()
                self[piece] = ids
                return ids

        self.cache = Cache()

    def _ranks(self, spec: dict):
        """A tiktoken engine over the same vocabulary, or None where the file isn't plain byte-level BPE."""
        model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return None
        if not pre.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
            return None
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back, extra = {chr(b): b for b in printable}, 0
        for b in range(256):
            if b not in printable:
                back[chr(256 + extra)] = b
                extra += 1
        special = set(self.special)
        ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        at = [model["vocab"][a + b] for a, b in merged]
        if at != sorted(at):
            return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.RUN.search(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        words = text.split(" ")
        words[1:] = [" " + w for w in words[1:]]
        if words[0] == "":
            del words[0]
        out: list[int] = []
        for ids in map(self.cache.__getitem__, words):
            out += ids
        return np.array(out, np.uint32)


def _cut_pieces(path: str, window: int, unit: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = FastBpe(path)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(bpe.ids(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    row = (doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids), -(-len(piece) // unit), piece.tobytes() if with_ids else None)
                    for c, v in zip(cols, row):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return run


def combinations(bins: list[int], full: int, depth: int) -> list[tuple[int, ...]]:
    """All multisets of at most ``depth`` (1 to 3) of the given lengths whose sum is ``full``."""
    have, found = set(bins), []
    if full in have:
        found.append((full,))
    if depth >= 2:
        found += [(a, full - a) for a in bins if a <= full - a and full - a in have]
    if depth >= 3:
        found += [(a, b, full - a - b) for a in bins for b in bins if a <= b <= full - a - b and full - a - b in have]
    return found


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |A x - target| with x >= 0 by accelerated projected gradient.

    ``columns`` lists, for each unknown, the rows it adds one to (repeated rows add more; -1: none).
    """
    used = columns >= 0
    rows = np.where(used, columns, 0)
    n, m = len(target), len(columns)
    ahead = lambda x: np.bincount(rows.ravel(), (used * x[:, None]).ravel(), n)
    back = lambda y: (y[rows] * used).sum(1)
    v = np.ones(m)
    for _ in range(20):
        v = back(ahead(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / max(1e-12, 1.05 * np.linalg.norm(back(ahead(v))))
    x = y = np.zeros(m)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(ahead(y) - target))
        if (new - x) @ (y - new) > 0:  # restart where the momentum points uphill
            t = 1.0
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def pack_plan(histogram: dict[int, int], full: int, depth: int = 3) -> list[tuple[dict[int, int], int]]:
    """Patterns ({bin: items per sequence}, number of sequences) that use every item of the histogram once."""
    left = {b: n for b, n in histogram.items() if n > 0}
    plan: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], times: int) -> None:
        plan.append((pattern, times))
        for b, m in pattern.items():
            left[b] -= m * times
            if not left[b]:
                del left[b]

    def as_pattern(parts) -> dict[int, int]:
        pattern: dict[int, int] = {}
        for b in parts:
            pattern[b] = pattern.get(b, 0) + 1
        return pattern

    bins = sorted(left)
    combos = combinations(bins, full, depth)
    if combos:
        row = {b: i for i, b in enumerate(bins)}
        columns = np.array([[row[b] for b in c] + [-1] * (depth - len(c)) for c in combos])
        repeats = nnls(columns, np.array([left[b] for b in bins], float))
        for i in np.argsort(-repeats, kind="stable"):
            if repeats[i] < 1:
                break
            pattern = as_pattern(combos[i])
            times = min(int(repeats[i]), *(left.get(b, 0) // m for b, m in pattern.items()))
            if times:
                use(pattern, times)
    while left:  # longest first, each time filled up with the longest that still fit
        pattern, room = {}, full
        for b in sorted(left, reverse=True):
            fit = min(room // b, left[b])
            if fit:
                pattern[b], room = fit, room - fit * b
        use(pattern, max(1, min(left[b] // m for b, m in pattern.items())))
    return plan


def plan_intervals(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, from rank, to rank, items per sequence, first sequence, first place) for each part of each pattern."""
    cursor: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in plan:
        place = 0
        for b, m in sorted(pattern.items(), reverse=True):
            at = cursor.get(b, 0)
            out.append((b, at, at + m * times, m, sequence, place))
            cursor[b], place = at + m * times, place + m
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, depth: int = 3, bins: int = 512, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in packed sequences of ``window`` ids.

    Each document is its ids plus one end id; a null or empty text is the end id alone.  Ids beyond
    the window open a new piece.  Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and ids (little-endian unsigned 32-bit) if ``with_ids``.  Offsets are gapless; repeated
    rows are packed as often as they occur; a null id is kept; an empty table gives no rows.
    """
    spark = docs.sparkSession
    unit = -(-window // bins)
    full = window // unit
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int, ids binary"
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t")).mapInArrow(lean(_cut_pieces(tokenizer_path, window, unit, with_ids)), schema)
    if not with_ids:
        rows = rows.drop("ids")
    rows = cut(rows.withColumn("part", F.spark_partition_id()), "pieces")

    counts = rows.groupBy("part", "bin").agg(F.count("*").alias("n"))
    histogram = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # at most `bins` rows
    intervals = plan_intervals(pack_plan(histogram, full, depth))
    plan = spark.createDataFrame(intervals, "bin int, lo long, hi long, per long, first_sequence long, first_place long")

    # Rank within a bin = items of the bin in earlier partitions + rank in the own one: no bin meets in one task.
    earlier = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    local = Window.partitionBy("part", "bin").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.join(base, ["part", "bin"]).withColumn("rank", F.col("base") + F.row_number().over(local) - 1)
    placed = (
        ranked.join(F.broadcast(plan), "bin")  # the plan's size depends on `bins` and `depth` alone
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .withColumn("sequence_id", F.col("first_sequence") + F.expr("(rank - lo) div per"))
        .withColumn("place", F.col("first_place") + (F.col("rank") - F.col("lo")) % F.col("per"))
    )
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
