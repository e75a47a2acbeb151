"""Removal of repeated passages, exact over whole texts, by column-wise suffix construction.

A window (``length`` bytes) is grouped by its minimizer, the least hash of its 24-byte substrings, so
equal windows meet in one group wherever they stand.  Consecutive windows of one minimizer form a
short string; the strings of a group are one collection whose Burrows-Wheeler transform and common
prefixes are built symbol by symbol.  Runs of entries that share ``length`` symbols are equal windows,
and the smallest document of a run decides what is removed from the others.

Documents lie in compressed blocks that are dealt into buckets of files once; what belongs to a block
is brought to it, and its text doesn't move again.  A block sends each distinct string once with its
smallest document, and gets back one smallest document per window, so a passage that a third of all
documents hold costs one entry per block.  A minimizer that occurs in one document only can't be part
of a repeat; those are told apart by 32 bits of their hashes before any text is sent.  A minimizer
with very many strings (a common phrase in ever new surroundings) is split: its windows are grouped by
a hash of the whole window instead.  Strings none of whose windows has the hash of another window are
left out of the collections: they share nothing, however often their minimizer occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.blocks import SCHEMA, pack_blocks, unpacked
from termweave.llm.column_bwt import window_minima
from termweave.llm.common import bucketed, byte_buffers, cut, lean, lean_group, partitions
from termweave.llm.shingles import mix

SEED = 24  # bytes of a minimizer's substring
RUN = 40  # windows of one string at most
BLOCK = 4 << 20  # bytes of text of a block, but for a longer document
BUCKET = 16 << 20  # bytes of text per bucket of minimizers
COLLECTION = 1 << 18  # symbols built at once, but for the strings of one minimizer
SLICE = 1 << 19  # windows hashed at once
LOOK = 1 << 21  # symbols looked at together for equal windows, but for the strings of one minimizer
HOT = 1 << 16  # runs of one minimizer, as counted block by block, from which it is split
NOBODY = np.iinfo(np.int64).max


def _minimizers(flat: np.ndarray, span: int) -> np.ndarray:
    """The least hash of ``span`` consecutive substrings of SEED bytes, for each place with room for them."""
    seeds = len(flat) - SEED + 1
    words = np.ndarray((len(flat) - 7,), "<u8", flat, 0, (1,))
    with np.errstate(over="ignore"):
        h = words[:seeds] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += words[8 : seeds + 8]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h += words[16 : seeds + 16]
        h = mix(h * np.uint64(0x94D049BB133111EB))
    have = 1
    while have < span:
        step = min(have, span - have)
        h = np.minimum(h[: len(h) - step], h[step:])
        have += step
    return h


class Runs:
    """Maximal runs of consecutive windows with one minimizer: first byte, windows, minimizer, document (row)."""

    def __init__(self, flat: np.ndarray, offs: np.ndarray, length: int) -> None:
        span = length - SEED + 1
        n = len(flat)
        windows = n - length + 1
        self.start, self.count, self.value, self.doc = (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
        if windows <= 0:
            return
        h = np.empty(windows, np.uint64)
        flat = np.ascontiguousarray(flat)
        for at in range(0, windows, SLICE):
            h[at : at + SLICE] = _minimizers(flat[at : at + SLICE + length - 1], span)
        # Windows may not leave their document.
        doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))[:windows]
        size = np.diff(offs)
        inside = np.repeat(size >= length, size)
        for back in range(1, length):
            inside[offs[1:][size >= length] - back] = False
        inside = inside[:windows]
        change = np.ones(windows, bool)
        change[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        start = np.flatnonzero(change)
        count = np.diff(np.append(start, windows))
        keep = inside[start]
        start, count = start[keep], count[keep]
        parts = -(-count // RUN)  # periodic text has long runs
        if (parts > 1).any():
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            whole = np.repeat(count, parts)
            start = np.repeat(start, parts) + k * RUN
            count = np.minimum(RUN, whole - k * RUN)
        self.start, self.count, self.value, self.doc = start, count, h[start], doc[start].astype(np.int64)

    def only(self, keep: np.ndarray) -> None:
        self.start, self.count, self.value, self.doc = self.start[keep], self.count[keep], self.value[keep], self.doc[keep]

    def split(self, hot: np.ndarray, flat: np.ndarray, length: int) -> None:
        """Make a run of its own of each window of the marked runs, by a hash of all its bytes."""
        if not hot.any():
            return
        per = np.where(hot, self.count, 1)
        k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        hot = np.repeat(hot, per)
        self.start = np.repeat(self.start, per) + k
        self.count = np.where(hot, 1, np.repeat(self.count, per))
        self.value, self.doc = np.repeat(self.value, per), np.repeat(self.doc, per)
        at = self.start[hot]
        with np.errstate(over="ignore"):
            h = self.value[hot]
            for i in range(length):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[at + i])
        self.value[hot] = h


def _places(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each minimizer, and 32 bits of it for the marks."""
    h = mix(value)
    return (h % np.uint64(buckets)).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """Ids of a block's rows; NOBODY where null."""
    return np.array([NOBODY if x is None else x for x in batch.column(0).to_pylist()], np.int64)


def _block_rows(length: int, buckets: int):
    """Each block's distinct minimizers by bucket, with their runs (127 at most) and a mark for those of several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = unpacked(blob.as_py())
                runs = Runs(*byte_buffers(rows.column(rows.num_columns - 1)), length)
                if not len(runs.value):
                    continue
                bucket, short = _places(runs.value, buckets)
                key = bucket.astype(np.uint64) << np.uint64(32) | short
                order = np.argsort(key, kind="stable")
                key, doc = key[order], runs.doc[order]
                at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                several = np.maximum.reduceat(doc, at) != np.minimum.reduceat(doc, at)
                tally = (np.minimum(127, np.diff(np.append(at, len(key)))) << 1 | several).astype(np.uint8)
                bucket, short = (key[at] >> np.uint64(32)).astype(np.int64), (key[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                made = [(int(bucket[a]), block, short[a:b].tobytes(), press.compress(tally[a:b].tobytes())) for a, b in zip(edges[:-1], edges[1:])]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["bucket", "block", "value", "tally"])

    return run


def _shared(hot: int):
    """Of one bucket, the minimizers of several documents by block, with the mark of those to split."""

    def run(pdf):
        import pandas as pd
        import zstandard

        expand = zstandard.ZstdDecompressor()
        values = [np.frombuffer(v, np.uint32) for v in pdf["value"]]
        tally = np.concatenate([np.frombuffer(expand.decompress(t), np.uint8) for t in pdf["tally"]])
        value = np.concatenate(values)
        order = np.argsort(value, kind="stable")
        ranked, counts = value[order], tally[order]
        at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        entries = np.diff(np.append(at, len(ranked)))
        shared = (entries > 1) | (np.add.reduceat(counts & 1, at, dtype=np.int64) > 0)
        crowded = np.add.reduceat(counts >> 1, at, dtype=np.int64) >= hot
        keep, split = np.empty(len(value), bool), np.empty(len(value), bool)
        keep[order], split[order] = np.repeat(shared, entries), np.repeat(crowded, entries)
        first = np.uint64(pdf["bucket"].iloc[0]) << np.uint64(32)
        rows, end = [], 0
        for block, v in zip(pdf["block"], values):
            own = slice(end, end + len(v))
            end += len(v)
            if keep[own].any():
                rows.append((block, (first | v[keep[own]]).tobytes(), (first | v[keep[own] & split[own]]).tobytes()))
        return pd.DataFrame({"block": pd.Series([m[0] for m in rows], dtype="int64"), "value": pd.Series([m[1] for m in rows], dtype="object"), "hot": pd.Series([m[2] for m in rows], dtype="object")})

    return run


def _among(keys: np.ndarray, blobs: list[bytes]) -> np.ndarray:
    known = np.sort(np.frombuffer(b"".join(blobs), np.uint64))
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) and len(keys) else np.zeros(len(keys), bool)


def _distinct(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each string (at ``start`` in ``flat``, of 8 bytes or more) among the distinct ones, and one string of each.

    Strings are told apart by a hash of all their bytes, then compared byte by byte.
    """
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.ndarray((len(flat) - 7,), "<u8", np.ascontiguousarray(flat), 0, (1,))
    steps = [np.minimum(8 * k, size - 8) for k in range(-(-int(size.max()) // 8))]  # the last word of a string ends with it
    with np.errstate(over="ignore"):
        h = size.astype(np.uint64)
        for step in steps:
            h = (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + words[start + step]
        h = mix(h)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    like = first[which]
    if (size[like] != size).any() or any((words[start[like] + step] != words[start + step]).any() for step in steps):  # two strings with one hash
        data, seen = flat.tobytes(), {}
        which = np.array([seen.setdefault(data[a : a + n], len(seen)) for a, n in zip(start.tolist(), size.tolist())])
        return which, np.unique(which, return_index=True)[1]
    order = np.argsort(first)  # as they come first in the text: what is sent of neighbours compresses better
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[which], first[order]


def _candidates(rows: pa.RecordBatch, shared: list[dict], length: int, buckets: int):
    """A block's runs with shared minimizers, the distinct string of each, and start, size, minimizer, bucket and bucket order of these."""
    flat, offs = byte_buffers(rows.column(rows.num_columns - 1))
    runs = Runs(flat, offs, length)
    bucket, short = _places(runs.value, buckets)
    key = bucket.astype(np.uint64) << np.uint64(32) | short
    keep = _among(key, [s["value"] for s in shared])
    runs.only(keep)
    runs.split(_among(key[keep], [s["hot"] for s in shared]), flat, length)
    size = runs.count + length - 1
    which, first = _distinct(flat, runs.start, size)
    value = runs.value[first]
    bucket, _ = _places(value, buckets)
    return flat, offs, runs, which, runs.start[first], size[first], value, bucket, np.argsort(bucket, kind="stable")


def _send(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for block, blob, shared in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                rows = unpacked(blob.as_py())
                flat, _, runs, which, start, size, value, bucket, by = _candidates(rows, shared or [], length, buckets)
                if not len(start):
                    continue
                owner = np.full(len(start), NOBODY)
                np.minimum.at(owner, which, _ids(rows)[runs.doc])
                data, size = flat.tobytes(), size.astype(np.int32)
                edges = np.append(np.flatnonzero(np.diff(bucket[by], prepend=-1)), len(by))
                made = []
                for a, b in zip(edges[:-1], edges[1:]):
                    own = by[a:b]
                    text = press.compress(b"".join([data[x : x + n] for x, n in zip(start[own].tolist(), size[own].tolist())]))
                    made.append((int(bucket[own[0]]), block, text, size[own].tobytes(), value[own].tobytes(), press.compress(owner[own].tobytes())))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["bucket", "block", "strings", "sizes", "value", "owner"])

    return run


def _whole(group: np.ndarray, size: np.ndarray, goal: int) -> Iterator[slice]:
    """Strings ordered by group in parts of about ``goal`` symbols; a group is never cut."""
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else group
    volume = np.cumsum(size)
    lo = 0
    while lo < len(group):
        hi = int(np.searchsorted(volume, (volume[lo - 1] if lo else 0) + goal, "right"))
        after = int(np.searchsorted(heads, max(hi, lo + 1)))
        hi = int(heads[after]) if after < len(heads) else len(group)
        yield slice(lo, hi)
        lo = hi


def _meeting(flat: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings laid end to end have a window with the hash of another window: all that share one, and few more."""
    n = size - length + 1
    stop = np.cumsum(n)
    words = np.ndarray((len(flat) - 7,), "<u8", flat, 0, (1,))
    places = len(flat) - length + 1
    h = np.zeros(places, np.uint64)
    with np.errstate(over="ignore"):
        for step in (*range(0, length - 8, 8), length - 8):
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += words[step : step + places]
        h = mix(h[np.repeat(np.cumsum(size) - size - stop + n, n) + np.arange(stop[-1])])
    ranked = np.sort(h)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return np.zeros(len(size), bool)
    return np.logical_or.reduceat(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h, stop - n)


def _build(length: int):
    """The collections of one bucket; for each block the smallest document of every window it sent."""

    def run(pdf):
        import pandas as pd
        import zstandard

        press, expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        data = b"".join([expand.decompress(t) for t in pdf["strings"]])
        size = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["sizes"]]).astype(np.int64)
        per = [len(x) // 4 for x in pdf["sizes"]]
        start = np.cumsum(size) - size
        which, first = _distinct(np.frombuffer(data, np.uint8), start, size)
        owner = np.full(len(first), NOBODY)
        np.minimum.at(owner, which, np.concatenate([np.frombuffer(expand.decompress(x), np.int64) for x in pdf["owner"]]))
        value = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["value"]])[first]
        start, size = start[first], size[first]
        windows = np.zeros(len(first) + 1, np.int64)
        windows[1:] = np.cumsum(size - length + 1)
        # A string that is alone with its minimizer shares its windows with no other.
        least = np.repeat(owner, size - length + 1)
        _, group, members = np.unique(value, return_inverse=True, return_counts=True)
        order = np.argsort(group, kind="stable")
        order = order[members[group[order]] > 1]

        def laid(own: np.ndarray) -> np.ndarray:
            return np.frombuffer(b"".join([data[a : a + n] for a, n in zip(start[own].tolist(), size[own].tolist())]), np.uint8)

        # Both in parts of whole minimizer groups; equal windows never lie in two of them.
        parts = [order[part] for part in _whole(group[order], size[order], LOOK)]
        order = np.concatenate([order[:0], *(own[_meeting(laid(own), size[own], length)] for own in parts)])
        for part in _whole(group[order], size[order], COLLECTION):
            own = order[part]
            found = window_minima(laid(own), size[own], owner[own], length)
            n = size[own] - length + 1
            least[np.repeat(windows[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = found
        made, at = [], 0
        for block, n in zip(pdf["block"], per):
            own = which[at : at + n]
            at += n
            count = windows[own + 1] - windows[own]
            index = np.repeat(windows[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            made.append((block, press.compress(least[index].tobytes())))
        return pd.DataFrame({"block": pd.Series([m[0] for m in made], dtype="int64"), "bucket": pd.Series([pdf["bucket"].iloc[0]] * len(made), dtype="int64"), "least": pd.Series([m[1] for m in made], dtype="object")})

    return run


def _finish(length: int, buckets: int, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for blob, shared, answers in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows = unpacked(blob.as_py())
                flat, offs, runs, which, start, size, _, bucket, by = _candidates(rows, shared or [], length, buckets)
                hit = np.zeros(len(flat) + length, np.int32)  # windows taken from their start on, behind ``length`` places
                if len(start):
                    answers = sorted(answers, key=lambda a: a["bucket"])
                    least = np.concatenate([np.frombuffer(expand.decompress(a["least"]), np.int64) for a in answers])
                    n = size[by] - length + 1
                    first = np.empty(len(start), np.int64)
                    first[by] = np.cumsum(n) - n
                    local = np.arange(runs.count.sum()) - np.repeat(np.cumsum(runs.count) - runs.count, runs.count)
                    window = np.repeat(runs.start, runs.count) + local
                    source = least[np.repeat(first[which], runs.count) + local]
                    mine = np.repeat(_ids(rows)[runs.doc], runs.count)
                    window = window[(source < mine) & (mine != NOBODY)]
                    hit[window + length] = 1
                np.cumsum(hit, out=hit)
                gone = hit[length:] > hit[: len(flat)]
                data = flat.tobytes()
                kept, spans = [], []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    mark = gone[a:b]
                    if mark.any():
                        edge = np.flatnonzero(np.diff(mark.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                        spans.append([{"start": int(x), "stop": int(y)} for x, y in edge])
                        kept.append(flat[a:b][~mark].tobytes())
                    else:
                        spans.append([])
                        kept.append(data[a:b])
                out = [*rows.columns[:-1], pa.array(np.diff(offs)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, [*rows.schema.names[:-1], "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, as_text: bool = False, hot: int = HOT) -> DataFrame:
    """The ``keep`` columns (default: the id) of every row, n_bytes, spans (removed, [start, stop) bytes) and kept (bytes).

    With ``as_text`` kept is a string; what is left of a character that was cut in part goes too.

    Removed is each byte covered by a ``length``-byte string that also starts in a document with a
    smaller id; strings are judged on the input and never cross documents.  A null text is empty, a
    text shorter than ``length`` stays whole, rows with one id don't affect each other, rows with a
    null id neither lose nor cause anything.  An empty table gives no rows.  ``hot`` only says how the
    work is dealt.
    """
    if length < SEED + 8:
        raise ValueError(f"length must be at least {SEED + 8}")
    keep = [id_col] if keep is None else keep
    spark = docs.sparkSession
    whole = docs.select(F.col(id_col).cast("long").alias("__id"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("__text"))
    blocks = bucketed(whole.mapInArrow(lean(pack_blocks(BLOCK)), SCHEMA), "blocks", "block")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET))  # as many tasks: what one reads doesn't grow with the input
    marks = blocks.select("block", "payload").mapInArrow(lean(_block_rows(length, buckets)), "bucket long, block long, value binary, tally binary")
    shared = marks.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(lean_group(_shared(hot)), "block long, value binary, hot binary")
    shared = cut(shared.groupBy("block").agg(F.collect_list(F.struct("value", "hot")).alias("shared")), "shared")  # of one block, so bounded by it

    with_shared = blocks.select("block", "payload").join(shared.hint("shuffle_hash"), "block", "left")
    sent = with_shared.mapInArrow(lean(_send(length, buckets)), "bucket long, block long, strings binary, sizes binary, value binary, owner binary")
    built = sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(lean_group(_build(length)), "block long, bucket long, least binary")
    built = cut(built.groupBy("block").agg(F.collect_list(F.struct("bucket", "least")).alias("answers")), "built")

    fields = whole.schema.fields[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_bytes long, spans array<struct<start:long,stop:long>>, kept " + ("string" if as_text else "binary")
    told = shared.join(built, "block", "left")
    done = blocks.select("block", "payload").join(told.hint("shuffle_hash"), "block", "left").select("payload", "shared", "answers")
    done = done.mapInArrow(lean(_finish(length, buckets, as_text)), schema)
    return done.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "spans", "kept")
