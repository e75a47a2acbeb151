"""SentencePiece encoding through a relational lattice, and decoding.

Texts are cut where no piece of the model can reach across (two neighbouring characters that no piece
holds side by side), so the words between cuts can be encoded on their own.  The distinct words of
the corpus are exploded into their bounded-length substrings, equi-joined to the piece table, the
edges found are grouped by word, and a higher-order aggregate folds them once from first to last.
For unigram models the fold is Viterbi: edges come by their end, and the state holds the best path to
each place.  BPE models merge by score, and the path of the best sum would give other ids than the
library; for them edges come by score, the state holds the boundaries left, and an edge that spans
exactly two parts removes the boundary between them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.blocks import SCHEMA, pack_blocks, unpacked
from termweave.llm.common import bucketed, byte_buffers, cut, drop_cut, lean, partitions, release, slices
from termweave.llm.piece_model import BPE, BYTE, CONTROL, NORMAL, SPACE, UNKNOWN, PieceModel
from termweave.llm.shingles import mix, ring

BLOCK = 16 << 20  # bytes of text of a block
SLICE = 1 << 19  # bytes of text cut into units at once, but for a longer text
KEY = 64  # characters of a unit from which its hash takes its place as a key
PART = 64  # places of a unit whose substrings are taken from one part of it
STRIDE = 32  # places from one word of the boundaries to the next; a word holds twice as many
SAMPLE, COMMON = 8, 1 << 17  # blocks looked at for common units, and how many of these are told to all tasks
UNKNOWN_PENALTY = 10.0


class Cutter:
    """Cuts normalized text between characters that no piece holds side by side."""

    def __init__(self, model: PieceModel) -> None:
        pairs = {(a, b) for p, _, _ in model.vocabulary for a, b in zip(p, p[1:])}
        chars = sorted({c for pair in pairs for c in pair})
        self.index = np.zeros(0x110000, np.int32)
        self.index[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        number = {c: i for i, c in enumerate(chars, 1)}
        self.joined = np.zeros(self.width * self.width, bool)
        self.joined[[number[a] * self.width + number[b] for a, b in pairs]] = True
        self.dummy_prefix = model.dummy_prefix

    def slices(self, texts: pa.Array):
        """For each slice of the texts: their count, the slice's distinct units, and of each text's units in order the number there.

        Units are told apart by a hash of their characters, then compared character by character.
        """
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        offs = byte_buffers(texts)[1]
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE, "right")) - 1)
            part = pc.replace_substring(texts.slice(lo, hi - lo), " ", SPACE)
            if self.dummy_prefix:
                part = pc.if_else(pc.equal(pc.binary_length(part), 0), "", pc.binary_join_element_wise(SPACE, part, ""))
            chars = np.cumsum(np.append(0, np.asarray(pc.utf8_length(part)))).astype(np.int64)
            whole = byte_buffers(part)[0].tobytes().decode("utf-8", "replace")
            yield hi - lo, *self._units(whole, chars)
            lo = hi

    def _units(self, whole: str, chars: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct units of a slice, the number of each unit's text in it, and the count of units of each text."""
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        if not n:
            return [], np.zeros(0, np.int64), np.zeros(len(chars) - 1, np.int64)
        i = self.index[code]
        begins = np.ones(n, bool)
        begins[1:] = ~self.joined[i[:-1] * self.width + i[1:]]
        begins[chars[:-1][chars[:-1] < n]] = True
        start = np.flatnonzero(begins)
        stop = np.append(start[1:], n)
        power, inverse = ring(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
            h = mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        rep = start[first]
        size = stop - start
        same = np.repeat(rep[which] - start, size) + np.arange(n)
        if (size[first][which] != size).any() or (code[np.minimum(same, n - 1)] != code).any():  # two units with one hash
            names = [whole[a:b] for a, b in zip(start.tolist(), stop.tolist())]
            units = sorted(set(names))
            place = {u: k for k, u in enumerate(units)}
            which = np.array([place[u] for u in names])
        else:
            units = [whole[a:b] for a, b in zip(rep.tolist(), (rep + size[first]).tolist())]
        return units, which, np.diff(np.searchsorted(start, chars))


def unit_key(unit: str) -> str:
    """The unit, or for a long one a hash that no short unit can equal: what rows are grouped by stays short."""
    return unit if len(unit) <= KEY else "\0" + hashlib.sha256(unit.encode()).hexdigest()


def _units_of(cutter: Cutter, texts: pa.Array, common: Known) -> list[str]:
    """The distinct units of a block's texts that aren't common ones, in order."""
    seen: set[str] = set()
    for _, units, _, _ in cutter.slices(texts):
        seen.update(units)
    return sorted(seen.difference(common.number))


@dataclass
class Known:
    """Units and their ids, laid end to end."""

    number: dict[str, int]
    ids: np.ndarray
    ends: np.ndarray

    def numbers(self, units: list[str], others: dict[str, int]) -> np.ndarray:
        """The number of each unit; those not known are counted on from these in ``others``, as they come."""
        own, n = self.number.get, len(self.number)
        return np.fromiter((k if (k := own(u)) is not None else others.setdefault(u, n + len(others)) for u in units), np.int32, len(units))

    def laid(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ends of these and of the units whose ids are given."""
        ends = self.ends[-1] + np.cumsum(np.asarray(lists.value_lengths()), dtype=np.int64)
        return np.append(self.ids, np.asarray(lists.flatten()).astype("<u4")), np.append(self.ends, ends)


def _counted_units(model: PieceModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(model)
        for batch in batches:
            for blob in batch.column(0):
                rows = unpacked(blob.as_py())
                seen: Counter = Counter()
                for _, units, which, _ in cutter.slices(rows.column(rows.num_columns - 1)):
                    seen.update(dict(zip(units, np.bincount(which, minlength=len(units)).tolist())))
                found = [(u, n) for u, n in seen.items() if len(u) <= KEY]
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["key", "n"])

    return run


def _common(blocks: DataFrame, model: PieceModel) -> Known:
    """The most common units of a few blocks with their ids, at most COMMON of KEY characters: each task can hold them.

    They are encoded once, and only other units have to travel; which ones they are changes no result.
    """
    some = [r["block"] for r in blocks.select("block").orderBy(F.xxhash64("block"), "block").limit(SAMPLE).collect()]
    counted = blocks.where(F.col("block").isin(some)).select("payload").mapInArrow(lean(_counted_units(model)), "key string, n long")
    top = counted.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(COMMON)
    top = top.select("key", F.lit(None).cast("string").alias("long")).repartition(partitions(blocks.sparkSession), "key")
    rows = encode_units(top, model).toArrow().combine_chunks()
    none = Known({}, np.zeros(0, "<u4"), np.zeros(1, np.int64))
    return Known({u: k for k, u in enumerate(rows.column("key").to_pylist())}, *none.laid(rows.column("ids").combine_chunks())) if rows.num_rows else none


def _distinct_units(model: PieceModel, common: Known):
    def of_block(cutter: Cutter, block: int, blob: bytes) -> Iterator[pa.RecordBatch]:
        rows = unpacked(blob)
        units = _units_of(cutter, rows.column(rows.num_columns - 1), common)
        for at in range(0, len(units), 50_000):
            part = units[at : at + 50_000]
            n = len(part)
            place = np.arange(at, at + n, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.array(place), pa.array(list(map(unit_key, part)), pa.string()), pa.array([u if len(u) > KEY else None for u in part], pa.string())],
                ["block", "place", "key", "long"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(model)
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from of_block(cutter, block, blob.as_py())
                release()

    return run


def _bits(x, by: int, wide: int):
    return F.shiftrightunsigned(x, by).bitwiseAND((1 << wide) - 1)


# The code of a piece is its id, that of an unknown character the count of ids + the character; codes
# beyond stand for several ids.  An edge of a BPE word is a struct: its order (rank, first place, size),
# its code, and its ends and inner places as bits of one word of the boundaries.  An edge of a unigram
# word is one number, from high to low its last place, size and code.
CODE, SIZE, PLACE = 22, 6, 35


def _merged(edges):
    """Codes of a BPE word: one pass over the edges, the best first.

    Boundaries are words of 64 places, one for each STRIDE places, so each edge lies within one.
    """

    def step(state, x):
        word = x["word"]

        def without(v, j):
            gone = F.get(state, word).bitwiseAND(x["inner"])
            near = F.when(j == word, gone).when(j > word, F.shiftrightunsigned(gone, STRIDE)).otherwise(F.shiftleft(gone, STRIDE))
            return F.when(F.abs(j - word) < 2, v.bitwiseAND(F.bitwise_not(near))).otherwise(v)

        seen = F.get(state, word)
        fits = (seen.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(seen.bitwiseAND(x["inner"])) == 1)
        return F.when(fits, F.transform(state, without)).otherwise(state)

    wide = F.filter(edges, lambda x: x["inner"] != 0)
    n = F.size(edges) - F.size(wide)  # each place has one edge of one character
    full = F.array_repeat(F.lit(-1).cast("long"), F.shiftright(n, 5) + 1)

    def path(state):
        left = F.filter(edges, lambda x: F.get(state, x["word"]).bitwiseAND(x["ends"].bitwiseOR(x["inner"])) == x["ends"])
        return F.transform(F.array_sort(F.transform(left, lambda x: F.struct(x["first"], x["code"]))), lambda x: x["code"])

    return F.aggregate(wide, full, step, path)


def _best_path(edges, score_of_id, ids: int, floor: float):
    """Codes of a unigram word: the best path, of equal ones that with the earlier start of its last piece."""
    code = lambda x: x.bitwiseAND((1 << CODE) - 1).cast("int")
    size = lambda x: _bits(x, CODE, SIZE).cast("int")
    last = lambda x: F.shiftrightunsigned(x, CODE + SIZE).cast("int")
    worth = lambda x: F.when(code(x) < ids, F.get(score_of_id, code(x))).otherwise(F.lit(floor).cast("float"))

    def step(state, x):  # the state has an entry for each place from 0 on; the edges of one end come the shortest first
        made = F.struct((F.get(state, last(x) - size(x))["score"] + worth(x)).alias("score"), x.alias("edge"))
        shorter = F.when(made["score"] >= F.element_at(state, -1)["score"], F.concat(F.slice(state, F.lit(1), F.size(state) - 1), F.array(made))).otherwise(state)
        return F.when(size(x) == 1, F.concat(state, F.array(made))).otherwise(shorter)

    def path(state):  # from the end back, each step names the place where its piece begins
        back = F.aggregate(
            F.sequence(F.size(state) - 1, F.lit(1), F.lit(-1)),
            F.struct((F.size(state) - 1).alias("at"), F.array().cast("array<int>").alias("codes")),
            lambda s, i: F.when(s["at"] == i, F.struct((i - size(F.get(state, i)["edge"])).alias("at"), F.concat(s["codes"], F.array(code(F.get(state, i)["edge"]))).alias("codes"))).otherwise(s),
        )
        return F.reverse(back["codes"])

    start = F.array(F.struct(F.lit(0.0).cast("float").alias("score"), F.lit(0).cast("long").alias("edge")))
    return F.aggregate(edges, start, step, path)


def _as_ids(codes, model: PieceModel, beyond: list[list[int]]):
    """Ids of codes: a character that is no piece becomes the ids of its UTF-8 bytes, or the unknown id."""
    ids = len(model.pieces)
    known = F.array(*map(F.lit, model.bytes_ids or []))

    def of(c):
        x = c - ids
        tail = lambda by: F.get(known, F.shiftright(x, by).bitwiseAND(63) + 128)
        head = lambda by, mark: F.get(known, F.shiftright(x, by) + mark)
        three = F.when(x < 0x10000, F.array(head(12, 0xE0), tail(6), tail(0))).otherwise(F.array(head(18, 0xF0), tail(12), tail(6), tail(0)))
        found = F.when(c < ids, F.array(c))
        for i, more in enumerate(beyond):
            found = found.when(c == ids + 0x110000 + i, F.array(*map(F.lit, more)))
        if not model.bytes_ids:
            return found.otherwise(F.array(F.lit(model.unknown)))
        return found.when(x < 0x80, F.array(head(0, 0))).when(x < 0x800, F.array(head(6, 0xC0), tail(0))).otherwise(three)

    # The fold is named once: an expression named several times would be computed as often.
    each = F.transform(F.array(codes), lambda cs: F.when(F.exists(cs, lambda c: c >= ids), F.flatten(F.transform(cs, of))).otherwise(cs))
    return F.get(each, F.lit(0))


def encode_units(units: DataFrame, model: PieceModel) -> DataFrame:
    """(key, ids) of the distinct units given by ``key`` (see :func:`unit_key`) and, where it is a hash, ``long``.

    Dealt by a hash of the key the rows stay where they are.
    """
    spark = units.sparkSession
    ids = len(model.pieces)
    ranked, beyond = model.ranked()
    if max((len(p) for p, _, _ in ranked), default=1) > STRIDE or ids + 0x110000 + 2 * len(ranked) >= 1 << CODE:
        raise ValueError("the model's pieces are too long or too many")
    # The piece table has the model's size, whatever the corpus.
    pieces = spark.createDataFrame([*ranked, *((p, i, -1) for p, i, _ in model.vocabulary if len(p) == 1)], "piece string, id int, rank int")
    widest = max([1, *(len(p) for p, _, _ in ranked)])
    text = F.coalesce("long", "key")
    parts = units.select("key", F.length(text).alias("n"), text.alias("text"), F.explode(F.sequence(F.lit(0), F.shiftright(F.length(text) - 1, 6))).alias("part"))
    parts = parts.select("key", "n", (F.col("part") * PART).alias("base"), F.substring("text", F.col("part") * PART + 1, F.lit(PART + widest - 1)).alias("text"))
    spots = parts.select("key", "n", "base", "text", F.explode(F.sequence(F.lit(1), F.least(F.lit(PART), F.col("n") - F.col("base")))).alias("at"))
    spots = spots.select("key", "base", "text", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(widest), F.col("n") - F.col("base") - F.col("at") + 1))).alias("size"))
    spots = spots.select("key", (F.col("base") + F.col("at") - 1).cast("long").alias("first"), "size", F.substring("text", F.col("at"), F.col("size")).alias("piece"))
    found = spots.join(F.broadcast(pieces), "piece", "left").where("id is not null or size = 1")  # single characters keep each place's row
    code = F.coalesce("id", F.ascii("piece") + ids).cast("long")
    shift = lambda x, by: F.shiftleft(x.cast("long"), by)
    if model.kind == BPE:
        off = F.col("first").bitwiseAND(STRIDE - 1).cast("int")
        bits = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), by)
        order = shift(F.when(F.col("size") > 1, F.col("rank")).otherwise(len(ranked)), PLACE + SIZE) + shift(F.col("first"), SIZE) + F.col("size")
        edge = F.struct(
            order.alias("order"),
            F.col("first"),
            code.cast("int").alias("code"),
            F.shiftright("first", 5).cast("int").alias("word"),
            (bits(off) + bits(off + F.col("size"))).alias("ends"),
            (bits(off + F.col("size")) - bits(off + 1)).alias("inner"),
        )
        codes = _merged(F.col("edges"))
    else:
        edge = shift(F.col("first") + F.col("size"), SIZE + CODE) + shift(F.col("size"), CODE) + code
        worth = F.expr(f"cast(split('{','.join(repr(float(np.float32(s))) for _, s, _ in model.pieces)}', ',') as array<float>)")
        floor = min((s for _, _, s in model.vocabulary), default=0.0) - UNKNOWN_PENALTY
        codes = _best_path(F.col("edges"), worth, ids, floor)
    grouped = found.select("key", edge.alias("edge")).groupBy("key").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    return grouped.select("key", codes.alias("codes")).select("key", _as_ids(F.col("codes"), model, beyond).alias("ids"))


class Decoder:
    """Texts of ids, on arrays."""

    def __init__(self, model: PieceModel) -> None:
        self.hidden = np.array([t == CONTROL for _, _, t in model.pieces])
        as_bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in model.pieces]
        self.pool, self.width = np.frombuffer(b"".join(as_bytes), np.uint8), np.array(list(map(len, as_bytes)))
        self.begin = np.cumsum(self.width) - self.width
        self.lead = np.array([t == NORMAL and p.startswith(SPACE) for p, _, t in model.pieces]) & model.dummy_prefix

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of rows whose ids are laid end to end; ``ends`` are the n + 1 offsets."""
        at, size = self.begin[ids], self.width[ids]
        shown = np.flatnonzero(~self.hidden[ids])
        if len(shown):  # the blank put before a text goes again
            first = shown[np.minimum(np.searchsorted(shown, ends[:-1]), len(shown) - 1)]
            first = np.unique(first[(first >= ends[:-1]) & (first < ends[1:])])
            first = first[self.lead[ids[first]]]
            at[first] += 1
            size[first] -= 1
        stop = np.append(0, np.cumsum(size))
        raw = self.pool[np.repeat(at - stop[:-1], size) + np.arange(stop[-1])].tobytes()
        edge = stop[ends].tolist()
        return [raw[x:y].decode("utf-8", "replace") for x, y in zip(edge[:-1], edge[1:])]


def _decode(model: PieceModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            flat, offs = byte_buffers(batch.column(batch.num_columns - 1))
            texts: list[str] = []
            for _, _, part, ends in slices(flat, offs):
                texts += decoder.texts(part.view("<u4"), ends // 4)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "decoded"])

    return run


def _assemble(model: PieceModel, with_text: bool, decoded: bool, common: Known):
    def of_block(cutter: Cutter, decoder: Decoder, blob: bytes, answer: pa.Scalar) -> Iterator[pa.RecordBatch]:
        rows = unpacked(blob)
        others: dict[str, int] = {}
        cuts = []  # of each slice its count of texts, its units' numbers in order, and each text's count of them
        for count, units, which, per in cutter.slices(rows.column(rows.num_columns - 1)):
            cuts.append((count, common.numbers(units, others)[which], per.astype(np.int32)))
        n = len(common.number)
        ids, ends = common.ids, common.ends
        moved = np.arange(n + len(others), dtype=np.int32)
        if others:
            places, lists = answer.values.field(0), answer.values.field(1)
            in_order = np.fromiter(map(others.__getitem__, sorted(others)), np.int32, len(others))
            del others
            if len(places) != len(in_order):
                raise ValueError("units of a block have no ids")
            moved[in_order[np.asarray(places)]] = np.arange(n, len(moved))
            ids, ends = common.laid(lists)
        at = 0
        for count, of, per in cuts:
            of = moved[of]
            size = ends[of + 1] - ends[of]
            stop = np.append(0, np.cumsum(size))
            made = ids[np.repeat(ends[of] - stop[:-1], size) + np.arange(stop[-1])]
            edge = stop[np.append(0, np.cumsum(per))]
            part = rows.slice(at, count)
            kept = part.columns if with_text else part.columns[:-1]
            blobs = [made[x:y].tobytes() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
            made = [pa.array(np.diff(edge)), pa.array(blobs, pa.binary()), *([pa.array(decoder.texts(made, edge), pa.string())] if decoded else [])]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*rows.schema.names[: len(kept)], "n_ids", "ids", *(["decoded"] if decoded else [])])
            at += count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, decoder = Cutter(model), Decoder(model)
        for batch in batches:
            for k in range(batch.num_rows):
                yield from of_block(cutter, decoder, batch.column(0)[k].as_py(), batch.column(1)[k])
                release()

    return run


def encode(docs: DataFrame, model: PieceModel | str, keep: list[str] | None = None, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """The ``keep`` columns (default: doc_id) of every row, n_ids, and ids (little-endian unsigned 32-bit).

    With ``decoded`` the text decoded from the ids stands beside them, as :func:`decode` gives it.

    ``model`` is a model or the path of its file.  The ids are those of the sentencepiece library,
    without begin and end ids.  A null or empty text has none; words of any length go the same way; a
    word of n characters costs some n * n / 32 steps, which only texts of a million characters without
    a cut make felt.  Repeated rows are encoded each; an empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    spark: SparkSession = docs.sparkSession
    model = PieceModel.load(model) if isinstance(model, str) else model
    others = [c for c in keep if c != text_col]
    whole = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(others)], F.col(text_col).cast("string").alias("__text"))
    blocks = bucketed(whole.mapInArrow(lean(pack_blocks(BLOCK)), SCHEMA), "texts", "block")
    n = partitions(spark)
    # Groups come one after another; the default would sort all edges after a few of them.
    limit = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "20000")
    try:
        common = _common(blocks, model)
        uses = cut(blocks.select("block", "payload").mapInArrow(_distinct_units(model, common), "block long, place int, key string, long string"), "units")  # read twice
        coded = encode_units(uses.select("key", "long").repartition(n, "key").distinct(), model)
        answers = uses.select("block", "place", "key").repartition(n, "key").join(coded.hint("shuffle_hash"), "key").select("block", "place", "ids")
        answers = cut(answers, "coded")
    finally:
        spark.conf.set(limit, before)
    drop_cut(uses)
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("place", "ids")).alias("answers"))  # bounded by the block's text
    fields = [f for f in whole.schema.fields[:-1]] + ([whole.schema.fields[-1]] if text_col in keep else [])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_ids long, ids binary" + ", decoded string" * decoded
    done = blocks.join(answers.hint("shuffle_hash"), "block", "left").select("payload", "answers").mapInArrow(_assemble(model, text_col in keep, decoded, common), schema)
    names = {c: f"__k{i}" for i, c in enumerate(others)} | {text_col: "__text"}
    return done.select(*[F.col(names[c]).alias(c) for c in keep], "n_ids", "ids", *(["decoded"] if decoded else []))


def decode(rows: DataFrame, model: PieceModel | str, keep: list[str] | None = None, ids_col: str = "ids") -> DataFrame:
    """The ``keep`` columns and decoded, the text of each row's ids; null ids give the empty text."""
    keep = ["doc_id"] if keep is None else keep
    model = PieceModel.load(model) if isinstance(model, str) else model
    kept = rows.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(ids_col).cast("binary").alias("__ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", decoded string"
    out = kept.mapInArrow(_decode(model), schema)
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "decoded")
