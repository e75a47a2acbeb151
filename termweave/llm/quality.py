"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over overlapping chunks that cover the whole document, each
filter is max-pooled per chunk, and the document's probability combines the mean and the maximum of
its chunks' pooled features.  The network is fitted on the driver on a bounded sample of labelled
rows; scoring runs over whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import byte_buffers, crc_bucket, lean, slices

WIDTH, STRIDE, DIM, FILTERS = 12, 4, 6, 24
CHUNK, STEP = 512, 448  # chunks overlap by 64 bytes; both are multiples of STRIDE
PAD = 256  # the symbol behind a document's end


@dataclass
class ByteConvNet:
    embed: np.ndarray  # (257, DIM); the last row, for padding, stays zero
    filters: np.ndarray  # (WIDTH * DIM, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    mix: np.ndarray  # (2 * FILTERS,): mean part, then maximum part
    base: float

    def windows(self, symbols: np.ndarray) -> np.ndarray:
        """(n, WIDTH * DIM) inputs of the filters, one row for each STRIDE symbols."""
        flat = self.embed[symbols].ravel()
        n = (len(symbols) - WIDTH) // STRIDE + 1
        view = np.lib.stride_tricks.as_strided(flat, (n, WIDTH * DIM), (STRIDE * DIM * 4, 4))
        return np.ascontiguousarray(view)

    def responses(self, symbols: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        out = []
        for at in range(0, max(1, len(symbols) - WIDTH + 1), block):
            part = symbols[at : at + block + WIDTH - STRIDE]
            if len(part) >= WIDTH:
                out.append(self.windows(part) @ self.filters)
        return np.maximum(np.concatenate(out) + self.bias, 0)

    def scores(self, flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for all documents of a buffer."""
        n = len(offs) - 1
        if n == 0:
            return np.zeros(0)
        symbols, first, last = laid_out(flat, offs)
        r = self.responses(symbols)
        # The starts and ends of all chunks, in filter positions.
        size = last - first + 1
        per = 1 + np.maximum(0, -(-(size - CHUNK // STRIDE) // (STEP // STRIDE)))
        doc = np.repeat(np.arange(n), per)
        k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        start = first[doc] + k * (STEP // STRIDE)
        stop = np.minimum(start + CHUNK // STRIDE, last[doc] + 1)
        bounds = np.stack([start, np.minimum(stop, len(r))], 1).ravel()
        # a row behind the end lets the last bound be given; every second result is a gap and dropped
        pooled = np.maximum.reduceat(np.concatenate([r, np.zeros((1, FILTERS), r.dtype)]), bounds, axis=0)[::2]
        heads = np.cumsum(per) - per
        mean = np.add.reduceat(pooled, heads, axis=0) / per[:, None]
        most = np.maximum.reduceat(pooled, heads, axis=0)
        z = np.concatenate([mean, most], 1) @ self.mix + self.base
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -40, 40)))


def laid_out(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents padded to multiples of STRIDE with room for one filter; first and last filter position of each."""
    size = np.diff(offs)
    room = -(-np.maximum(size, 1) // STRIDE) * STRIDE + -(-WIDTH // STRIDE) * STRIDE
    at = np.cumsum(room) - room
    symbols = np.full(room.sum(), PAD, np.int16)
    symbols[np.arange(len(flat)) + np.repeat(at - offs[:-1], size)] = flat
    first = at // STRIDE
    return symbols, first, first + np.maximum(0, (np.maximum(size, 1) - 1) // STRIDE)


def fit(chunks: list[bytes], owner: np.ndarray, labels: np.ndarray, steps: int = 450, batch: int = 64, seed: int = 7) -> ByteConvNet:
    """Adam on the log loss for a number of steps; ``owner`` says which document (index into ``labels``) a chunk belongs to.

    With no rows, or with one label only, the network is constant at the smoothed share of label 1.
    """
    rng = np.random.RandomState(seed)
    n = len(labels)
    share = (labels.sum() + 1) / (n + 2) if n else 0.5
    net = ByteConvNet(
        np.concatenate([rng.randn(256, DIM) * 0.5, np.zeros((1, DIM))]).astype(np.float32),
        (rng.randn(WIDTH * DIM, FILTERS) * (2 / (WIDTH * DIM)) ** 0.5).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        np.zeros(2 * FILTERS, np.float32),
        float(np.log(share / (1 - share))),
    )
    if n == 0 or labels.min() == labels.max():
        return net
    net.mix = (rng.randn(2 * FILTERS) * 0.1).astype(np.float32)
    full = CHUNK + WIDTH
    grid = np.full((len(chunks), full), PAD, np.int16)
    size = np.zeros(len(chunks), int)
    for i, c in enumerate(chunks):
        size[i] = max(1, -(-min(len(c), CHUNK) // STRIDE))
        grid[i, : min(len(c), CHUNK)] = np.frombuffer(c[:CHUNK], np.uint8)
    places = CHUNK // STRIDE
    weight = np.where(labels == 1, n / (2 * labels.sum()), n / (2 * (n - labels.sum())))
    of_doc = [np.flatnonzero(owner == d) for d in range(n)]
    state: dict[str, tuple] = {}
    step = 0
    while step < steps:
        shuffled = rng.permutation(n)
        for at in range(0, n, batch):
            rate = 0.01 * max(0.0, 1 - step / steps) + 0.0005
            docs = [d for d in shuffled[at : at + batch] if len(of_doc[d])]
            if not docs:
                continue
            rows = np.concatenate([of_doc[d] for d in docs])
            per = np.array([len(of_doc[d]) for d in docs])
            heads = np.cumsum(per) - per
            # forward
            x = np.stack([net.windows(g)[:places] for g in grid[rows]])  # chunk, place, inputs
            h = x @ net.filters + net.bias
            h[np.arange(places)[None, :] >= size[rows][:, None]] = -1
            where = h.argmax(1)
            pooled = np.maximum(np.take_along_axis(h, where[:, None, :], 1)[:, 0], 0)
            mean = np.add.reduceat(pooled, heads, axis=0) / per[:, None]
            most = np.maximum.reduceat(pooled, heads, axis=0)
            both = np.concatenate([mean, most], 1)
            y, w = labels[docs], weight[docs]
            p = 1 / (1 + np.exp(-np.clip(both @ net.mix + net.base, -30, 30)))
            # backward
            dz = ((p - y) * w / len(docs)).astype(np.float32)
            dboth = dz[:, None] * net.mix
            doc = np.repeat(np.arange(len(docs)), per)
            top = pooled == most[doc]
            dpool = dboth[doc, :FILTERS] / per[doc][:, None] + dboth[doc, FILTERS:] * top
            dpool = np.where(pooled > 0, dpool, 0).astype(np.float32)
            best = np.take_along_axis(x, where[:, :, None], 1)  # chunk, filter, inputs
            grads = {
                "filters": np.einsum("cfi,cf->if", best, dpool) + 1e-5 * net.filters,
                "bias": dpool.sum(0),
                "mix": both.T @ dz + 1e-4 * net.mix,
            }
            dx = dpool[:, :, None] * net.filters.T[None]  # chunk, filter, inputs
            hit = grid[rows][np.arange(len(rows))[:, None, None], where[:, :, None] * STRIDE + np.arange(WIDTH)]
            dembed = np.zeros_like(net.embed)
            np.add.at(dembed, hit.ravel(), dx.reshape(-1, DIM))
            dembed[PAD] = 0
            grads["embed"] = dembed
            step += 1
            for name, g in grads.items():
                m, v = state.get(name, (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                state[name] = (m, v)
                setattr(net, name, (getattr(net, name) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32))
            net.base -= rate * float(dz.sum())
    return net


def chunks_of(data: bytes) -> list[bytes]:
    """All chunks of a text; they overlap and cover it."""
    return [data[at : at + CHUNK] for at in range(0, max(1, len(data) - CHUNK + STEP), STEP)]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 2400, max_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ByteConvNet:
    """Fit on at most ``max_rows`` labelled rows whose crc32(id) mod 5 isn't 0, up to half of them of label 0.

    Rows are taken by a hash of the id, as long as their texts have at most ``max_bytes`` together (a
    longer text is passed over), so the sample is bounded whatever the corpus; all chunks of a row
    taken are used.  Null ids and labels are left out, as are ids with different labels; of an id with
    several texts one is taken by a hash.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_bucket("doc_id", 5) != 0))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    by_hash = [F.xxhash64("doc_id"), "doc_id"]
    bad = known.where("label = 0").orderBy(*by_hash).limit(max_rows // 2)
    good = known.where("label = 1").orderBy(*by_hash).limit(max_rows // 2)
    picked = [(r["doc_id"], r["label"]) for r in bad.unionAll(good).collect()]  # max_rows ids
    if not picked:
        return fit([], np.zeros(0, int), np.zeros(0))
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, label int")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("t")).join(F.broadcast(ids), "doc_id")
    texts = texts.where(F.length("t") <= max_bytes).select("doc_id", "label", F.length("t").alias("size"), F.xxhash64("t").alias("h"), "t")
    # The sizes first, so that only what is used comes to the driver.
    sizes = texts.groupBy("doc_id", "label").agg(F.min(F.struct("h", "size")).alias("x")).select("doc_id", "label", "x.h", "x.size", F.xxhash64("doc_id").alias("order")).collect()
    room, chosen = max_bytes, []
    for r in sorted(sizes, key=lambda r: (r["order"], r["doc_id"])):
        if r["size"] <= room:
            room -= r["size"]
            chosen.append((r["doc_id"], r["h"]))
    some = docs.sparkSession.createDataFrame(chosen, "doc_id long, h long")
    rows = texts.join(F.broadcast(some), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "label", "t").collect()  # max_bytes
    rows.sort(key=lambda r: r["doc_id"])
    chunks = [chunks_of(bytes(r["t"])) for r in rows]
    return fit([c for own in chunks for c in own], np.repeat(np.arange(len(rows)), list(map(len, chunks))), np.array([float(r["label"]) for r in rows]))


def _scorer(net: ByteConvNet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offs = byte_buffers(batch.column(batch.num_columns - 1))
            parts = [net.scores(*part) for _, _, *part in slices(flat, offs, 1 << 19)]
            score = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], [*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, net: ByteConvNet, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns of every row and ``name``, the probability of label 1 of the whole text.

    A null text counts as empty; an empty text has the score of padding alone, between 0 and 1.
    """
    keep = ["doc_id"] if keep is None else keep
    kept = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", score double"
    return kept.mapInArrow(lean(_scorer(net)), schema).select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(name))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; see :func:`train` and :func:`score`."""
    net = train(docs, labels)
    return score(docs, net).select(
        "doc_id",
        (crc_bucket("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
    )
