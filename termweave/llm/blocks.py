"""Documents packed into compressed blocks, the unit in which large texts travel."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from termweave.llm.common import byte_buffers

SCHEMA = "block long, size long, payload binary"


def packed(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_batch(batch)
    return sink.getvalue()


def unpacked(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as source:
        return source.read_next_batch()


def pack_blocks(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, size, payload) of about ``limit`` bytes of text (the last column), more for a longer text.

    The block's number is unique, but it and the block's rows depend on the input's partitions: write
    the result before using it twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        size = made = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, made
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            row = pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([size]), pa.array([packed(whole)], pa.binary())], ["block", "size", "payload"])
            held.clear()
            size, made = 0, made + 1
            return row

        for batch in batches:
            _, offs = byte_buffers(batch.column(batch.num_columns - 1))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit - size, "right")) - 1)
                held.append(batch.slice(lo, hi - lo))
                size += int(offs[hi] - offs[lo])
                lo = hi
                if size >= limit or lo < batch.num_rows:
                    yield flush()
        if held:
            yield flush()

    return run
