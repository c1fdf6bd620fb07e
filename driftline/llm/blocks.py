"""Texts in blocks of the shared folder, read again by the tasks that work on
them, so that what later passes shuffle is replies and never the texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame

from driftline.llm.common import map_batches, materialize, open_read, open_write, scratch_path

#: Bytes of text in a block; a longer text is a block by itself.
BLOCK = 16 << 20
_COPY = pa.ipc.IpcWriteOptions(compression="zstd")


def _write(root: str, text: str, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file for each run of rows of about ``limit`` bytes. A task that runs
    again writes files of its own; only those of the task that counts are listed."""
    context = TaskContext.get()
    held, size, number = [], 0, 0

    def flush() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        path = f"{root}/{context.partitionId()}-{number}-{context.taskAttemptId()}.arrow"
        with open_write(path) as f, pa.ipc.new_file(f, rows.schema, options=_COPY) as out:
            out.write_table(rows)
        block = (context.partitionId() << 32) + number
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([path]), pa.array([rows.num_rows]), pa.array([size])], names=["block", "path", "n_rows", "n_bytes"])

    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield flush()
                held, size, start, number = [], 0, i, number + 1
            size += n + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield flush()


def write_blocks(df: DataFrame, text: str, label: str, limit: int = BLOCK) -> DataFrame:
    """(block, path, n_rows, n_bytes) of the files that hold the rows of ``df``."""
    root = scratch_path(df.sparkSession, label + "-files")
    return materialize(map_batches(df, partial(_write, root, text, limit), "block long, path string, n_rows long, n_bytes long"), label)


def read_block(path: str) -> pa.Table:
    with open_read(path) as f:
        return pa.ipc.open_file(f).read_all()


def read_bytes(path: str) -> bytes:
    with open_read(path) as f:
        return f.read()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed piece, by Arrow."""
    rows = pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.large_binary()) for a in arrays], names=[str(i) for i in range(len(arrays))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=_COPY) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes, *kinds: object) -> list[np.ndarray]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    return [np.frombuffer(batch.column(i)[0].as_buffer(), dtype=k) for i, k in enumerate(kinds)]
