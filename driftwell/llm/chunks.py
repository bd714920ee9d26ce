"""Rows of a frame, packed some megabytes at a time into files that keep to themselves.

A second pass over a table must meet the very rows that the first one met together, in the same
order. Splits of a scan don't promise that, and shuffling whole texts once for each pass is
costly. So the rows a job needs are written once as files of the shared folder, and later passes
name the file. Files of tasks that failed are never listed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import byte_view, in_steps, read_file, stored, work_folder, write_file
from driftwell.llm.words import find_words

CHUNK_BYTES = 16 << 20
#: Bytes of text at a time; hashing takes about 50 bytes of arrays for each.
STEP = 1 << 19
SCHEMA = "chunk string, n_docs bigint, n_words bigint"


def _pack(batches: Sequence[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def write_chunks(df: DataFrame, text_col: str, columns: Sequence[str], size: int = CHUNK_BYTES) -> DataFrame:
    """Write the named columns in chunks of about ``size`` bytes of text and return the stored list of files."""
    folder = work_folder(df.sparkSession, "chunks")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_bytes, n_words = [], 0, 0

        def flush() -> pa.RecordBatch:
            uri = write_file(folder, f"{uuid.uuid4().hex}.arrow", _pack(held))
            return pa.RecordBatch.from_pylist([{"chunk": uri, "n_docs": sum(b.num_rows for b in held), "n_words": n_words}])

        for batch in in_steps(batches, text_col, STEP):
            held.append(batch)
            data, offsets = byte_view(batch.column(text_col))
            n_bytes += len(data)
            n_words += int(find_words(data, offsets)[1].sum())
            if n_bytes >= size:
                yield flush()
                held, n_bytes, n_words = [], 0, 0
        if held:
            yield flush()

    return stored(df.select(*columns).mapInArrow(write, SCHEMA), "chunk-list")


def read_chunk(uri: str, text_col: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a chunk in order, ``STEP`` bytes of text at a time, with the bytes of their texts."""
    table = pa.ipc.open_file(pa.BufferReader(read_file(uri))).read_all()
    for batch in in_steps(iter(table.to_batches()), text_col, STEP):
        yield batch, *byte_view(batch.column(text_col))


def tasks(chunks: DataFrame, n: int) -> DataFrame:
    """The list dealt out evenly over ``n`` tasks."""
    return chunks.repartition(n)


def totals(chunks: DataFrame) -> tuple[int, int]:
    """Number of chunks and of words."""
    row = chunks.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    return row[0], row[1]


def null_mask(column: pa.Array) -> np.ndarray:
    return pc.is_null(column).to_numpy(zero_copy_only=False)
