"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.session import checkpoint_dir

#: Bytes of text that a task turns into arrays at a time.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run inside the folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there: later steps see one and the
    same result, and a lost executor costs a reread only. ``zstd`` takes less disk where texts are stored."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_held_out(doc_id: Column) -> Column:
    """Rows that nothing may be learned from: crc32 of the id as text leaves 2 when divided by 4.
    False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def may_teach(doc_id: Column) -> Column:
    return doc_id.isNotNull() & ~is_held_out(doc_id)


def least_hashes(df: DataFrame, n: int, total: int, h: Column) -> DataFrame:
    """About ``2 * n`` of ``total`` rows, those with the smallest hash ``h`` among them: what a
    sample of ``n`` rows is drawn from, so that few rows travel to be sorted."""
    return df.where(h.cast("double") <= F.lit(-(2.0**63) + min(1.0, (2.0 * n + 200) / max(total, 1)) * 2.0**64))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def refuse(keep: Sequence[str], *taken: str) -> None:
    """Columns to keep can't have the names of the result's own."""
    clash = {c.lower() for c in keep} & set(taken)
    if clash:
        raise ValueError(f"{sorted(clash)} are columns of the result; rename the given ones")


def in_steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts hold about ``limit`` bytes; every text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        step = (np.cumsum(size, dtype=np.int64) - size) // limit
        cuts = np.flatnonzero(np.diff(step)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each text begins (one more entry at the
    end). A null text has no bytes."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def file_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, data: bytes) -> str:
    """Write a file under a name of its own and then move it into place, so that a task that is
    tried twice leaves whole files only."""
    store, path = file_store(folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, f"{path}/{name}")
    return f"{folder}/{name}"


def read_file(uri: str) -> bytes:
    store, path = file_store(uri)
    with store.open_input_stream(path) as src:
        return src.read()


def little_endian(ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return ids.astype("<u4").tobytes()
