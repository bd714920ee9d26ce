"""Token ids in length-delimited binary records, with an offset index of their own.

A shard file is a run of frames: length of the payload (8 bytes), masked checksum of these
8 bytes (4), payload, masked checksum of the payload (4); all integers are little-endian. The
checksum is CRC-32, masked by a rotation and an added constant, so that a checksum stored inside
a payload is no valid checksum of it. A payload is one sequence of ids of 2 bytes (vocabularies
below 65,536 ids) or 4. The index is a Parquet table with a row per sequence: shard, file, place
in the shard, offset, length, number of ids, ids before it in the shard. Reads in any order take
ranges from the index.

Texts are range-partitioned by id and sorted, so shard k holds smaller ids than shard k + 1. Each
task writes one file under a name of its own in the shared folder, and only files of tasks that
ended well are listed in the index.

Defined cases: a null or empty text holds the end id only; null ids come first; rows with equal
ids follow the hash of their text; an empty table gives an empty index. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.llm.common import file_store, in_steps, stored, work_folder
from driftwell.llm.memory import Memory

HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
MASK = 0xA282EAD8
READ_BYTES = 8 << 20


class BrokenRecord(ValueError):
    """A frame whose lengths or checksums don't fit."""


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, TAIL.pack(masked(size)), payload, TAIL.pack(masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one whole frame."""
    if len(data) < HEAD.size + TAIL.size:
        raise BrokenRecord(f"a frame has {len(data)} bytes")
    size, check = HEAD.unpack_from(data)
    payload = data[HEAD.size : -TAIL.size]
    if check != masked(data[:8]) or size != len(payload) or TAIL.unpack_from(data, HEAD.size + size)[0] != masked(payload):
        raise BrokenRecord("length or checksum doesn't fit")
    return payload


class WordEncoder:
    """The tokenizers library over whole texts, with a bounded memory of words.

    The tokenizer must drop white space, lower-case A-Z and encode what stands between spaces on its own. Texts
    are split at ASCII white space and lower-cased, but for those with an added token in any case: these tokens
    are matched before the tokenizer lower-cases. Words of letters, with ASCII punctuation behind
    them set apart, go to the library many at a time: each is one pre-token, so tokens that end a
    word show where one ends. Letters are those that normalise to letters only: a mark and the
    punctuation behind it may be one pre-token. Others go one by one.
    """

    SPLIT = re.compile(rb"[.,!?;:|]+\Z")

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith(suffix)]] = True
        self.cores = Memory(self._encode_cores)
        self.words = Memory(self._encode_words)

    def is_letters(self, word: bytes) -> bool:
        if word.isascii():
            return word.isalpha()
        text, normal = word.decode(), self.tokenizer.normalizer
        if max(text) < "\u0180":  # composed Latin letters, which lower-casing alone may take apart
            return text.isalpha() and text.lower().isalpha()
        return text.isalpha() and (not normal or normal.normalize_str(text).isalpha())

    def _encode_cores(self, cores: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [c.decode() for c in cores]
        plain = np.array([c.isalpha() or self.is_letters(c) for c in cores], dtype=bool)  # bytes: ASCII letters
        counts = np.zeros(len(cores), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        singly = [np.flatnonzero(~plain)]
        alike = np.flatnonzero(plain)
        for cut in range(0, len(alike), 1000):
            rows = alike[cut : cut + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in rows)], add_special_tokens=False)[0].ids, dtype=np.int32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(rows):
                counts[rows] = np.diff(ends, prepend=-1)
                parts.append((rows, ids))
            else:  # letters that normalise to a letter and a mark, which is a pre-token of its own
                singly.append(rows)
        odd = np.concatenate(singly)
        each = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)]
        counts[odd] = [len(e) for e in each]
        if each:
            parts.append((odd, np.concatenate(each)))
        out, first = np.empty(int(counts.sum()), dtype=np.int32), np.cumsum(counts) - counts
        for rows, ids in parts:
            n = counts[rows]
            out[np.arange(len(ids)) + np.repeat(first[rows] - np.cumsum(n) + n, n)] = ids
        return out, counts

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        numbers, per_word = [], np.ones(len(words), dtype=np.int64)
        for i, word in enumerate(words):
            cut = self.SPLIT.search(word)
            core = word[: cut.start()] if cut else b""
            if core and (core.isalpha() or self.is_letters(core)):
                numbers += [self.cores[core], self.cores[cut[0]]]
                per_word[i] = 2
            else:
                numbers.append(self.cores[word])
        ids, size = self.cores.get_ids(np.array(numbers, dtype=np.int64))
        self.cores.end_step()
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(per_word)])])

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, each followed by ``end_id``, and where each text begins (one
        more entry at the end)."""
        parts, per_text = [], np.zeros(len(texts) + 1, dtype=np.int64)
        for i, text in enumerate(texts):
            low = text.lower()
            found = (text if any(t in low for t in self.added) else low).split()
            per_text[i + 1] = len(found)
            parts.append(np.fromiter(map(self.words.__getitem__, found), dtype=np.int64, count=len(found)))
        ids, size = self.words.get_ids(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64))
        self.words.end_step()
        bounds = np.concatenate([[0], np.cumsum(size)])[np.cumsum(per_text)]
        ids = np.insert(ids, bounds[1:], end_id)
        return ids, bounds + np.arange(len(bounds))


@lru_cache(maxsize=1)
def encoder_of(spec: str) -> WordEncoder:
    """One for each worker, so that later tasks profit from what it has met."""
    return WordEncoder(spec)


INDEX = "shard int, file string, place bigint, offset bigint, length bigint, n_tokens bigint, before bigint"


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, write the shard files below ``folder`` and return the stored index."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as src:
        spec = spark.sparkContext.broadcast(src.read())  # of the vocabulary's size, whatever the data
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), encoder_of(spec.value)
        kind = np.dtype("<u2" if max(encoder.size, end_id + 1) <= 1 << 16 else "<u4")
        store, path = file_store(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        out, place, offset, before = None, 0, 0, 0
        try:
            for batch in in_steps(batches, "__text"):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}")
                ids, bounds = encoder.encode(batch.column("__text").cast(pa.binary()).to_pylist(), end_id)
                raw, width = ids.astype(kind).tobytes(), kind.itemsize
                frames = [frame(raw[a * width : b * width]) for a, b in zip(bounds[:-1], bounds[1:])]
                out.write(b"".join(frames))
                length = np.array([len(f) for f in frames], dtype=np.int64)
                rows = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_col), pa.array(np.full(rows, shard, dtype=np.int32)), pa.array([f"{folder}/{name}"] * rows),
                        pa.array(place + np.arange(rows)), pa.array(offset + np.cumsum(length) - length), pa.array(length),
                        pa.array(np.diff(bounds)), pa.array(before + bounds[:-1]),
                    ],
                    [id_col, *(c.split()[0] for c in INDEX.split(", "))],
                )
                place, offset, before = place + rows, offset + int(length.sum()), before + int(bounds[-1])
        finally:
            if out is not None:
                out.close()

    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn("__tie", F.xxhash64("__text"))
    ordered = texts.repartitionByRange(n, id_col, "__tie").sortWithinPartitions(id_col, "__tie").drop("__tie")
    return stored(ordered.mapInArrow(write, f"`{id_col}` {dict(docs.dtypes)[id_col]}, {INDEX}"), "record-index")


def read_records(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The sequences that the rows of an index name, in any order: the columns of the index and
    ``ids`` (unsigned 32-bit little-endian integers). Adjoining frames are read at once."""
    names = [id_col, *(c.split()[0] for c in INDEX.split(", "))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file = np.array(batch.column("file").to_pylist(), dtype=object)
            offset, length, n = (batch.column(c).to_numpy() for c in ("offset", "length", "n_tokens"))
            order = np.lexsort((offset, file)) if len(file) else np.zeros(0, dtype=np.int64)
            run: list[int] = []
            for k, i in enumerate(order):
                run.append(i)
                following = order[k + 1] if k + 1 < len(order) else None
                if following is not None and file[following] == file[i] and offset[following] == offset[i] + length[i] and offset[following] + length[following] - offset[run[0]] <= READ_BYTES:
                    continue
                store, path = file_store(file[i])
                with store.open_input_file(path) as src:
                    data = src.read_at(int(offset[i] + length[i] - offset[run[0]]), int(offset[run[0]]))
                ids = []
                for r in run:
                    payload = unframe(data[offset[r] - offset[run[0]] : offset[r] - offset[run[0]] + length[r]])
                    ids.append(np.frombuffer(payload, dtype=f"<u{len(payload) // n[r]}").astype("<u4").tobytes())
                part = batch.take(pa.array(run)).select(names)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], [*names, "ids"])
                run = []

    kinds = dict(index.dtypes)
    return index.repartition("file").select(names).mapInArrow(read, f"`{id_col}` {kinds[id_col]}, {INDEX}, ids binary")


def starts(index: DataFrame) -> DataFrame:
    """``shard, shard_start``: the ids in all earlier shards; one row per shard."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))


def record_folder(spark: SparkSession) -> str:
    return work_folder(spark, "records")
