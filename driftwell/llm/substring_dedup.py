"""Removal of word windows that an earlier document holds too, with a count-min prefilter.

1. Documents are packed into chunk files. Each chunk counts the windows of its documents in a
   count-min sketch of two rows and sends, for each slice of a row, its cells in order (about a
   byte and a half per window and row) to the task of that slice.
2. The slice's task merges the sketches of all chunks and answers each chunk with one bit per
   cell: is the merged count two or more? Counts are never too low, so no repeated window is
   lost. The sketch has four cells per window of the corpus, in as many slices as that takes, and
   no task or executor ever holds more than one slice.
3. Each chunk keeps the windows whose cells are repeated in both rows, and sends each different
   one once, as 96 bits of hash with the smallest document that has it, to be grouped exactly.
   The answer is again one bit: does a smaller document elsewhere hold it?
4. Each chunk removes the words of all windows that a smaller document holds, in itself or elsewhere.

Texts never move after step 1. A window that a third of all documents share is sent once per
chunk, not once per document.

Defined cases: a null text has no words and gives an empty text; texts shorter than the window
lose nothing; rows with equal ids are one document, so they take nothing from each other; a row
with a null id loses nothing and takes nothing; an empty table gives an empty result. Other
columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.chunks import null_mask, read_chunk, tasks, totals, write_chunks
from driftwell.llm.common import read_file, refuse, stored, write_file
from driftwell.llm.memory import spread
from driftwell.llm.words import window_hashes

WIDTH = 13
CELL_BITS = 24  # cells of a slice
CELLS_PER_WINDOW = 4


def slices_for(n_windows: int) -> int:
    return max(1, -(-n_windows * CELLS_PER_WINDOW >> CELL_BITS) if n_windows else 1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers below 2**32 as differences: a byte each, with 255 for each further 255,
    or 4 bytes each where they lie far apart."""
    step = np.diff(values.astype(np.int64), prepend=0)
    more, rest = np.divmod(step, 255)
    if more.sum() > 3 * len(step):
        return b"\1" + step.astype("<u4").tobytes()
    out = np.full(int(more.sum()) + len(step), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return b"\0" + out.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if data[:1] == b"\1":
        return np.cumsum(np.frombuffer(data, dtype="<u4", offset=1), dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8, offset=1)
    return np.cumsum(raw, dtype=np.int64)[raw < 255]


class Windows:
    """The windows of the documents of a chunk that have an id."""

    def __init__(self, uri: str, id_col: str, text_col: str, width: int):
        ids, hashes, n_windows = [], ([], []), []
        for batch, data, offsets in read_chunk(uri, text_col):
            _, n, two = window_hashes(data, offsets, width)
            column = batch.column(id_col)
            missing = null_mask(column)
            ids.append(column.fill_null(0).to_numpy())
            real = np.repeat(~missing, n)
            n_windows.append(np.where(missing, 0, n))
            for had, h in zip(hashes, two):
                had.append(h[real])
        self.n_windows = np.concatenate(n_windows) if n_windows else np.zeros(0, dtype=np.int64)
        self.first, self.second = (np.concatenate(h) if h else np.zeros(0, dtype=np.uint64) for h in hashes)
        self.doc = np.repeat(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64), self.n_windows)

    def by_slice(self, row: int, n_slices: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slice, windows in order of their cells, cells."""
        h = (self.first, self.second)[row]
        where = (h % np.uint64(n_slices)).astype(np.int64) << CELL_BITS | (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        where = where[order]
        bounds = np.searchsorted(where, np.arange(n_slices + 1, dtype=np.int64) << CELL_BITS) if n_slices < len(where) else None
        if bounds is None:  # more slices than windows: only those met
            met = np.unique(where >> CELL_BITS)
            spans = zip(met, np.searchsorted(where, met << CELL_BITS), np.searchsorted(where, met + 1 << CELL_BITS))
        else:
            spans = zip(range(n_slices), bounds[:-1], bounds[1:])
        for s, a, b in spans:
            if b > a:
                yield int(s), order[a:b], where[a:b] & (1 << CELL_BITS) - 1


def sketch(chunks: DataFrame, n_slices: int, n: int, id_col: str, text_col: str, width: int) -> DataFrame:
    """``chunk, row, slice, bits``: for each cell of the chunk's sketch, in order, is its merged count above one?"""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("chunk").to_pylist():
                found = Windows(uri, id_col, text_col, width)
                out = [(uri, row, s, pack_sorted(c)) for row in (0, 1) for s, _, c in found.by_slice(row, n_slices)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["chunk", "row", "slice", "cells"])

    def merge(sent: pa.Table) -> pa.Table:
        each = [unpack_sorted(c) for c in sent.column("cells").to_pylist()]
        counts = np.zeros(1 << CELL_BITS, dtype=np.uint8)
        for c in each:
            cell, times = np.unique(c, return_counts=True)
            counts[cell] = np.minimum(counts[cell] + np.minimum(times, 2), 2)
        bits = [np.packbits(counts[c] > 1).tobytes() for c in each]
        return pa.table([sent.column("chunk"), sent.column("row"), sent.column("slice"), pa.array(bits, pa.binary())], ["chunk", "row", "slice", "bits"])

    sent = tasks(chunks, n).mapInArrow(cells, "chunk string, row bigint, slice bigint, cells binary").repartition(n, "row", "slice")
    return sent.groupBy("row", "slice").applyInArrow(merge, "chunk string, row bigint, slice bigint, bits binary")


def repeated(chunks: DataFrame, answers: DataFrame, n_slices: int, n: int, id_col: str, text_col: str, width: int) -> DataFrame:
    """``chunk, file, slice, bits``: for each different candidate window of the chunk, in order,
    does a smaller document of another chunk hold it? ``file`` has the chunk's candidates."""

    def candidates(key: tuple, rows: pa.Table) -> pa.Table:
        uri = key[0].as_py()
        found = Windows(uri, id_col, text_col, width)
        bits = {(r["row"], r["slice"]): r["bits"] for r in rows.to_pylist() if r["bits"] is not None}
        keep = np.ones(len(found.doc), dtype=bool)
        for row in (0, 1):
            for s, order, _ in found.by_slice(row, n_slices):
                keep[order] &= np.unpackbits(np.frombuffer(bits[row, s], dtype=np.uint8), count=len(order)).astype(bool)
        at = np.flatnonzero(keep)
        first, check, doc = found.first[at], (found.second[at] & np.uint64(2**32 - 1)).astype("<u4"), found.doc[at]
        part = (first % np.uint64(n_slices)).astype(np.int64)
        order = np.lexsort((doc, check, first, part))
        at, first, check, doc, part = at[order], first[order], check[order], doc[order], part[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (check[1:] != check[:-1])
        least = doc[new]  # documents ascend within a window
        body = np.uint64(len(at)).tobytes() + at.astype("<u4").tobytes() + np.packbits(new).tobytes()
        file = write_file(uri.rpartition("/")[0], f"{uuid.uuid4().hex}.windows", body)
        slices, begins = np.unique(part[new], return_index=True)
        ends = [*begins[1:], len(least)]
        low = int(least.min()) if len(least) else 0
        narrow = np.dtype("<u4" if len(least) and int(least.max()) - low < 2**32 else "<u8")
        out = [
            (uri, file, int(s), low, first[new][a:b].astype("<u8").tobytes(), check[new][a:b].tobytes(), (least[a:b] - low).astype(narrow).tobytes())
            for s, a, b in zip(slices, begins, ends)
        ] or [(uri, file, -1, 0, b"", b"", b"")]
        return pa.table([pa.array(c) for c in zip(*out)], names)

    def resolve(sent: pa.Table) -> pa.Table:
        rows = sent.to_pylist()
        first = [np.frombuffer(r["first"], dtype="<u8") for r in rows]
        check = [np.frombuffer(r["check"], dtype="<u4") for r in rows]
        least = [np.frombuffer(r["least"], dtype=f"<u{len(r['least']) // max(len(f), 1) or 8}").astype(np.int64) + r["low"] for r, f in zip(rows, first)]
        sizes = [len(f) for f in first]
        first, check, least = (np.concatenate(x) for x in (first, check, least))
        order = np.lexsort((check, first))
        new = np.ones(len(order), dtype=bool)
        f, c = first[order], check[order]
        new[1:] = (f[1:] != f[:-1]) | (c[1:] != c[:-1])
        group = np.cumsum(new) - 1
        smallest = np.minimum.reduceat(least[order], np.flatnonzero(new)) if len(order) else least
        earlier = np.zeros(len(order), dtype=bool)
        earlier[order] = smallest[group] < least[order]
        ends = np.cumsum(sizes)
        bits = [np.packbits(earlier[e - s : e]).tobytes() for s, e in zip(sizes, ends)]
        return pa.table([sent.column("chunk"), sent.column("file"), sent.column("slice"), pa.array(bits, pa.binary())], ["chunk", "file", "slice", "bits"])

    names = ["chunk", "file", "slice", "low", "first", "check", "least"]
    kinds = "chunk string, file string, slice bigint, low bigint, first binary, `check` binary, least binary"
    marks = chunks.select("chunk", F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("bigint").alias("slice"), F.lit(None).cast("binary").alias("bits"))
    by_chunk = answers.unionByName(marks).repartition(n, "chunk").groupBy("chunk")
    # The slice -1 of a chunk without candidates is as frequent as such chunks are, so it is not grouped.
    sent = stored(by_chunk.applyInArrow(candidates, kinds), "windows")
    real = sent.where("slice >= 0").repartition(n, "slice").groupBy("slice").applyInArrow(resolve, "chunk string, file string, slice bigint, bits binary")
    return real.unionByName(sent.where("slice < 0").select("chunk", "file", "slice", F.lit(b"").alias("bits")))


def covered_windows(file: str, answers: dict[int, bytes], found: Windows, n_slices: int) -> np.ndarray:
    """True for each window of the chunk that a smaller document holds."""
    body = read_file(file)
    n = int(np.frombuffer(body, dtype="<u8", count=1)[0])
    at = np.frombuffer(body, dtype="<u4", count=n, offset=8)
    new = np.unpackbits(np.frombuffer(body, dtype=np.uint8, offset=8 + 4 * n), count=n).astype(bool)
    out = np.zeros(len(found.doc), dtype=bool)
    if n:
        begins = np.flatnonzero(new)
        part = (found.first[at[begins]] % np.uint64(n_slices)).astype(np.int64)
        elsewhere = np.zeros(len(begins), dtype=bool)
        for s in np.unique(part):
            here = part == s
            elsewhere[here] = np.unpackbits(np.frombuffer(answers[int(s)], dtype=np.uint8), count=int(here.sum())).astype(bool)
        group = np.cumsum(new) - 1
        doc = found.doc[at]
        out[at] = elsewhere[group] | (doc > doc[begins][group])
    return out


def removed_words(covered: np.ndarray, n_windows: np.ndarray, n_words: np.ndarray, width: int) -> np.ndarray:
    """True for each word inside a covered window."""
    change = np.zeros(int(n_words.sum()) + 1, dtype=np.int64)
    first = spread(np.cumsum(n_words) - n_words, n_windows)[covered]
    np.add.at(change, first, 1)
    np.add.at(change, first + width, -1)
    return np.cumsum(change)[:-1] > 0


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep: Sequence[str] = (), rejoin: bool = True) -> DataFrame:
    """``id, text`` without repeated words (what is left joined by one blank), ``n_words``,
    ``n_removed`` and the columns ``keep`` of every row. Ids are integers. Without ``rejoin``
    texts that lose nothing stay as they are."""
    refuse(keep, id_col, text_col, "n_words", "n_removed")
    kinds = dict(docs.dtypes)
    columns = [id_col, text_col, *keep]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = write_chunks(docs.withColumn(id_col, F.col(id_col).cast("bigint")), text_col, columns)
    n_slices = slices_for(totals(chunks)[1])
    answers = sketch(chunks, n_slices, n, id_col, text_col, width)
    resolved = repeated(chunks, answers, n_slices, n, id_col, text_col, width)

    def clean(key: tuple, rows: pa.Table) -> pa.Table:
        uri, answers = key[0].as_py(), rows.to_pylist()
        found = Windows(uri, id_col, text_col, width)
        covered = covered_windows(answers[0]["file"], {r["slice"]: r["bits"] for r in answers}, found, n_slices)
        out, at = [], 0
        for batch, data, offsets in read_chunk(uri, text_col):
            n_words, n_windows, _ = window_hashes(data, offsets, width, ())
            n_windows = np.where(null_mask(batch.column(id_col)), 0, n_windows)
            gone = removed_words(covered[at : at + int(n_windows.sum())], n_windows, n_words, width)
            at += int(n_windows.sum())
            ends = np.cumsum(n_words)
            raw = data.tobytes()
            texts, lost = [], []
            for i in range(batch.num_rows):
                mask = gone[ends[i] - n_words[i] : ends[i]]
                text = raw[offsets[i] : offsets[i + 1]]
                lost.append(int(mask.sum()))
                if lost[-1] or rejoin:
                    text = b" ".join(compress(text.split(), ~mask) if lost[-1] else text.split())
                texts.append(text)
            kept = [batch.column(c) for c in keep]
            out.append(pa.table([batch.column(id_col), pa.array(texts, pa.binary()).cast(pa.string()), *kept, pa.array(n_words), pa.array(lost, pa.int64())], [*columns, "n_words", "n_removed"]))
        return pa.concat_tables(out)

    schema = ", ".join([f"`{id_col}` bigint", f"`{text_col}` string", *(f"`{c}` {kinds[c]}" for c in keep), "n_words bigint", "n_removed bigint"])
    return resolved.repartition(n, "chunk").groupBy("chunk").applyInArrow(clean, schema)
