"""Byte-level BPE over whole texts, in numpy matrices.

Matches of the split pattern are encoded one by one. Different matches are encoded once
(a worker keeps a bounded memory of earlier ones): matches of similar length form one padded matrix of
tokens and one of pair ranks. Each round every row merges its leftmost pair of least rank. A row
loses one token a round, so the matrix is compacted by masking one cell per row; rows without a
pair of the vocabulary leave. Ranks of pairs come from an open-addressing hash table.

Defined cases: a null or empty text has no ids and decodes to nothing; a null id stays null;
repeated rows are encoded one by one; an empty table gives an empty result. Other columns are not
read. Time for one match without a split in it grows with the square of its length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import in_steps
from driftwell.llm.memory import Memory, spread

NEVER = np.int32(2**31 - 1)
CELLS = 1 << 20  # of a matrix
#: Bytes of text at a time, and words and matches that a worker keeps between tasks.
STEP, KEPT_HERE = 1 << 19, 150_000
WIDTHS = np.array([2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64])


class Ranks:
    """A vocabulary: the rank of each byte string is its id."""

    def __init__(self, lines: bytes):
        pairs = (line.split() for line in lines.splitlines() if line)
        rank = {base64.b64decode(token): int(n) for token, n in pairs}
        self.rank = rank
        self.of_byte = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int32)
        tokens = [b""] * (max(rank.values()) + 1)
        for token, n in rank.items():
            tokens[n] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        left, right, merged = [], [], []
        for token, n in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(n)
        self._fill(np.array(left, dtype=np.uint64) << np.uint64(32) | np.array(right, dtype=np.uint64), np.array(merged, dtype=np.int32))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, 2**64 - 1, dtype=np.uint64)
        self.values = np.full(1 << self.bits, NEVER, dtype=np.int32)
        at, rest = self._slots(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[at] == np.uint64(2**64 - 1)
            slot, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot], self.values[slot] = keys[rest[won]], values[rest[won]]
            lost = np.ones(len(rest), dtype=bool)
            lost[won] = False
            at, rest = (at[lost] + 1) & (len(self.keys) - 1), rest[lost]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens; NEVER where the vocabulary lacks it. -1 is no token."""
        keys = left.astype(np.uint32).astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        at = self._slots(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], NEVER)
        rest = np.flatnonzero((seen != keys) & (seen != np.uint64(2**64 - 1)))
        while len(rest):
            at_rest = at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            seen = self.keys[at_rest]
            hit = seen == keys[rest]
            out[rest[hit]] = self.values[at_rest[hit]]
            rest = rest[~hit & (seen != np.uint64(2**64 - 1))]
        out[(left < 0) | (right < 0)] = NEVER
        return out

    def merge_rows(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of a matrix padded with -1. Returns the ids, row after row, and how
        many each row has."""
        n, width = tokens.shape
        counts = (tokens >= 0).sum(axis=1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.arange(n)
        ranks = self.pair(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, width - 1)
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            each = np.arange(len(rows))
            least = ranks[each, best] if ranks.shape[1] else np.full(len(rows), NEVER)
            go = least < NEVER
            if not go.all():
                done.append((rows[~go], tokens[~go]))
                rows, tokens, ranks, best, least, each = rows[go], tokens[go], ranks[go], best[go], least[go], np.arange(int(go.sum()))
                if not len(rows):
                    break
            width = tokens.shape[1]
            tokens[each, best] = least
            keep = np.ones(tokens.shape, dtype=bool)
            keep[each, best + 1] = False
            tokens = tokens[keep].reshape(len(rows), width - 1)
            keep = np.ones(ranks.shape, dtype=bool)
            keep[each, best] = False
            ranks = ranks[keep].reshape(len(rows), width - 2)
            counts[rows] -= 1
            before, after = best > 0, best < width - 2
            ranks[each[before], best[before] - 1] = self.pair(tokens[each[before], best[before] - 1], least[before])
            ranks[each[after], best[after]] = self.pair(least[after], tokens[each[after], best[after] + 1])
        ids, begin = np.empty(int(counts.sum()), dtype=np.int32), np.cumsum(counts) - counts
        for rows, tokens in done:
            real = tokens >= 0
            ids[(begin[rows][:, None] + np.arange(tokens.shape[1]))[real]] = tokens[real]
        return ids, counts

    def count_piece(self, piece: bytes) -> int:
        """Number of ids of one match, for callers that have but a few."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return len(parts)

    def encode_pieces(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in turn, and how many each has."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        flat = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        begin = np.cumsum(lengths) - lengths
        counts = np.ones(len(pieces), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        wide = np.where(lengths <= WIDTHS[-1], WIDTHS[np.minimum(np.searchsorted(WIDTHS, lengths), len(WIDTHS) - 1)], 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for width in np.unique(wide):
            alike = np.flatnonzero(wide == width)
            for cut in range(0, len(alike), step := max(1, CELLS // int(width))):
                rows = alike[cut : cut + step]
                real = np.arange(width) < lengths[rows][:, None]
                tokens = np.full(real.shape, -1, dtype=np.int32)
                tokens[real] = flat[(begin[rows][:, None] + np.arange(width))[real]]
                ids, counts[rows] = self.merge_rows(tokens)
                parts.append((rows, ids))
        out, first = np.empty(int(counts.sum()), dtype=np.int32), np.cumsum(counts) - counts
        for rows, ids in parts:
            out[spread(first[rows], counts[rows])] = ids
        return out, counts

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in turn, and the places that ``bounds`` among the ids have there."""
        size = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.data[spread(self.starts[ids], size)], ends[bounds]


def _odd(word: str) -> bool:
    """A blank before or after it isn't all the white space there."""
    return not word or word[0].isspace() or word[-1].isspace()


class Encoder:
    """Encodes texts with a bounded memory of words and of matches.

    No match of the pattern crosses from a visible character to a blank, so a single blank
    between visible characters always begins a new match: the words between such blanks, each
    with its blank in front, are matched and encoded on their own. ``pattern`` must have that
    property.
    """

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.part = regex.compile(r"(?<=\S) (?=\S)").split
        self.pieces = Memory(lambda new: ranks.encode_pieces([p.encode() for p in new]), kept=KEPT_HERE)
        self.words = Memory(self._encode_words, _odd, kept=KEPT_HERE)

    def _encode_words(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A key that begins with a blank stands for a first word, which has none in front."""
        found = [self.find(k[1:] if k[0] == " " else " " + k) for k in keys]
        counts = np.array([len(f) for f in found], dtype=np.int64)
        piece = np.fromiter((self.pieces[p] for f in found for p in f), dtype=np.int64, count=int(counts.sum()))
        ids, size = self.pieces.get_ids(piece)
        self.pieces.end_step()
        ends, bounds = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(ends[bounds])

    def _number(self, key: str) -> int:
        n = self.words.get(key)
        return self.words.add(key) if n is None else n

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text begins (one more entry at the end)."""
        number, parts, per_text = self.words.__getitem__, [], np.zeros(len(texts) + 1, dtype=np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            first, *rest = text.split(" ")
            self.words.met_odd = False
            got = np.fromiter(map(number, rest), dtype=np.int64, count=len(rest))
            if self.words.met_odd or not first or first[-1].isspace():
                first, *rest = self.part(text)
                got = np.fromiter(map(self._number, rest), dtype=np.int64, count=len(rest))
            per_text[i + 1] = len(got) + 1
            parts += [np.array([self._number(" " + first)]), got]
        ids, size = self.words.get_ids(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64))
        self.words.end_step()
        return ids, np.concatenate([[0], np.cumsum(size)])[np.cumsum(per_text)]


@lru_cache(maxsize=1)
def encoder_of(lines: bytes, pattern: str) -> Encoder:
    """One for each worker, so that later tasks profit from what it has met."""
    return Encoder(load(lines), pattern)


@lru_cache(maxsize=2)
def load(lines: bytes) -> Ranks:
    return Ranks(lines)


def vocabulary(df: DataFrame, path: str) -> Broadcast[bytes]:
    """The vocabulary file, read by the driver and sent once to each executor; its size is the
    vocabulary's, whatever the data."""
    with open(path, "rb") as src:
        return df.sparkSession.sparkContext.broadcast(src.read())


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(data)
    width = data.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id, n_tokens, ids`` of every row; ``ids`` holds unsigned 32-bit little-endian integers.
    With ``decoded`` also the bytes that the ids decode to, made in the same pass."""
    lines = vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(lines.value, pattern)
        for batch in in_steps(batches, "__text", STEP):
            ids, bounds = encoder.encode(batch.column("__text").to_pylist())
            columns = [batch.column(id_col), pa.array(np.diff(bounds)), _binary(ids.astype("<u4"), bounds)]
            if decoded:
                columns.append(_binary(*encoder.ranks.decode(ids, bounds)))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids", "decoded"][: len(columns)])

    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids binary" + ", decoded binary" * decoded
    return texts.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, decoded`` of every row of :func:`encode`; null ids decode to nothing."""
    lines = vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, "__ids"):
            raw = batch.column("__ids").to_pylist()
            bounds = np.cumsum([0, *(len(x) // 4 for x in raw)])
            data, ends = load(lines.value).decode(np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int64), bounds)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), _binary(data, ends)], [id_col, "decoded"])

    ids = encoded.select(id_col, F.coalesce(F.col(ids_col), F.lit(b"")).alias("__ids"))
    return ids.mapInArrow(run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, decoded binary")
