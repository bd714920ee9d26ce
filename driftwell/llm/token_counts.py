"""Token counts that follow edits.

A document keeps a segment tree over its pre-tokens. Leaves are runs of up to ``LEAF`` pre-tokens
with their lengths and token counts; inner nodes hold the sums of both. An edit finds its place by
the length sums, splits again from the first pre-token that the edit can reach, and stops where a
new boundary falls on an old one behind the edit: from there on text and boundaries are as before.
Only pre-tokens in between are encoded again, and only sums above touched leaves are renewed.

The split pattern decides on a match from its first character to one character past the one that
follows it (the longest contraction, and the look-ahead behind white space). So matches that end
two or more characters before an edit stay.

Defined cases: a null text is empty; a null list of edits, or a null edit, changes nothing; places
and lengths beyond the text, null or negative are cut to it (null: 0); edits apply one after another,
each to the text that those before left; null ids and repeated rows are counted like others; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.byte_bpe import load, vocabulary
from driftwell.llm.common import fresh, in_steps, refuse
from driftwell.llm.memory import Memory

LEAF = 64
REACH = 1  # characters past its end and the next that a match can depend on
EDITS = "array<struct<start:int,removed:int,inserted:string>>"


class Counter:
    """Token counts of pre-tokens, with a bounded memory. Texts are counted many at a time, edits
    a few pre-tokens at a time."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = load(lines)
        self.pattern = regex.compile(pattern)
        self.pieces = Memory(lambda new: self.ranks.encode_pieces([p.encode() for p in new]))
        self.few = lru_cache(maxsize=100_000)(lambda piece: self.ranks.count_piece(piece.encode()))

    def trees(self, texts: Sequence[str]) -> list[Tree]:
        number, parts = self.pieces.__getitem__, []
        for text in texts:
            found = self.pattern.findall(text)
            parts.append(np.fromiter(chain(map(len, found), map(number, found)), dtype=np.int64, count=2 * len(found)).reshape(2, -1))
        whole = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), dtype=np.int64)
        whole[1] = self.pieces.get_counts(whole[1])
        self.pieces.end_step()
        ends = np.cumsum([p.shape[1] for p in parts])
        return [Tree.over(whole[:, end - p.shape[1] : end]) for p, end in zip(parts, ends)]

    def tree(self, text: str) -> Tree:
        return self.trees([text])[0]

    def measure(self, pieces: list[str]) -> np.ndarray:
        """Lengths and token counts of a few pre-tokens."""
        return np.array([list(map(len, pieces)), list(map(self.few, pieces))], dtype=np.int64).reshape(2, len(pieces))


class Tree:
    """Sums of lengths (row 0) and token counts (row 1) over leaves of pre-tokens."""

    def __init__(self, leaves: list[np.ndarray]):
        self.leaves = leaves
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.size), dtype=np.int64)
        for i, leaf in enumerate(self.leaves):
            self.sums[:, self.size + i] = leaf.sum(axis=1)
        level = self.size
        while level > 1:
            half = level // 2
            self.sums[:, half:level] = self.sums[:, level : 2 * level : 2] + self.sums[:, level + 1 : 2 * level : 2]
            level = half

    @classmethod
    def over(cls, pretokens: np.ndarray) -> Tree:
        n = max(1, -(-pretokens.shape[1] // LEAF))
        return cls([pretokens[:, i * LEAF : (i + 1) * LEAF] for i in range(n)])

    @property
    def length(self) -> int:
        return int(self.sums[0, 1])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def n_pretokens(self) -> int:
        return sum(leaf.shape[1] for leaf in self.leaves)

    def seek(self, place: int) -> tuple[int, int, int]:
        """Leaf, index in it and beginning of the first pre-token that ends at ``place`` or later;
        behind the last one if none does."""
        if place > self.length:
            return len(self.leaves) - 1, self.leaves[-1].shape[1], self.length
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if before + self.sums[0, node] < place or (self.sums[0, node] == 0 and self.sums[0, node + 1] > 0):
                before += int(self.sums[0, node])
                node += 1
        leaf = min(node - self.size, len(self.leaves) - 1)
        ends = before + np.cumsum(self.leaves[leaf][0])
        k = int(np.searchsorted(ends, place))
        return leaf, k, before + int(self.leaves[leaf][0, :k].sum())

    def replace(self, first: tuple[int, int], last: tuple[int, int], new: np.ndarray) -> None:
        """Put ``new`` in the place of the pre-tokens from ``first`` up to and without ``last``."""
        (a, i), (b, j) = first, last
        head, tail = self.leaves[a][:, :i], self.leaves[b][:, j:]
        if a == b:
            self.leaves[a] = np.concatenate([head, new, tail], axis=1)
        else:
            self.leaves[a] = np.concatenate([head, new], axis=1)
            for k in range(a + 1, b):
                self.leaves[k] = self.leaves[k][:, :0]
            self.leaves[b] = tail
        nodes = np.arange(self.size + a, self.size + b + 1)
        self.sums[:, nodes] = np.array([self.leaves[k].sum(axis=1) for k in range(a, b + 1)]).T
        while nodes[0] > 1:
            nodes = np.unique(nodes // 2)
            self.sums[:, nodes] = self.sums[:, 2 * nodes] + self.sums[:, 2 * nodes + 1]

    def pack(self) -> bytes:
        """For storing: leaf sizes, lengths and counts."""
        sizes = np.array([leaf.shape[1] for leaf in self.leaves], dtype="<u4")
        body = np.concatenate(self.leaves, axis=1).astype("<u4")
        return len(sizes).to_bytes(4, "little") + zlib.compress(sizes.tobytes() + body.tobytes(), 1)

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        n, raw = int.from_bytes(data[:4], "little"), np.frombuffer(zlib.decompress(data[4:]), dtype="<u4").astype(np.int64)
        ends = np.cumsum(raw[:n])
        body = raw[n:].reshape(2, -1)
        return cls([body[:, a:b] for a, b in zip(ends - raw[:n], ends)])


def edit(text: str, tree: Tree, counter: Counter, start: int | None, removed: int | None, inserted: str | None) -> tuple[str, int]:
    """The text after the edit, and how many pre-tokens were encoded; the tree is brought up to date."""
    start = min(max(start or 0, 0), len(text))
    removed = min(max(removed or 0, 0), len(text) - start)
    inserted = inserted or ""
    out = text[:start] + inserted + text[start + removed :]
    shift = len(inserted) - removed
    leaf, k, at = tree.seek(max(start - REACH, 0))
    new: list[str] = []
    end, old = start + len(inserted), at  # `old`: beginning of the old pre-token (b, j)
    b, j, place = leaf, k, at
    while place < len(out):
        if place >= end:  # old boundaries at or behind this place
            while old < place - shift:
                while j >= tree.leaves[b].shape[1]:
                    b, j = b + 1, 0
                old += int(tree.leaves[b][0, j])
                j += 1
            if old == place - shift and old >= start + removed:
                break
        piece = counter.pattern.match(out, place)[0]
        new.append(piece)
        place += len(piece)
    else:
        b, j = len(tree.leaves) - 1, tree.leaves[-1].shape[1]
    tree.replace((leaf, k), (b, j), counter.measure(new))
    return out, len(new)


def edit_all(text: str, tree: Tree, counter: Counter, edits: Sequence[dict | None] | None) -> tuple[str, int]:
    total = 0
    for e in edits or ():
        if e is not None:
            text, n = edit(text, tree, counter, e["start"], e["removed"], e["inserted"])
            total += n
    return text, total


@lru_cache(maxsize=1)
def counter_of(lines: bytes, pattern: str) -> Counter:
    """One for each worker, so that later tasks profit from what it has met."""
    return Counter(lines, pattern)


def build_trees(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``id, text, n_tokens, tree`` and the columns ``keep`` of every row, to be stored and edited later."""
    edits = fresh(docs, "__edits")
    return _run(docs.withColumn(edits, F.lit(None).cast(EDITS)), path, pattern, id_col, text_col, edits, None, True, keep)


def apply_edits(trees: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", tree_col: str = "tree") -> DataFrame:
    """Rows of :func:`build_trees` with a list of edits each: ``id, text, n_tokens, tree`` after
    the edits and ``n_encoded``, the pre-tokens encoded for them."""
    return _run(trees, path, pattern, id_col, text_col, edits_col, tree_col, True)


def count_edited(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """``id, n_pretokens, n_before, n_tokens, n_encoded`` of every row: pre-tokens and tokens of
    the text, tokens after its edits, and pre-tokens encoded for the edits. Trees are built and
    edited in one pass and not stored."""
    return _run(docs, path, pattern, id_col, text_col, edits_col, None, False)


def _run(df: DataFrame, path: str, pattern: str, id_col: str, text_col: str, edits_col: str, tree_col: str | None, stored: bool, keep: Sequence[str] = ()) -> DataFrame:
    refuse(keep, id_col, text_col, "tree", "n_pretokens", "n_before", "n_tokens", "n_encoded")
    lines = vocabulary(df, path)
    counts = ["n_pretokens", "n_before", "n_tokens", "n_encoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(lines.value, pattern)
        for batch in in_steps(batches, "__text"):
            texts, rows, packed = [], [], []
            given = batch.column("__text").to_pylist()
            trees = list(map(Tree.unpack, batch.column("__tree").to_pylist())) if tree_col else counter.trees(given)
            for text, edits, tree in zip(given, batch.column("__edits").to_pylist(), trees):
                before = (tree.n_pretokens, tree.n_tokens)
                text, n = edit_all(text, tree, counter, edits)
                rows.append((*before, tree.n_tokens, n))
                if stored:
                    texts.append(text)
                    packed.append(tree.pack())
            columns = [batch.column(id_col), *(pa.array(c, pa.int64()) for c in zip(*rows))]
            columns += [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(texts), pa.array(packed)] if stored else [])], [id_col, *counts, *keep, *([text_col, "tree"] if stored else [])])

    tree = [F.col(tree_col).alias("__tree")] if tree_col else []
    rows = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.col(edits_col).cast(EDITS).alias("__edits"), *tree, *keep)
    kinds = dict(df.dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, " + ", ".join([*(f"{c} bigint" for c in counts), *(f"`{c}` {kinds[c]}" for c in keep)]) + (f", `{text_col}` string, tree binary" if stored else "")
    return rows.mapInArrow(run, schema)
