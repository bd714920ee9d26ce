"""Hard negatives for anchors: integer inner products behind an interval filter on rotated one-bit codes.

1. Components become integers, ``floor(SCALE * x)``. A row stores, beside them, ``LEVELS`` one-bit
   codes: the signs of its direction after a rotation (random signs and Walsh-Hadamard steps), then
   the signs of what this code leaves, after another rotation, and so on. For every code it
   stores the alignment, the inner product of code and vector, and at the end the length of the rest.
2. An anchor is rotated in the same way and rounded to ``PLANES`` bits a component. Its inner product
   with a code is a sum of population counts over bit planes. By Cauchy and Schwarz the true score is
   not further from this estimate than (rest x anchor + alignments x rounding errors) x length, so
   every pair has an interval that surely holds its score.
3. Pairs whose interval can't reach the best rows so far are dropped; all others are scored in integers.

Positives come first (rows of the anchor's label), then negatives for the bands that they define.
Anchors are the stated query set; they meet all rows in blocks: rows are packed into tiles of ``TILE``,
anchors into blocks of ``BLOCK``, both by a hash of a row number, so neither a hot label nor repeated
rows make a large group. Tiles and blocks are dealt into lanes, and a task keeps only the best few of
each anchor it meets. The filter drops nothing that could be returned: results are exact.

Defined cases: rows with a null id, a null label, a null vector or a null or non-finite component take no
part. Vectors of different length are never compared; empty vectors score zero with each other. Rows
that repeat an id are rows of their own, ties included, but no row is a positive of an anchor with
its own id; every anchor row gives its rows, numbered on its own. An empty table or one without anchors
gives an empty result. Scores beyond 63 bits (components of 2**31 / SCALE or more) raise an
OverflowError. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.llm.common import stored

SCALE = 256
LEVELS, PLANES, SEED = 4, 6, 29
TILE, BLOCK, STEP = 2048, 512, 64
LANE = 64  # tiles or blocks of a lane, where there are many
KEPT_BLOCKS = 64
NONE = np.iinfo(np.int64).min
LAST_ID = np.iinfo(np.int64).max


def padded(dim: int) -> int:
    return max(64, 1 << max(dim - 1, 0).bit_length())


def rotate(x: np.ndarray, level: int) -> np.ndarray:
    """Rows of a power of two of components, turned by the rotation of this level."""
    n, size = x.shape
    for signs in np.random.default_rng([SEED, level]).integers(0, 2, (3, size)) * 2.0 - 1.0:
        x = x * signs
        width = 1
        while width < size:
            pair = x.reshape(n, size // (2 * width), 2, width)
            x = np.concatenate([pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]], axis=2).reshape(n, size)
            width *= 2
        x = x / np.sqrt(size)
    return x


def to_words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def code_rows(ints: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x levels x words), and per row its length, the alignments and the rest."""
    n, dim = ints.shape
    size = padded(dim)
    x = np.zeros((n, size))
    x[:, :dim] = ints
    length = np.sqrt((x * x).sum(axis=1))
    rest = x / np.where(length > 0, length, 1.0)[:, None]
    codes = np.zeros((n, levels, size // 64), dtype=np.uint64)
    frame = np.zeros((n, levels + 2))
    frame[:, 0] = length
    for level in range(levels):
        # Each level turns what the levels before left, in the frame they left it in.
        rest = rotate(rest, level)
        up = rest >= 0
        codes[:, level] = to_words(up)
        frame[:, 1 + level] = np.abs(rest).sum(axis=1) / np.sqrt(size)
        rest = rest - np.where(up, 1.0, -1.0) * (frame[:, 1 + level] / np.sqrt(size))[:, None]
    frame[:, -1] = np.sqrt((rest * rest).sum(axis=1))
    return codes, frame


class Anchors:
    """A block of anchors, rounded to bit planes for every level."""

    def __init__(self, ints: np.ndarray, levels: int):
        n, dim = ints.shape
        size = padded(dim)
        x = np.zeros((n, size))
        x[:, :dim] = ints
        self.length = np.sqrt((x * x).sum(axis=1))
        half = 1 << (PLANES - 1)
        self.planes, self.unit, self.shift, error = [], [], [], [self.length]
        for level in range(levels):
            x = rotate(x, level)
            unit = np.abs(x).max(axis=1) / (half - 1)
            k = np.rint(x / np.where(unit > 0, unit, 1.0)[:, None]).astype(np.int64)
            error.append(np.sqrt(((x - unit[:, None] * k) ** 2).sum(axis=1)))
            self.planes.append(np.stack([to_words((k + half) >> p & 1 == 1) for p in range(PLANES)], axis=1))
            self.unit.append(unit / np.sqrt(size))
            self.shift.append(k.sum(axis=1))
        self.error = np.stack(error, axis=1)  # anchors x (1 + levels)

    def intervals(self, at: slice, codes: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of these anchors (rows) with a tile (columns)."""
        half, levels = 1 << (PLANES - 1), codes.shape[1]
        length = frame[:, 0]
        estimate = np.zeros((len(self.length[at]), len(length)))
        for level in range(levels):
            hits = np.zeros(estimate.shape, dtype=np.int32)
            for word in range(codes.shape[2]):
                code = codes[:, level, word]
                for p in range(PLANES):
                    hits += np.left_shift(np.bitwise_count(code[None, :] & self.planes[level][at, p, word, None]), p, dtype=np.int32)
                hits -= half * np.bitwise_count(code).astype(np.int32)[None, :]
            # The signs are 2 * bit - 1.
            estimate += (2 * hits - self.shift[level][at, None]) * self.unit[level][at, None] * (frame[:, 1 + level] * length)[None, :]
        bound = np.concatenate([frame[:, -1:], frame[:, 1:-1]], axis=1) * length[:, None]
        width = self.error[at] @ bound.T + 1e-9 * self.length[at, None] * length[None, :] + 1e-6
        return estimate - width, estimate + width


class Best:
    """The ``k`` best rows of each slot: highest score, then smallest id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score, self.id = np.full((slots, k), NONE), np.full((slots, k), LAST_ID)

    def least(self) -> np.ndarray:
        """What a row must reach to be among them."""
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        met = np.unique(slot)
        slots = np.concatenate([np.repeat(met, self.k), slot])
        score = np.concatenate([self.score[met].ravel(), score])
        ids = np.concatenate([self.id[met].ravel(), ids])
        order = np.lexsort((ids, -score.clip(NONE + 1), slots))
        slots = slots[order]
        first = np.searchsorted(slots, met)
        keep = order[(first[:, None] + np.arange(self.k)[None, :]).ravel()]
        self.score[met], self.id[met] = score[keep].reshape(-1, self.k), ids[keep].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.score > NONE)
        return slot, self.id[slot, place], self.score[slot, place]


def _fixed(column: pa.Array, kind: str, n: int) -> np.ndarray:
    """Binary values of one length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(n, -1)


def _scores(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows a of x with rows b of y."""
    parts = [np.einsum("ij,ij->i", x[a[i : i + 16384]], y[b[i : i + 16384]]) for i in range(0, len(a), 16384)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def encode_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, anchors: Column, scale: int, levels: int) -> DataFrame:
    """``uid, id, label, anchor, dim, ints, codes, frame`` of the rows that take part."""
    kind = dict(vectors.dtypes)[label_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), int(dim))
                real = np.isfinite(x).all(axis=1)  # a null component reads as not a number
                at, x = at[real], np.floor(scale * x[real])
                if len(at) and dim and np.abs(x).max() >= 2**31:
                    raise OverflowError("a component is too large for scores of 63 bits")
                ints = x.astype("<i4")
                codes, frame = code_rows(ints, levels)
                part = batch.take(pa.array(at)).select(["uid", "id", "label", "anchor"])
                packed = [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (ints, codes.astype("<u8"), frame.astype("<f8"))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), dim, dtype=np.int32)), *packed], ["uid", "id", "label", "anchor", "dim", "ints", "codes", "frame"])

    real = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
    named = real.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).alias("v"),
    )
    return stored(named.mapInArrow(run, f"uid bigint, id bigint, label {kind}, anchor boolean, dim int, ints binary, codes binary, frame binary"), "coded")


def meet(rows: DataFrame, anchors: DataFrame, keys: list[str], run: Callable, out: str) -> DataFrame:
    """``run`` over every tile of ``rows`` beside every block of ``anchors`` of the same ``keys``."""
    lanes_at_least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sizes(df: DataFrame, size: int, name: str) -> DataFrame:
        pieces = F.ceil(F.count("*") / size)
        counted = df.groupBy(*keys).agg(pieces.cast("int").alias(f"{name}_pieces"))
        return counted.withColumn(f"{name}_lanes", F.least(f"{name}_pieces", F.greatest(F.lit(lanes_at_least), F.ceil(F.col(f"{name}_pieces") / LANE).cast("int"))))

    both = sizes(rows, TILE, "row").join(sizes(anchors, BLOCK, "anchor"), keys)  # one row per key

    def packed(df: DataFrame, name: str, other: str, fields: list[str]) -> DataFrame:
        piece = F.pmod(F.xxhash64("uid"), F.col(f"{name}_pieces")).cast("int")
        placed = df.join(both, keys).withColumn("piece", piece)
        spread = [*keys, "piece", f"{name}_lanes", f"{other}_lanes"]
        tiles = placed.groupBy(*spread).agg(F.collect_list(F.struct(*fields)).alias(name))  # about TILE or BLOCK each
        own, others = F.expr(f"piece % {name}_lanes"), F.explode(F.expr(f"sequence(0, {other}_lanes - 1)"))
        return tiles.select(*keys, name, own.alias(f"{name}_lane"), others.alias(f"{other}_lane"))

    tiles = packed(rows, "row", "anchor", ["id", "label", "ints", "codes", "frame"])
    blocks = packed(anchors, "anchor", "row", [c for c in anchors.columns if c not in (*keys, "dim", "codes", "frame", "anchor")])
    met = tiles.join(blocks, [*keys, "row_lane", "anchor_lane"])
    return met.select(F.col("dim"), "row", "anchor").mapInArrow(run, out)


def _search(batches: Iterator[pa.RecordBatch], levels: int, make: Callable, step: Callable, give: Callable) -> Iterator[pa.RecordBatch]:
    """Runs ``step`` on each pair of tile and block; results leave when the task ends, or when it
    has met many blocks."""
    blocks: dict[int, tuple] = {}
    for batch in batches:
        dims, rows, anchors = (batch.column(c) for c in ("dim", "row", "anchor"))
        for i in range(batch.num_rows):
            dim, tile, block = dims[i].as_py(), rows[i].values, anchors[i].values
            n = len(tile)
            uid = block.field("uid").to_numpy()
            key = int(uid[0])
            if key not in blocks:
                if len(blocks) >= KEPT_BLOCKS:
                    for state in blocks.values():
                        yield give(*state)
                    blocks.clear()
                ints = _fixed(block.field("ints"), "<i4", len(uid)).astype(np.int64)
                blocks[key] = (uid, ints, Anchors(ints, levels), *make(block))
            state = blocks[key]
            ints = _fixed(tile.field("ints"), "<i4", n).astype(np.int64)
            _, theirs = state[0], state[1]
            if dim and float(np.abs(ints).max()) * float(np.abs(theirs).max()) * dim >= 2.0**63:
                raise OverflowError("scores may pass 63 bits")
            codes = _fixed(tile.field("codes"), "<u8", n).reshape(n, levels, -1)
            step(state, tile, ints, codes, _fixed(tile.field("frame"), "<f8", n))
    for state in blocks.values():
        yield give(*state)


def find_positives(rows: DataFrame, anchors: DataFrame, k: int, levels: int) -> DataFrame:
    """``uid, place, id, score``: the ``k`` best other rows of the label of each anchor."""

    def make(block: pa.StructArray) -> tuple:
        return block.field("id").to_numpy(), Best(len(block), k)

    def step(state: tuple, tile: pa.StructArray, ints: np.ndarray, codes: np.ndarray, frame: np.ndarray) -> None:
        _, theirs, anchors, own, best = state
        ids = tile.field("id").to_numpy()
        for at in range(0, len(own), STEP):
            part = slice(at, at + STEP)
            low, high = anchors.intervals(part, codes, frame)
            other = ids[None, :] != own[part, None]
            low = np.where(other, low, -np.inf)
            # The k-th best lower bound is reached by k rows for sure.
            sure = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
            a, b = np.nonzero((high >= np.maximum(sure, best.least()[part].astype(np.float64))[:, None]) & other)
            best.add(a + at, _scores(theirs, ints, a + at, b), ids[b])

    def give(uid: np.ndarray, _, __, ___, best: Best) -> pa.RecordBatch:
        slot, ids, score = best.rows()
        return pa.RecordBatch.from_arrays([pa.array(uid[slot]), pa.array(ids), pa.array(score)], ["uid", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _search(batches, levels, make, step, give)

    found = meet(rows, anchors, ["dim", "label"], run, "uid bigint, id bigint, score bigint")
    return ranked(found, ["uid"], k, "place")


def find_negatives(rows: DataFrame, anchors: DataFrame, k: int, low: int, high: int, levels: int) -> DataFrame:
    """``uid, place, id, score, rank``: for each positive of each anchor (``scores``, by ``place``) the
    ``k`` best rows of other labels within ``low`` to ``high`` hundredths of its score."""

    def make(block: pa.StructArray) -> tuple:
        given = block.field("scores").to_pylist()
        n = max(map(len, given), default=0)
        score = np.full((len(given), n), NONE)
        for i, g in enumerate(given):
            score[i, : len(g)] = g
        none = score == NONE
        p = np.where(none, 0, score).astype(object)  # exact whatever the size
        least = np.where(none, LAST_ID, -(-low * p // 100)).astype(np.int64)
        most = np.where(none, NONE, high * p // 100).astype(np.int64)
        return block.field("label").to_pylist(), least, most, Best(score.size, k)

    def step(state: tuple, tile: pa.StructArray, ints: np.ndarray, codes: np.ndarray, frame: np.ndarray) -> None:
        _, theirs, anchors, label, least, most, best = state
        ids, n, numbers = tile.field("id").to_numpy(), least.shape[1], {}
        label, labels = (np.array([numbers.setdefault(x, len(numbers)) for x in c]) for c in (label, tile.field("label").to_pylist()))
        for at in range(0, len(label), STEP):
            part = slice(at, at + STEP)
            floor, ceiling = least[part], most[part]
            if not (floor <= ceiling).any():
                continue
            below, above = anchors.intervals(part, codes, frame)
            other = label[part, None] != labels[None, :]
            reach = np.zeros(below.shape, dtype=bool)
            for j in range(n):
                # Rows surely inside the band; the k-th best lower bound among them is reached for sure.
                inside = np.where(other & (below >= floor[:, j, None]) & (above <= ceiling[:, j, None]), below, -np.inf)
                sure = np.partition(inside, -k, axis=1)[:, -k] if inside.shape[1] >= k else np.full(len(inside), -np.inf)
                need = np.maximum(np.maximum(floor[:, j], best.least().reshape(-1, n)[part, j]).astype(np.float64), sure)
                reach |= (above >= need[:, None]) & (below <= ceiling[:, j, None]) & (floor[:, j] <= ceiling[:, j])[:, None]
            a, b = np.nonzero(reach & other)
            score = _scores(theirs, ints, a + at, b)
            for j in range(n):
                fits = (score >= floor[a, j]) & (score <= ceiling[a, j])
                best.add((a[fits] + at) * n + j, score[fits], ids[b[fits]])

    def give(uid: np.ndarray, _, __, ___, least: np.ndarray, ____, best: Best) -> pa.RecordBatch:
        slot, ids, score = best.rows()
        n = max(least.shape[1], 1)
        return pa.RecordBatch.from_arrays([pa.array(uid[slot // n]), pa.array((slot % n + 1).astype(np.int32)), pa.array(ids), pa.array(score)], ["uid", "place", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _search(batches, levels, make, step, give)

    found = meet(rows, anchors, ["dim"], run, "uid bigint, place int, id bigint, score bigint")
    return ranked(found, ["uid", "place"], k, "rank")


def ranked(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The ``k`` best of each key, numbered from 1. A task sends at most ``k`` rows of a key."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE, levels: int = LEVELS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for every row
    that fulfils ``anchors`` and each of its first ``positives`` other rows of its label, the first
    ``negatives`` rows of other labels that score ``low`` to ``high`` hundredths of the positive.
    Higher scores come first, ties by smaller id."""
    rows = encode_rows(vectors, id_col, vector_col, label_col, anchors, scale, levels)
    asking = rows.where("anchor")
    best = stored(find_positives(rows, asking, positives, levels), "positives")
    scores = best.groupBy("uid").agg(F.expr("transform(array_sort(collect_list(struct(place, score))), x -> x.score)").alias("scores"))
    found = find_negatives(rows, asking.join(scores, "uid"), negatives, low, high, levels)
    names = asking.select("uid", F.col("id").alias("anchor_id"))
    chosen = best.select("uid", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    negative = found.select("uid", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return negative.join(chosen, ["uid", "place"]).join(names, "uid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
