"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

1. Fit on a bounded sample (``SAMPLE`` valid vectors with the smallest hash of their id), for each
   length of vectors by itself: principal axes of the unit vectors, then a rotation that brings the projections
   closest to the corners of a cube, found by alternating signs and a Procrustes solution. Every vector gets a
   code of 64 balanced bits; vectors of fewer components get further bits from random rotations.
   Lengths with less than ``SHARE`` of the sample take random rotations around zero, which keep all angles
   whatever the data.
2. Codes are cut into ``TABLES`` substrings. Vectors of one label whose substrings differ in at
   most ``probe`` bits in any table are retrieved for each other. Buckets beyond ``TILE`` rows
   are split by hash, and pairs of pieces are compared.
3. Retrieved pairs are compared with their original vectors, in double precision. A pair counts
   in the first table that retrieves it. Only counts per vector and a spanning forest of the links
   leave a comparison, never the pairs.

Taking codes around the mean widens the angles of vectors that share a direction, so how many bits
a pair at the threshold differs in depends on the data. By default ``probe`` is the least that
retrieves ``RECALL`` of pairs made at the threshold itself from the sample, with steps in any
direction and with steps towards other vectors. Without a common direction that is 0 for 64
components; closer pairs are missed less often. For tables of billions of
vectors use 4 tables of 16 bits with ``probe=2``: more look-ups, far smaller buckets.

Defined cases: null, empty, zero, null-holding or non-finite vectors, null labels and null ids link
with nothing: they have no links and are a component of their own (null for a null id, and kept). Vectors of
different length don't link with each other. Rows of one id are one vector: they don't link with
each other and their links add up. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import least_hashes, stored
from driftwell.llm.components import components

COSINE = 0.93
SAMPLE, SHARE = 20_000, 0.05
BITS, TABLES, RECALL = 64, 8, 0.95
TILE = 1024


def lengths(column: pa.Array) -> list[int]:
    """The different lengths of the vectors, without 0."""
    return [n for n in pa.compute.list_value_length(column).unique().to_pylist() if n]


def unit_rows(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length ``dim`` (None: the most frequent) as unit rows in double precision, and
    the places of the valid ones."""
    sizes = np.array([-1 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], dtype=np.int64)
    if dim is None:
        dim = int(np.bincount(sizes[sizes > 0]).argmax()) if (sizes > 0).any() else 0
    at = np.flatnonzero((sizes == dim) & (dim > 0))
    flat = column.take(pa.array(at)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dim) if len(at) else np.zeros((0, dim))
    return _unit(x, at)


def _unit(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    finite = np.isfinite(x).all(axis=1)  # a null component reads as not a number
    x, at = x[finite], at[finite]
    top = np.abs(x).max(axis=1, initial=0.0)
    x, at = x[top > 0] / top[top > 0, None], at[top > 0]  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1)[:, None], at


class Quantiser:
    """Mean and rotated axes; a bit is the sign of a projection."""

    def __init__(self, units: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 7):
        n, self.dim = units.shape
        self.bits = bits
        self.mean = units.mean(axis=0) if n else np.zeros(self.dim)
        centred = units - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, : self.bits]
        projected = centred @ axes
        draw, size = np.random.default_rng(seed), axes.shape[1]
        turns = [np.linalg.qr(draw.normal(size=(size, size)))[0] for _ in range(-(-bits // size))]
        for _ in range(rounds if n else 0):
            u, _, v = np.linalg.svd(projected.T @ np.where(projected @ turns[0] > 0, 1.0, -1.0))
            turns[0] = u @ v
        self.axes = axes @ np.concatenate(turns, axis=1)[:, :bits]

    def codes(self, units: np.ndarray) -> np.ndarray:
        signs = np.zeros((len(units), 64), dtype=np.uint8)
        signs[:, : self.bits] = (units - self.mean) @ self.axes > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u8").ravel()


def least_probe(units: np.ndarray, model: Quantiser, cosine: float, tables: int, recall: float = RECALL, seed: int = 11) -> int:
    """The least probe that retrieves this share of pairs at ``cosine``, made from units of the sample."""
    width, draw, probe = 64 // tables, np.random.default_rng(seed), 0
    units = units[:4000]
    codes = model.codes(units)
    for step in (draw.normal(size=units.shape), units[draw.permutation(len(units))]):
        step = step - (step * units).sum(axis=1)[:, None] * units
        size = np.linalg.norm(step, axis=1)
        real = size > 1e-6
        if not real.any():
            continue
        near = cosine * units[real] + np.sqrt(max(0.0, 1 - cosine**2)) * step[real] / size[real, None]
        apart = codes[real] ^ model.codes(near)
        least = np.min([np.bitwise_count(apart >> np.uint64(width * t) & np.uint64((1 << width) - 1)) for t in range(tables)], axis=0)
        while (least <= probe).mean() < recall:
            probe += 1
    return probe


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, cosine: float = COSINE, tables: int = TABLES) -> tuple[dict[int, Quantiser], int] | None:
    """The quantisers by length and the probe that this sample asks for; None if no vector is valid."""
    drawn = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    h = F.xxhash64(id_col)
    drawn = least_hashes(drawn.select(id_col, vector_col), sample, drawn.count(), h)
    drawn = drawn.orderBy(h, id_col).limit(sample).select(F.col(vector_col).alias("v")).toArrow()
    column = drawn.column("v").combine_chunks() if drawn.num_rows else pa.array([], pa.list_(pa.float64()))
    units = {dim: unit_rows(column, dim)[0] for dim in lengths(column)}
    total = sum(map(len, units.values()))
    if not total:
        return None
    models = {dim: Quantiser(x) for dim, x in units.items() if len(x) >= SHARE * total}
    return models, max((least_probe(units[dim], model, cosine, tables) for dim, model in models.items()), default=0)


def same_label_links(vectors: DataFrame, models: dict[int, Quantiser], id_col: str, vector_col: str, label_col: str, cosine: float, tables: int, probe: int) -> DataFrame:
    """``a, b``: a spanning forest of the links; and ``a, n``: links of vector a, to be added up."""
    kinds = dict(vectors.dtypes)
    width = 64 // tables

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(models)
        for batch in batches:
            for dim in lengths(batch.column("v")):
                if dim not in known:
                    known[dim] = Quantiser(np.zeros((0, dim)))
                units, at = unit_rows(batch.column("v"), dim)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), dim, dtype=np.int32)), pa.array(known[dim].codes(units).view(np.int64))], ["id", "label", "v", "dim", "code"])

    real = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
    named = real.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    coded = stored(named.mapInArrow(encode, f"id bigint, label {kinds[label_col]}, v {kinds[vector_col]}, dim int, code bigint"), "codes")

    cut = F.array(*[F.shiftrightunsigned("code", width * t).bitwiseAND(F.lit((1 << width) - 1)) for t in range(tables)])
    placed = coded.select("id", "label", "v", "dim", "code", F.posexplode(cut).alias("t", "bucket"))
    key = ["label", "dim", "t", "bucket"]
    sizes = placed.groupBy(*key).agg(F.ceil(F.count("*") / TILE).cast("int").alias("pieces"))
    split = placed.join(sizes, key).withColumn("piece", F.pmod(F.xxhash64("id", "code"), F.col("pieces")).cast("int"))
    tiles = split.groupBy(*key, "piece", "pieces").agg(F.collect_list(F.struct("id", "code", "v")).alias("rows"))  # about TILE each
    tiles = stored(tiles, "tiles")

    def compare(x: pa.StructArray, y: pa.StructArray, t: int, same: bool) -> pa.RecordBatch:
        (ix, cx, ux), (iy, cy, uy) = unpack(x), unpack(y)
        left, right = np.zeros(len(ix), dtype=np.int64), np.zeros(len(iy), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(ix), 256):
            rows = slice(at, at + 256)
            hit = (ux[rows] @ uy.T >= cosine) & (ix[rows, None] != iy[None, :])
            for earlier in range(t):
                apart = (cx[rows, None] ^ cy[None, :]) >> np.uint64(width * earlier) & np.uint64((1 << width) - 1)
                hit &= np.bitwise_count(apart) > probe
            left[rows] = hit.sum(axis=1)
            right += hit.sum(axis=0)
            a, b = np.nonzero(hit)
            found.append((a + at, b))
        a, b = (np.concatenate(z) for z in zip(*found))
        ea, eb = spanning(ix, iy, a, b)
        ids, n = (ix, left) if same else (np.concatenate([ix, iy]), np.concatenate([left, right]))
        some = n > 0
        none = pa.nulls(len(ea), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ea, ids[some]])), pa.concat_arrays([pa.array(eb), pa.nulls(int(some.sum()), pa.int64())]), pa.concat_arrays([none, pa.array(n[some])])],
            ["a", "b", "n"],
        )

    def unpack(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        units, _ = unit_rows(rows.field("v"))  # all of one length
        return rows.field("id").to_numpy(), rows.field("code").to_numpy().view(np.uint64), units

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, t in zip(batch.column("rows"), batch.column("t").to_pylist()):
                if len(rows) > 1:
                    yield compare(rows.values, rows.values, t, True)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, t in zip(batch.column("from_rows"), batch.column("rows"), batch.column("t").to_pylist()):
                yield compare(x.values, y.values, t, False)

    out = "a bigint, b bigint, n bigint"
    single = tiles.select("rows", "t").mapInArrow(within, out)
    moves = [sum(1 << b for b in bits) for r in range(1, probe + 1) for bits in combinations(range(width), r)]
    other = tiles.select("label", "dim", "t", F.col("bucket").alias("from_bucket"), F.col("piece").alias("from_piece"), F.col("rows").alias("from_rows"), "pieces")
    apart = other.where("pieces > 1").withColumn("bucket", F.col("from_bucket"))  # pieces of one bucket
    if moves:  # and buckets a few bits apart
        probed = other.withColumn("bucket", F.explode(F.array(*[F.col("from_bucket").bitwiseXOR(F.lit(m)) for m in moves])))
        apart = apart.unionByName(probed)
    pairs = apart.drop("pieces").join(tiles, key).where((F.col("from_bucket") < F.col("bucket")) | (F.col("from_bucket") == F.col("bucket")) & (F.col("from_piece") < F.col("piece")))
    return stored(single.union(pairs.select("from_rows", "rows", "t").mapInArrow(between, out)), "links")


def spanning(ix: np.ndarray, iy: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between ids that connect what the links (rows a of the left, rows b of the right) connect."""
    nodes, place = np.unique(np.concatenate([ix[a], iy[b]]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        for at in (a, b, before[a], before[b]):
            np.minimum.at(label, at, low)
        label = label[label]
        if (label == before).all():
            break
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, sample: int = SAMPLE, tables: int = TABLES, probe: int | None = None,
) -> DataFrame:
    """``id, n_links, component_id`` (smallest id reachable), ``kept`` of every row."""
    ids = vectors.select(F.col(id_col).cast("bigint").alias(id_col))
    fitted = fit(vectors, id_col, vector_col, sample, cosine, tables)
    if fitted is None:
        return ids.select(id_col, F.lit(0).cast("bigint").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    models, least = fitted
    probe = least if probe is None else probe
    found = same_label_links(vectors, models, id_col, vector_col, label_col, cosine, tables, probe)
    counts = found.where("n is not null").groupBy(F.col("a").alias(id_col)).agg(F.sum("n").alias("n_links"))
    joined = components(found.where("b is not null").select("a", "b")).withColumnsRenamed({"node": id_col, "component": "component_id"})
    out = ids.join(counts, id_col, "left").join(joined, id_col, "left")
    component = F.coalesce("component_id", id_col)
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(True)).alias("kept"))
