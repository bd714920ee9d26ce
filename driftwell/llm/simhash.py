"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: a bit is set if more than half of a text's shingle hashes have it.

Links: different fingerprints are sorted into tiles by the population counts of their four
16-bit parts. Fingerprints whose part counts differ by more than the radius in total differ in
more bits than that, so such pairs of tiles are never formed. Tiles beyond ``TILE`` rows are split
by hash. Each remaining pair of tiles is compared whole, with exclusive-or and bit counts, and
yields a spanning forest of its links instead of all of them: components stay the same, and a
pair of tiles never yields more rows than it has fingerprints.

Components are those of the fingerprints, each named by its smallest document.

Defined cases: a null or empty text, or one without words, has fingerprint zero, which is linked
like any other; fewer words than a shingle are one shingle; repeated rows share a fingerprint; a
null id keeps its fingerprint, links nothing and has a null component unless a row with an id has
a linked fingerprint; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import fresh, in_steps, stored
from driftwell.llm.components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
PARTS = 4
TILE = 1024


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    size = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id, __same`` (a hash of the text), ``fp`` (64 bits in a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, "__text"):
            found = [fingerprint(t, shingle) for t in batch.column("__text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("__same"), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], [id_col, "__same", "fp"])

    texts = docs.select(id_col, F.xxhash64(text_col).alias("__same"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return texts.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, __same bigint, fp bigint")


def part_counts(fp: Column) -> list[Column]:
    mask = (1 << 64 // PARTS) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, 64 // PARTS * k).bitwiseAND(F.lit(mask))).cast("int") for k in range(PARTS)]


def tile_key(counts: list[Column]) -> Column:
    """The part counts, 0 to 16 each, in one number."""
    key = F.lit(0)
    for c in counts:
        key = key * 32 + c
    return key


def near_offsets(radius: int) -> list[int]:
    """Differences of tile keys whose part counts differ by at most ``radius`` in total; of each
    pair of opposite ones the positive one, and zero."""
    moves = [m for m in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, m)) <= radius]
    keys = [sum(x * 32 ** (PARTS - 1 - i) for i, x in enumerate(m)) for m in moves]
    return sorted(k for k in keys if k >= 0)


def forest(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links within the radius connect."""
    n = len(left)
    nodes = left if same else np.concatenate([left, right])
    shift = 0 if same else n
    parts = []
    for at in range(0, n, 256):
        a, b = np.nonzero(np.bitwise_count(left[at : at + 256, None] ^ right[None, :]) <= radius)
        parts.append((a + at, b + shift))
    a, b = (np.concatenate(x) for x in zip(*parts))
    real = a != b
    a, b = a[real], b[real]
    label = np.arange(len(nodes))
    while len(a):  # a star around the smallest node of each component
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: a spanning forest of the links between the different ``fp`` of ``prints``.

    ``prints`` has each fingerprint once.
    """
    keyed = prints.select("fp", tile_key(part_counts(F.col("fp"))).alias("tile"))
    sizes = keyed.groupBy("tile").agg(F.ceil(F.count("*") / TILE).cast("int").alias("pieces"))  # at most 17**PARTS rows
    split = keyed.join(F.broadcast(sizes), "tile").withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    tiles = stored(split.groupBy("tile", "piece").agg(F.collect_list("fp").alias("fps")), "tiles")  # about TILE each
    offsets = F.array(*[F.lit(k) for k in near_offsets(radius)])
    reach = tiles.select(F.col("tile").alias("from_tile"), F.col("piece").alias("from_piece"), F.col("fps").alias("from_fps"), F.explode(offsets).alias("move"))
    present = sizes.select("tile")
    reach = reach.withColumn("tile", F.col("from_tile") + F.col("move")).join(F.broadcast(present), "tile", "left_semi")
    pairs = reach.join(tiles, "tile").where((F.col("move") != 0) | (F.col("from_piece") <= F.col("piece")))
    same = (F.col("move") == 0) & (F.col("from_piece") == F.col("piece"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, same = (batch.column(c) for c in ("from_fps", "fps", "same"))
            for i in range(batch.num_rows):
                x, y = (c[i].values.to_numpy().view(np.uint64) for c in (left, right))
                a, b = forest(x, y, radius, same[i].as_py())
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return pairs.select("from_fps", "fps", same.alias("same")).mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``id, fingerprint`` (16 hexadecimal digits) and ``component_id`` (smallest id reachable) of every row."""
    out = classed(docs, id_col, text_col, shingle, radius)
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classed(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> DataFrame:
    """The rows of :func:`fingerprints` with ``component_id``."""
    found = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = stored(found.groupBy("fp").agg(F.min(id_col).alias("name")), "fingerprint-names")
    near = links(named.where("name is not null").select("fp"), radius)
    names_a, names_b = (named.select(F.col("fp").alias(c), F.col("name").alias(f"name_{c}")) for c in ("a", "b"))
    joined = components(near.join(names_a, "a").join(names_b, "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b")))
    classes = named.join(joined.withColumnRenamed("node", "name"), "name", "left").select("fp", F.coalesce("component", "name").alias("component_id"))
    return found.join(classes, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each group: the one whose id names the group. Each text of a
    repeated id is judged by its own group. Rows that repeat an id and its text count once; rows with a null id stay."""
    found = classed(docs, id_col, text_col, SHINGLE, RADIUS)
    same, row = fresh(docs, "__same"), fresh(docs, "__row")
    others = found.where(F.col("component_id") != F.col(id_col)).select(id_col, F.col("__same").alias(same)).distinct()
    left = docs.withColumn(same, F.xxhash64(text_col)).join(others, [id_col, same], "left_anti")
    left = left.withColumn(row, F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()))  # no two null ids are the same
    return left.dropDuplicates([id_col, same, row]).select(*[F.col(f"`{c}`") for c in docs.columns])
