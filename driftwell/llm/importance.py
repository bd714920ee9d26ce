"""Importance resampling towards a target corpus: array-scored weights and exact weighted
median-of-medians selection.

1. All texts of documents and target become counts of ``BUCKETS`` hashed runs of one to three words
   (CRC-32 of the run's bytes). The CRC is linear over bits, so the value of each word comes from table
   look-ups by byte and distance to the word's end, and runs are joined by shifting what stands before.
   Counts are summed per task; one row per bucket comes back.
2. The gain of a bucket is the logarithm of its share in the target over its share in the documents.
   Each document's weight is the sum of its features' gains; its score adds Gumbel noise that depends on
   its id only, so the best scores are a draw without replacement in proportion to the weights.
3. The cutoff is the exact key (score, id, features) of the last row drawn. In each round every piece of the remaining
   keys (at most ``PIECE`` rows of a task) reports its size and median. The median of these, weighted by the sizes, has at least
   a quarter of all keys on each side, so every round discards a quarter for sure: the keys beyond are counted
   and either kept or discarded whole. Where only a fraction of the stored keys remains, it is written anew, so all
   rounds together read a small multiple of the keys. Nothing but one row per piece reaches the driver.
4. Only rows up to the cutoff are sorted and ranked.

Defined cases: a null or empty text has no features and weight 0; texts of fewer than ``LEAST_WORDS``
words are never drawn. A row with a null id has a weight, no score and is never drawn or counted. Rows of one id are rows of
their own; ties of score and id come in order of the number of features, and rows that are equal in all three
take the ranks left in any order, which gives the same rows. An empty target has no features, as the formula
says. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import byte_view, in_steps, stored
from driftwell.operators.rounds import global_positions

BUCKETS, RUN = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, "42"
NEAR = 64  # bytes of a word that table look-ups cover
PIECE = 1 << 20
FEW = 4096
KEY = ["score", "doc", "n_features"]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@lru_cache(maxsize=1)
def crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By distance to the end: what a byte adds to the CRC, what length alone makes of it, and
    what each byte of an earlier CRC turns into when that many bytes follow."""
    zeros = [zlib.crc32(bytes(n)) for n in range(NEAR + 2)]
    of_byte = np.array([[zlib.crc32(bytes([b]) + bytes(d)) ^ zeros[d + 1] for b in range(256)] for d in range(NEAR)], dtype=np.uint32)
    later = np.zeros((NEAR + 2, 4, 256), dtype=np.uint32)
    for n in range(NEAR + 2):
        for place in range(4):
            # zlib continues a CRC; two starts that differ in these bits differ in the shifted bits.
            later[n, place] = [zlib.crc32(bytes(n), b << 8 * place) ^ zeros[n] if n else b << 8 * place for b in range(256)]
    return of_byte, np.array(zeros, dtype=np.uint32), later


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What CRCs contribute when ``n`` bytes follow."""
    later = crc_tables()[2]
    out = later[n, 0, crc & 0xFF]
    for place in range(1, 4):
        out = out ^ later[n, place, crc >> np.uint32(8 * place) & np.uint32(0xFF)]
    return out


def run_hashes(data: np.ndarray, offsets: np.ndarray, longest: int = RUN) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text, and for runs of 1, 2 .. words: the text and the CRC-32 of each."""
    data = LOWER[data]
    inside = IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]  # no word goes on from one text to the next
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    ends = np.flatnonzero(ends) + 1
    n_words = np.diff(np.searchsorted(starts, offsets))
    text = np.repeat(np.arange(len(n_words)), n_words)
    size = ends - starts
    of_byte, zeros, _ = crc_tables()
    crc = np.zeros(len(starts), dtype=np.uint32)
    if len(starts):
        which = np.repeat(np.arange(len(starts)), size)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        left = np.minimum(size[which] - 1 - place, NEAR - 1)
        crc = np.bitwise_xor.reduceat(of_byte[left, data[starts[which] + place]], np.cumsum(size) - size) ^ zeros[np.minimum(size, NEAR)]
    raw = data.tobytes()
    long = size > NEAR
    for i in np.flatnonzero(long):
        crc[i] = zlib.crc32(raw[starts[i] : ends[i]])
    near = np.minimum(size, NEAR) + 1
    tail = crc ^ shifted(np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32), near - 1)  # of a blank and the word
    found, before = [(text, crc)], crc
    for k in range(2, longest + 1):
        # Runs that end in word i: what the run up to word i - 1 turns into, and the blank and word.
        joined = shifted(before[:-1], near[1:]) ^ tail[1:]
        for i in np.flatnonzero(long[1:]):  # rare: beyond the tables
            if i + 2 >= k:
                joined[i] = zlib.crc32(b" " + raw[starts[i + 1] : ends[i + 1]], int(before[i]))
        before = np.concatenate([before[:1], joined])
        whole = np.zeros(len(text), dtype=bool)
        whole[k - 1 :] = text[k - 1 :] == text[: len(text) - k + 1]
        found.append((text[whole], before[whole]))
    return n_words, found


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in in_steps(batches, "text"):
            for _, crc in run_hashes(*byte_view(batch.column("text")))[1]:
                total += np.bincount(crc % np.uint32(BUCKETS), minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n bigint")
    summed = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row per bucket
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both shares, each bucket counted once more, rounded down."""
    whole, wanted = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * whole / ((s + 1) * wanted))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def noise(h: int) -> int:
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, seed: str) -> DataFrame:
    """``doc, n_features, weight, score, n_words`` of every row."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, "text"):
            n_words, found = run_hashes(*byte_view(batch.column("text")))
            weight = np.zeros(batch.num_rows, dtype=np.int64)
            n = np.zeros(batch.num_rows, dtype=np.int64)
            for text, crc in found:
                summed = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(BUCKETS)])])
                bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
                weight += np.diff(summed[bounds])
                n += np.diff(bounds)
            score = [None if h is None else w + noise(h) for h, w in zip(batch.column("h").to_pylist(), weight.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n), pa.array(weight), pa.array(score, pa.int64()), pa.array(n_words)], ["doc", "n_features", "weight", "score", "n_words"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), drawn.alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc bigint, n_features bigint, weight bigint, score bigint, n_words bigint")


def ahead(key: tuple[int, int, int]) -> Column:
    """Rows that come before this key: higher score, then smaller id, then fewer features."""
    score, doc, n = (F.lit(x).cast("bigint") for x in key)
    same = F.col("score") == score
    return (F.col("score") > score) | same & (F.col("doc") < doc) | same & (F.col("doc") == doc) & (F.col("n_features") < n)


def equal(key: tuple[int, int, int]) -> Column:
    return F.expr(" AND ".join(f"{c} = {v}L" for c, v in zip(KEY, key)))


def piece_medians(keys: DataFrame) -> list[tuple[int, tuple[int, int, int]]]:
    """Size and (upper) median of each piece of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def median() -> pa.RecordBatch:
            score, doc, features = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in KEY)
            middle = np.lexsort((features, doc, -score))[n // 2]
            return pa.RecordBatch.from_pylist([{"n": n, "score": int(score[middle]), "doc": int(doc[middle]), "n_features": int(features[middle])}])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PIECE:
                yield median()
                held, n = [], 0
        if n:
            yield median()

    found = keys.mapInArrow(run, "n bigint, score bigint, doc bigint, n_features bigint").collect()
    return [(r["n"], (r["score"], r["doc"], r["n_features"])) for r in found]


def order_of(key: tuple[int, int, int]) -> tuple[int, int, int]:
    return -key[0], key[1], key[2]


def weighted_median(pieces: list[tuple[int, tuple[int, int, int]]]) -> tuple[int, int, int]:
    half, passed = sum(n for n, _ in pieces) / 2, 0
    for n, key in sorted(pieces, key=lambda p: order_of(p[1])):
        passed += n
        if passed >= half:
            return key
    raise ValueError("no pieces")


def cutoff(keys: DataFrame, k: int) -> tuple[int, int, int] | None:
    """The key of the ``k``-th row of ``keys`` (``score, doc, n_features``, stored) in order; None if ``k`` is 0."""
    total = left = keys.count()
    if not 0 < k <= total:
        return None
    remaining, held = keys, total
    while left > FEW:
        pivot = weighted_median(piece_medians(remaining))
        before, same = remaining.agg(F.count_if(ahead(pivot)), F.count_if(equal(pivot))).first()
        if before < k <= before + same:
            return pivot
        if k <= before:
            remaining, left = remaining.where(ahead(pivot)), before
        else:
            remaining, k, left = remaining.where(~ahead(pivot) & ~equal(pivot)), k - before - same, left - before - same
        if left * 4 <= held:
            remaining, held = stored(remaining, "keys"), left
    last = sorted(((r["score"], r["doc"], r["n_features"]) for r in remaining.collect()), key=order_of)  # at most FEW
    return last[k - 1]


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """``id, n_features, weight, score, rank`` of every row: ``percent`` hundredths of the rows of at
    least ``least_words`` words are drawn, and ranked from 1; rank is null for the others."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    weighed = stored(weigh(docs, gain, id_col, text_col, seed), "weights")
    able = F.col("doc").isNotNull() & (F.col("n_words") >= least_words)
    keys = weighed.where(able).select(*KEY)
    k = percent * keys.count() // 100
    last = cutoff(keys, k)
    out = [F.col("doc").alias(id_col), "n_features", "weight", "score"]
    if last is None:
        return weighed.select(*out, F.lit(None).cast("bigint").alias("rank"))
    drawn = F.coalesce(able & (ahead(last) | equal(last)), F.lit(False))
    winners = weighed.where(drawn).withColumn("below", -F.col("score"))
    ranked = global_positions(winners, ["below", "doc", "n_features", "weight", "score"], "place")
    place = F.when(F.col("place") < k, F.col("place") + 1).alias("rank")
    return ranked.select(*out, place).union(weighed.where(~drawn).select(*out, F.lit(None).cast("bigint")))
