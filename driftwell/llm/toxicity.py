"""Toxicity by non-negative positive-unlabelled learning.

Features are the different words of a text and the beginnings (4 and 5 letters) and ends (4) of
its words, hashed. The classifier is linear with the logistic loss. Confirmed toxic documents are
the positives; documents drawn from all that may teach, whatever their label, stand for unlabelled
text. With the share ``prior`` of toxic documents the risk is

    prior * loss+(positives) + max(0, loss-(unlabelled) - prior * loss-(positives))

so the toxic part of the unlabelled text is not taken for clean, and the second term can't be
driven below zero by overfitting: where it would be, the step goes the other way. A proximal step
with an absolute penalty keeps only words that matter.

Bounds of the sample: ``POSITIVES`` and ``UNLABELLED`` documents with the smallest hash of their
id. The share of toxic documents is counted over all labelled rows that may teach. Whole texts
are scored.

Defined cases: null and empty texts get the score of a text without words; without any confirmed
example all scores are 0; an id with several labels counts as toxic if one of them says so; null
ids are scored but teach nothing; repeated rows are scored one by one; an empty table gives an
empty result. Other columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import in_steps, is_held_out, least_hashes, may_teach, refuse
from driftwell.llm.letters import bucket, grams, letters, word_hashes, word_starts

BITS = 18
POSITIVES, UNLABELLED = 4_000, 12_000
THRESHOLD = 0.3
#: Bytes of text at a time; each takes about 35 bytes of arrays.
STEP = 1 << 19


def features(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each feature, with repeats."""
    codes, at = letters(texts)
    begins, lengths = word_starts(codes)
    row = np.searchsorted(at, begins, side="right") - 1
    rows, found = [row], [word_hashes(codes, begins, lengths)]
    for k, (n, from_end) in enumerate(((4, False), (5, False), (4, True))):
        long = lengths >= n
        place = begins[long] + (lengths[long] - n if from_end else 0)
        rows.append(row[long])
        found.append(grams(codes, n)[place] ^ np.uint64((k + 1) << 56))
    return np.concatenate(rows), bucket(np.concatenate(found), BITS)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        row, at = features(texts)
        heavy = self.weights[at] != 0
        pair = np.unique(row[heavy] << BITS | at[heavy])
        total = np.bincount(pair >> BITS, weights=self.weights[pair & (1 << BITS) - 1], minlength=len(texts))
        return sigmoid(total + self.bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass(frozen=True)
class Rows:
    """Feature buckets of some documents, one after another."""

    at: np.ndarray
    starts: np.ndarray

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(self.starts)[rows]
        ends = np.cumsum(size)
        return np.repeat(np.arange(len(rows)), size), self.at[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - ends + size, size)]


def fit_weights(positive: Rows, unlabelled: Rows, prior: float, epochs: int = 40, batches: int = 24, rate: float = 0.05, penalty: float = 1e-3, seed: int = 3) -> Model:
    """Steps of Adam on the non-negative risk, each followed by a proximal step."""
    width = 1 << BITS
    w, bias = np.zeros(width + 1), float(np.log(prior / (1 - prior)))
    w[width] = bias
    m, v, t = np.zeros(width + 1), np.zeros(width + 1), 0
    draw = np.random.default_rng(seed)
    n_p, n_u = len(positive.starts) - 1, len(unlabelled.starts) - 1

    def forward(rows: Rows, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, at = rows.take(chosen)
        return row, at, np.bincount(row, weights=w[at], minlength=len(chosen)) + w[width]

    for epoch in range(epochs):
        parts_p, parts_u = np.array_split(draw.permutation(n_p), batches), np.array_split(draw.permutation(n_u), batches)
        for p, u in zip(parts_p, parts_u):
            if not len(p) or not len(u):
                continue
            (rp, ap, fp), (ru, au, fu) = forward(positive, p), forward(unlabelled, u)
            clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            toxic_slope, clean_slope = (sigmoid(fp) - 1) / len(p) * prior, -prior * sigmoid(fp) / len(p)
            if clean >= 0:
                gp, gu = toxic_slope + clean_slope, sigmoid(fu) / len(u)
            else:
                gp, gu = -clean_slope, -sigmoid(fu) / len(u)
            g = np.bincount(np.concatenate([ap, au]), weights=np.concatenate([gp[rp], gu[ru]]), minlength=width + 1)
            g[width] = gp.sum() + gu.sum()
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (1 - epoch / epochs) / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
            w -= step * m / (1 - 0.9**t)
            w[:width] = np.sign(w[:width]) * np.maximum(np.abs(w[:width]) - penalty * step[:width], 0)
    return Model(w[:width], float(w[width]))


def sampled_features(docs: DataFrame, text_col: str) -> Rows:
    """Features of all rows of ``docs`` (``__id``, ``__text`` a hash, and the text), in the order of the ids' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, text_col, STEP):
            row, at = features(batch.column(text_col).to_pylist())
            pair = np.unique(row << BITS | at)
            ends = np.searchsorted(pair >> BITS, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((pair & (1 << BITS) - 1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("__text"), lists], ["key", "hash", "at"])

    found = docs.select(F.xxhash64("__id").alias("key"), "__text", text_col).mapInArrow(run, "key bigint, hash bigint, at array<int>").toArrow()
    lists = found.sort_by([("key", "ascending"), ("hash", "ascending")]).column("at").combine_chunks()
    sizes = pa.compute.list_value_length(lists).to_numpy()
    return Rows(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """None without a confirmed toxic document."""
    known = labels.where(may_teach(F.col(id_col)) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not share:
        return None
    texts = docs.where(may_teach(F.col(id_col))).select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text"), text_col)
    row, h = ["__id", "__text"], F.xxhash64("__id")

    def sample(rows: DataFrame, n: int) -> Rows:
        """Rows, not ids, are drawn; what repeats id and text is one row."""
        few = least_hashes(rows, n, rows.count(), h).distinct()
        drawn = few.orderBy(h, *row).limit(n)  # so many keys are broadcast
        return sampled_features(texts.join(F.broadcast(drawn), row, "left_semi").dropDuplicates(row), text_col)

    found = [sample(texts.select(*row).join(known.where("toxic = 1"), "__id", "left_semi"), positives), sample(texts.select(*row), unlabelled)]
    if len(found[0].starts) < 2:
        return None
    return fit_weights(*found, prior=min(max(share, 1e-4), 0.9))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """``id, held_out, score, predicted`` and the columns ``keep`` of every row."""
    refuse(keep, id_col, "held_out", "score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a weight per bucket
    names = [id_col, "held_out", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, text_col, STEP):
            texts = batch.column(text_col).to_pylist()
            found = sent.value.scores(texts) if sent.value else np.zeros(len(texts))
            columns = [*(batch.column(c) for c in names), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted"])

    kinds = dict(docs.dtypes)
    read = [*keep, *([] if text_col in keep else [text_col])]
    texts = docs.select(id_col, is_held_out(F.col(id_col)).alias("held_out"), *read)
    schema = ", ".join([f"`{id_col}` {kinds[id_col]}", "held_out boolean", *(f"`{c}` {kinds[c]}" for c in keep), "score double", "predicted int"])
    return texts.mapInArrow(run, schema)
