"""Language of whole texts: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of 1 to 4 lower-cased letters, gaps between words included. Document
frequencies are counted over all documents that may teach. Weights are fitted on a bounded sample,
``PER_CLASS`` documents of each language with the smallest hash of their id, by the
follow-the-regularised-leader rule with elastic-net penalties, which leaves most weights at zero.
A fifth of the sample is kept from the fit; on it one temperature is found that makes the
probabilities fit the hits. Whole texts are scored.

Defined cases: a null text, or one without a letter, is ``und`` with score 1; ties go to the
language that comes first by name; without any document to learn from all texts are ``und``;
rows with a null id are scored but teach nothing; repeated rows are scored one by one; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.llm.common import in_steps, is_held_out, may_teach
from driftwell.llm.letters import bucket, grams, letters

BITS = 14
ORDERS = (1, 2, 3, 4)
PER_CLASS = 1000
UNKNOWN = "und"


def counts(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Counts of the hashed n-grams of each text."""
    codes, at = letters(texts)
    hashed = [bucket(grams(codes, n), BITS) for n in ORDERS]
    for a, b in zip(at[:-1], at[1:]):
        found = [h[a : max(a, b - n + 1)] for n, h in zip(ORDERS, hashed)]
        yield np.bincount(np.concatenate(found), minlength=1 << BITS)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # a row per bucket, a column per language
    bias: np.ndarray
    temperature: float

    def probabilities(self, count: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(count)
        x = tf_idf(count[at], self.idf[at])
        z = (x @ self.weights[at] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def tf_idf(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf
    norm = np.linalg.norm(x)
    return x / norm if norm else x


def document_frequencies(teachers: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Documents, and how many hold each bucket. Tasks add up; the driver gets a row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in in_steps(batches, text_col):
            for count in counts(batch.column(text_col).to_pylist()):
                total += count > 0
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int64()), pa.array([*total[at], n], pa.int64())], ["bucket", "n"])

    rows = teachers.select(text_col).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS, dtype=np.int64)
    found, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    out[found[found >= 0]] = n[found >= 0]
    return int(n[found < 0].sum()), out


def sampled_features(teachers: DataFrame, id_col: str, text_col: str, lang_col: str, per_class: int) -> pa.Table:
    """``lang, at, n``: bucket counts of the sampled texts, at most ``per_class`` of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, text_col):
            found = list(counts(batch.column(text_col).to_pylist()))
            at = [np.flatnonzero(c) for c in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(lang_col), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([c[a].astype(np.int32) for c, a in zip(found, at)], pa.list_(pa.int32()))],
                ["lang", "at", "n"],
            )

    rows = teachers.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("__text"))
    row, h = ["__id", "__lang", "__hash"], F.xxhash64("__id")
    # Rows are drawn, not ids; those with large hashes for the size of their language can't be among them and don't travel.
    reach = (F.lit(2.0 * per_class + 200) / F.count("*")).alias("reach")
    sizes = rows.groupBy("__lang").agg(reach)  # one row per language
    near = rows.join(F.broadcast(sizes), "__lang").where(h.cast("double") <= F.lit(-(2.0**63)) + F.least(F.lit(1.0), "reach") * F.lit(2.0**64))
    draw = Window.partitionBy("__lang").orderBy(h, "__id", "__hash")
    drawn = near.select(*row).distinct().withColumn("k", F.row_number().over(draw)).where(F.col("k") <= per_class).select(*row)
    texts = rows.join(F.broadcast(drawn), row, "left_semi").dropDuplicates(row)  # per_class rows a language
    return texts.select(F.col("__lang").alias(lang_col), F.col("__text").alias(text_col)).mapInArrow(run, "lang string, at array<int>, n array<int>").toArrow()


def fit_weights(rows: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int, epochs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, a step size per weight. ``rows``: class, buckets, values."""
    width = 1 << BITS
    z, n = np.zeros((width + 1, n_classes)), np.zeros((width + 1, n_classes))  # the last row is the bias

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[at])) / alpha + l2))

    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            label, at, x = rows[i]
            at, x = np.append(at, width), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            squared = n[at] + g * g
            z[at] += g - (np.sqrt(squared) - np.sqrt(n[at])) / alpha * w
            n[at] = squared
    all_weights = weights(np.arange(width + 1))
    return all_weights[:-1], all_weights[-1]


def find_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS) -> Model | None:
    """None without a document to learn from."""
    teachers = docs.select(id_col, text_col, lang_col).where(may_teach(F.col(id_col)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    total, frequency = document_frequencies(teachers, text_col)
    sample = sampled_features(teachers, id_col, text_col, lang_col, per_class)
    languages = sorted(set(sample.column("lang").to_pylist()))
    if not languages:
        return None
    idf = np.log((1 + total) / (1 + frequency)) + 1
    rows = []
    for lang, at, n in zip(sample.column("lang").to_pylist(), sample.column("at"), sample.column("n")):
        at = at.values.to_numpy()
        rows.append((languages.index(lang), at, tf_idf(n.values.to_numpy(), idf[at])))
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))  # the same fit whatever the order of tasks
    kept = [r for i, r in enumerate(rows) if i % 5 == 4]
    weights, bias = fit_weights([r for i, r in enumerate(rows) if i % 5 != 4], len(languages))
    scores = np.array([x @ weights[at] + bias for _, at, x in kept])
    return Model(tuple(languages), idf, weights, bias, find_temperature(scores, np.array([r[0] for r in kept])))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, lang_pred, score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a weight per bucket and language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in in_steps(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.ones(len(texts))
            for i, count in enumerate(counts(texts) if known else ()):
                if has_letter(texts[i]):
                    p = known.probabilities(count)
                    langs[i], scores[i] = known.languages[int(p.argmax())], p.max()
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("held_out"), pa.array(langs), pa.array(scores)], [id_col, "held_out", "lang_pred", "score"])

    texts = docs.select(id_col, is_held_out(F.col(id_col)).alias("held_out"), text_col)
    return texts.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double")
