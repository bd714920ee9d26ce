"""From raw documents to token ids: toxic documents go, one of each group of near-duplicates stays,
repeated passages and benchmark leaks go, and what is left is encoded.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``.

Defined cases, in every stage: an empty table gives an empty one; other columns of ``docs`` than those of
``documents`` are dropped, whatever their names; a null text stays null until the substring stage, which makes it empty;
rows with a null id are kept unless their text is rejected. Rows that repeat an id are judged each by its
own text; what each stage does with rows that repeat id and text stands there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import decontaminate, simhash, substring_dedup, toxicity
from driftwell.llm.common import stored, table
from driftwell.llm.queries import op8_columns

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Repeated rows share their score and stay or go
    together; null and empty texts have the score of a text without words."""
    docs = docs.select(COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS[1:]).where("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of each group with the smallest id. Of rows that repeat id and text one stays; rows
    with a null id all stay. Texts without words, null ones too, are one group."""
    return simhash.keep_one(docs.select(COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that a smaller id holds; others stay as they are. Every row
    stays; rows of one id take nothing from each other, and those with a null id lose nothing."""
    docs = docs.select(COLUMNS)
    left = substring_dedup.remove_repeated(docs, keep=["lang", "source"], rejoin=False)
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Each row of a repeated id, or of a null one,
    goes by its own text, and rows with the same id and text together."""
    docs = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("row"))
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), id_col="row").select("row").distinct()
    return docs.join(leaks, "row", "left_anti").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens``, the ids, and digests of the ids and of what they decode to, of every row;
    a null text has no ids."""
    return op8_columns(docs, "ids")


STAGES = [
    ("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("substring_dedup", drop_repeated_passages),
    ("decontaminate", drop_leaks), ("byte_bpe", encode),
]
#: A trained classifier, XXH64 fingerprints and token ids are beyond SQL; the tests check each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
