"""Emerging concepts: catalog, injection into samples, and what is known about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell import fixed_values as fv
from driftwell.functions.text import is_blank, trim_all
from driftwell.operators.normalize import fill

CATALOG_SCHEMA = T.StructType(
    [T.StructField("concept_no", T.IntegerType()), T.StructField("first_round", T.IntegerType()),
     T.StructField("first_fraction", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("term", "snippet", "private_code", "answer", "label", "sector")]
)
_FIELDS = ("first_round", "term", "snippet", "private_code", "answer", "sector")
DRIFT_COLUMNS = {
    "drift_concept": "string", "drift_first_round": "int", "drift_private_code": "string",
    "drift_answer": "string", "drift_sector": "string",
}


def catalog(spark: SparkSession, concepts: Sequence[dict]) -> DataFrame:
    """A catalog table from Python records; a float ``first_round`` in [0, 1] is a fraction."""
    rows = []
    for i, c in enumerate(concepts):
        first = c.get("first_round", 0)
        is_fraction = isinstance(first, float) and 0 <= first <= 1
        rows.append(
            (i, None if is_fraction else int(first), float(first) if is_fraction else None)
            + tuple(c.get(n) for n in ("term", "snippet", "private_code", "answer", "label", "sector"))
        )
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def first_round(num_rounds: int) -> Column:
    """Round in which a concept starts: a fraction of the last round, half to even, or a round
    number clamped to the valid ones."""
    last = max(num_rounds - 1, 0)
    fraction = F.bround(F.col("first_fraction") * F.lit(float(last)), 0).cast("int")
    clamped = F.greatest(F.lit(0), F.least(F.coalesce(F.col("first_round"), F.lit(0)), F.lit(last)))
    return F.coalesce(fraction, clamped).cast("int")


def normalize_catalog(concepts: DataFrame, num_rounds: int) -> DataFrame:
    """Fill the defaults of a catalog and drop concepts without a term. ``concept_no`` keeps
    the catalog order."""
    filled = concepts.select(
        "concept_no",
        first_round(num_rounds).alias("first_round"),
        trim_all(F.coalesce("term", "private_code", F.lit(""))).alias("term"),
        F.col("snippet").alias("_snippet"),
        F.col("private_code").alias("_code"),
        F.lower(trim_all(F.coalesce("answer", "label", F.lit("")))).alias("answer"),
        trim_all(F.coalesce("sector", F.lit(""))).alias("sector"),
    ).filter(F.col("term") != "")
    default = fill(fv.DEFAULT_SNIPPET, term=F.col("term"), answer=F.col("answer"))
    return filled.select(
        "concept_no", "first_round", "term",
        trim_all(F.coalesce("_snippet", default)).alias("snippet"),
        trim_all(F.coalesce("_code", "term")).alias("private_code"),
        "answer", "sector",
    )


def empty_drift_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {n: F.lit("" if t == "string" else None).cast(t) for n, t in DRIFT_COLUMNS.items()}
    )


def inject_concepts(df: DataFrame, num_rounds: int, concepts: Sequence[dict]) -> DataFrame:
    """Append one active concept to every sample of a round that has any.

    The catalog is a short list handed in by the caller, so it travels as a literal: of the
    concepts that have started, row i takes number i modulo their count. No rows are added.
    """
    spark = df.sparkSession
    known = normalize_catalog(catalog(spark, concepts), num_rounds).orderBy("concept_no").collect() if concepts else []
    if not known:
        return empty_drift_columns(df)
    lits = F.array(*[
        F.struct(*[F.lit(k[f]).alias(f) for f in _FIELDS]) for k in known
    ])
    out = (
        df.withColumn("_active", F.filter(lits, lambda c: c["first_round"] <= F.col("round_id")))
        .withColumn(
            "_c",
            F.when(
                F.size("_active") > 0,
                F.element_at("_active", (F.col("row_idx") % F.greatest(F.size("_active"), F.lit(1)) + 1).cast("int")),
            ),
        )
    )
    has = F.col("_c").isNotNull()
    new = {
        "text": F.when(has, F.concat("text", F.lit("\n\n"), F.col("_c.snippet"))).otherwise(F.col("text")),
        "drift_concept": F.coalesce("_c.term", F.lit("")),
        "drift_first_round": F.col("_c.first_round"),
        "drift_private_code": F.coalesce("_c.private_code", F.lit("")),
        "drift_answer": F.coalesce("_c.answer", F.lit("")),
        "drift_sector": F.coalesce("_c.sector", F.lit("")),
    }
    if "prompt" in df.columns:
        line = F.concat("prompt", F.lit("\n\n"), fill(fv.PROMPT_CODE_LINE, code=F.col("_c.private_code")))
        new["prompt"] = F.when(has, line).otherwise(F.col("prompt"))
    return out.withColumns(new).drop("_active", "_c")


def current_knowledge(df: DataFrame, concept: str = "drift_concept") -> DataFrame:
    """The samples that carry a concept."""
    return df.filter(~is_blank(F.col(concept)))


def drift_manifest(df: DataFrame) -> DataFrame:
    return current_knowledge(df).select("drift_concept", "drift_first_round").distinct()
