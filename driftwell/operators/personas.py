"""Persona of a text and client of a sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell import fixed_values as fv
from driftwell.functions.text import key_hash
from driftwell.operators.rounds import global_positions

Persona = tuple[str, list[str], str, str]


def keyword_score(text: Column, keywords: Sequence[str]) -> Column:
    """How many distinct keywords occur in the text, in any case, also inside words."""
    low = F.lower(F.coalesce(text, F.lit("")))  # a missing text has no keyword
    hits = [F.contains(low, F.lit(k)).cast("int") for k in sorted({k.lower() for k in keywords})]
    return sum(hits[1:], hits[0]) if hits else F.lit(0)


def persona_scores(df: DataFrame, personas: Sequence[Persona] = fv.PERSONAS, text: str = "text") -> DataFrame:
    """Add ``score_<persona>`` for every persona: one projection over the text."""
    return df.withColumns({f"score_{p[0]}": keyword_score(F.col(text), p[1]) for p in personas})


def assign_persona(
    df: DataFrame, personas: Sequence[Persona] = fv.PERSONAS, text: str = "text", key: str = "sample_id",
    seed: int = fv.SEED,
) -> DataFrame:
    """Add ``persona``: the best score, ties (also at zero) drawn by a hash of the key."""
    names = [p[0] for p in personas]
    best = F.greatest(*[F.col(f"score_{n}") for n in names]) if len(names) > 1 else F.col(f"score_{names[0]}")
    tied = F.array_compact(F.array(*[F.when(F.col(f"score_{n}") == F.col("_best"), F.lit(n)) for n in names]))
    scored = persona_scores(df, personas, text).withColumn("_best", best).withColumn("_tied", tied)
    pick = (key_hash(F.col(key), seed, "persona") % F.size("_tied") + 1).cast("int")
    return scored.withColumn("persona", F.element_at("_tied", pick)).drop(
        "_best", "_tied", *[f"score_{n}" for n in names]
    )


def client_dimension(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """``client_id, persona, region, timezone_group`` from a customer table."""
    zones = F.create_map(*[F.lit(x) for kv in fv.REGION_TIMEZONES.items() for x in kv])
    where = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    return customer.join(where, customer.c_nationkey == where.n_nationkey).select(
        F.col("c_custkey").alias("client_id"),
        F.col("c_mktsegment").alias("persona"),
        F.col("r_name").alias("region"),
        F.coalesce(zones[F.col("r_name")], F.lit(fv.OTHER_TIMEZONE)).alias("timezone_group"),
    )


def assign_clients(
    samples: DataFrame, clients: DataFrame, personas: Sequence[str], key: str = "sample_id", seed: int = fv.SEED
) -> DataFrame:
    """Add ``client_id``: one of the clients of the sample's persona, or any client if it has
    none, drawn by a hash of the key.

    Clients are numbered through in (persona, client_id) order, so a draw within a persona is
    an offset from the persona's first number and a single equi-join serves both cases.
    """
    numbered = global_positions(clients, ["persona", "client_id"], "client_no")
    # At most one row per persona of the dictionary, hence the broadcast.
    spans = (
        numbered.filter(F.col("persona").isin(list(personas)))
        .groupBy("persona")
        .agg(F.min("client_no").alias("_first"), F.count(F.lit(1)).alias("_n"))
    )
    total = numbered.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    draw = key_hash(F.col(key), seed, "client")
    picked = samples.join(F.broadcast(spans), "persona", "left").withColumn(
        "client_no", F.coalesce(F.col("_first") + draw % F.col("_n"), draw % F.lit(max(total, 1)))
    )
    return picked.join(numbered.select("client_no", "client_id"), "client_no", "left").drop(
        "client_no", "_first", "_n"
    )


def enrich_with_clients(samples: DataFrame, clients: DataFrame) -> DataFrame:
    """Left join of the client attributes; names already taken get the suffix ``_client``."""
    renamed = clients.select(
        "client_id",
        *[F.col(c).alias(f"{c}_client" if c in samples.columns else c) for c in clients.columns if c != "client_id"],
    )
    return samples.join(renamed, "client_id", "left")
