"""From a raw text table to a client, round and availability dataset on disk."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell import fixed_values as fv
from driftwell.operators.availability import attach_availability, lookup_availability, split_by_availability
from driftwell.operators.drift import drift_manifest, inject_concepts
from driftwell.operators.normalize import sample_content, sample_times
from driftwell.operators.personas import Persona, assign_clients, assign_persona, enrich_with_clients
from driftwell.operators.rounds import add_temporal_rounds
from driftwell.session import stored
from driftwell.sources.writers import export_client_rounds, write_table


@dataclass
class Prepared:
    full: DataFrame
    available: DataFrame
    unavailable: DataFrame
    clients: DataFrame
    availability: DataFrame
    manifest: DataFrame


def prepare(
    raw: DataFrame, key: str, clients: DataFrame, availability: DataFrame, num_rounds: int = fv.NUM_ROUNDS,
    personas: Sequence[Persona] = fv.PERSONAS, concepts: Sequence[dict] = fv.CODE_CONCEPTS, now: str | None = None,
    seed: int = fv.SEED, activity: DataFrame | None = None,
) -> Prepared:
    """Normalise, assign personas and clients, cut rounds, add concepts, attach availability.

    Only keys and short attributes go through the position, client and availability joins, and are stored; the
    texts join once at the end. ``activity``, the sparse ``client_id, round_id`` that ``availability`` was laid out
    from, spares the samples the join with all clients and rounds.
    """
    content = sample_content(raw, key)
    persona = assign_persona(content.select("sample_id", "text"), personas, seed=seed).select("sample_id", "persona")
    timed = add_temporal_rounds(sample_times(raw, key, now), num_rounds)
    facts = assign_clients(timed.join(persona, "sample_id"), clients, [p[0] for p in personas], seed=seed)
    facts = enrich_with_clients(facts, clients)
    facts = attach_availability(facts, availability) if activity is None else lookup_availability(facts, activity, num_rounds)
    full = inject_concepts(content.join(stored(facts, "facts"), "sample_id"), num_rounds, concepts)
    full = full.withColumnRenamed("ts", "timestamp")
    yes, no = split_by_availability(full)
    return Prepared(full, yes, no, clients, availability, drift_manifest(full))


def write_prepared(p: Prepared, out: str, fmt: str = "parquet", export: bool = True) -> None:
    """The tables of the prepare step. The full dataset is written first, by round, and all
    that depends on it reads it back, so the joins run once."""
    spark = p.full.sparkSession
    meta = f"{out}/metadata"
    # By ranges of the position, and so of round and time: a round is written by one task or a few, not by all. The
    # positions say where the ranges end, so the texts are not read for it.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (p.full.agg(F.max("row_idx")).first()[0] or 0) + 1
    dealt = p.full.repartitionById(tasks, F.floor(F.col("row_idx") * F.lit(tasks) / F.lit(rows)).cast("int"))
    write_table(dealt, f"{meta}/full_client_dataset", "parquet", ["round_id"])
    full = spark.read.parquet(f"{meta}/full_client_dataset")
    yes, no = split_by_availability(full)
    write_table(p.clients, f"{meta}/client_metadata", fmt)
    write_table(p.availability, f"{meta}/availability_matrix", fmt)
    write_table(drift_manifest(full), f"{meta}/semantic_drift_manifest", fmt)
    write_table(yes, f"{meta}/available_train_dataset", fmt)
    write_table(no, f"{meta}/unavailable_train_dataset", fmt)
    if export:
        export_client_rounds(yes, f"{out}/rounds")


def read_prepared(spark, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/metadata/full_client_dataset").withColumn("round_id", F.col("round_id").cast("int"))
