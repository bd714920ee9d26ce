"""Choosing clients per round."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell import fixed_values as fv
from driftwell.functions.text import key_hash
from driftwell.operators.rounds import global_positions
from driftwell.session import work_path


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group with their 1-based ``rank``. Every map task passes on at most
    ``k`` rows of a group, so a large group costs no large task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def candidates(stream: DataFrame) -> DataFrame:
    """Distinct available clients with data in the round."""
    return stream.filter(F.col("available") == 1).select("round_id", "client_id").distinct()


def sample_uniform(pool: DataFrame, k: int = fv.CLIENTS_PER_ROUND, seed: int = fv.SEED) -> DataFrame:
    """``k`` clients per round without replacement (all if fewer), repeatable by hash."""
    order = [key_hash(F.col("client_id"), F.col("round_id"), seed), F.col("client_id")]
    return top_k(pool.select("round_id", "client_id"), ["round_id"], order, k)


def sample_from_all(clients: DataFrame, num_rounds: int, k: int = fv.CLIENTS_PER_ROUND, seed: int = fv.SEED, first: int = 0) -> DataFrame:
    """The same over all clients, available or not, for every round from ``first`` on."""
    numbered = global_positions(clients.select("client_id"), ["client_id"], "client_no")
    total = numbered.count()
    take = min(k, total)

    def draw(chosen: Column, i: Column) -> Column:
        """Add to the chosen numbers one below ``total - take + i + 1``, the largest if the draw
        is taken already; so every set of ``take`` numbers is equally likely."""
        last = F.lit(total - take) + i
        number = key_hash(F.col("round_id"), seed, i) % (last + 1)
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, number), last).otherwise(number)))

    steps = F.sequence(F.lit(0), F.lit(take - 1)).cast("array<bigint>") if take else F.array().cast("array<bigint>")
    rounds = clients.sparkSession.range(first, max(first, num_rounds)).select(F.col("id").cast("int").alias("round_id"))
    drawn = rounds.select("round_id", F.posexplode(F.aggregate(steps, F.array().cast("array<bigint>"), draw)).alias("rank", "client_no"))
    # A few rows per round, so the clients are numbered once and never laid out by round.
    return drawn.join(numbered, "client_no").select("round_id", "client_id", (F.col("rank") + 1).alias("rank"))


def client_features(stream: DataFrame) -> DataFrame:
    """Per round and available client: availability probability, modal persona (ties: smallest)
    and mean text length."""
    per_persona = (
        stream.filter(F.col("available") == 1)
        .groupBy("round_id", "client_id", "persona")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(F.char_length("text")).alias("_chars"),
            F.max("availability_probability").alias("_p"),
        )
    )
    return per_persona.groupBy("round_id", "client_id").agg(
        F.coalesce(F.max("_p"), F.lit(fv.UNKNOWN_PROBABILITY)).alias("probability"),
        F.min(F.when(F.col("persona").isNotNull(), F.struct((-F.col("_n")).alias("n"), "persona")))["persona"].alias("persona"),
        (F.sum("_chars") / F.sum("_n")).alias("mean_chars"),
    )


def fixed_score(probability: Column, mean_chars: Column) -> Column:
    """The part of the score that no selection changes."""
    w = fv.SCORE_WEIGHTS
    return F.lit(w["probability"]) * probability + F.lit(w["utility"]) * F.least(F.lit(1.0), mean_chars / F.lit(float(fv.UTILITY_CHARS)))


def changing_score(last_seen: int, persona_count: int) -> float:
    """The part that does."""
    w = fv.SCORE_WEIGHTS
    return w["fresh"] / (1 + last_seen) + w["under"] / (1 + persona_count) - (w["repeat"] if persona_count > 0 else 0.0)


def selection_score(probability: Column, last_seen: Column, persona_count: Column, mean_chars: Column) -> Column:
    w = fv.SCORE_WEIGHTS
    return (
        F.lit(w["probability"]) * probability
        + F.lit(w["fresh"]) / (F.lit(1) + last_seen)
        + F.lit(w["under"]) / (F.lit(1) + persona_count)
        + F.lit(w["utility"]) * F.least(F.lit(1.0), mean_chars / F.lit(float(fv.UTILITY_CHARS)))
        - F.when(persona_count > 0, F.lit(w["repeat"])).otherwise(F.lit(0.0))
    )


def select_by_score(features: DataFrame, k: int = fv.CLIENTS_PER_ROUND) -> DataFrame:
    """Best ``k`` clients per round. ``features`` carries the history columns ``last_seen`` and
    ``persona_count``; missing ones count as 0."""
    scored = features.withColumn(
        "score",
        selection_score(
            F.col("probability"), F.coalesce("last_seen", F.lit(0)), F.coalesce("persona_count", F.lit(0)),
            F.col("mean_chars"),
        ),
    )
    # Scores equal up to rounding noise are ties, decided by the client id.
    return top_k(scored, ["round_id"], [F.desc(F.round("score", 12)), F.col("client_id")], k)


def with_history(rows: DataFrame, log: DataFrame, num_rounds: int) -> DataFrame:
    """Add, as of before each row's round, ``persona_count`` (selections of its persona) and
    ``last_seen`` (rounds with a selection since its client was selected, that one included;
    all of them if it never was).

    ``log`` holds ``round_id, client_id, persona`` with a null persona for a selected client
    that had no data: its round counts, the client does not.
    """
    rounds_before = (
        log.select("round_id").distinct()
        .select(F.explode(F.sequence(F.col("round_id") + 1, F.lit(num_rounds))).alias("round_id"))
        .groupBy("round_id").agg(F.count(F.lit(1)).cast("int").alias("_before"))
    )
    with_data = log.filter(F.col("persona").isNotNull()).join(rounds_before, "round_id", "left")
    # Last selection before the row: one ordered pass per client over at most two rows a round.
    past = Window.partitionBy("client_id").orderBy("round_id", "_is_row").rowsBetween(Window.unboundedPreceding, -1)
    ask = rows.select("client_id", "round_id").distinct()
    last = (
        ask.select("client_id", "round_id", F.lit(0).alias("_is_row"), F.lit(None).cast("int").alias("_at"), F.lit(True).alias("_ask"))
        .unionByName(
            with_data.select(
                "client_id", "round_id", F.lit(1).alias("_is_row"), F.coalesce("_before", F.lit(0)).alias("_at"),
                F.lit(False).alias("_ask"),
            )
        )
        .withColumn("_last", F.max("_at").over(past))
        .filter("_ask")
        .select("client_id", "round_id", "_last")
    )
    per_persona = as_of_sum(
        rows.select("persona", "round_id").distinct(),
        with_data.groupBy("persona", (F.col("round_id") + 1).alias("round_id")).agg(F.count(F.lit(1)).alias("_v")),
        ["persona"], "_v", "persona_count",
    )
    return (
        rows.join(last, ["client_id", "round_id"], "left")
        .join(rounds_before, "round_id", "left")
        .join(per_persona, ["persona", "round_id"], "left")
        .withColumn("last_seen", (F.coalesce("_before", F.lit(0)) - F.coalesce("_last", F.lit(0))).cast("bigint"))
        .withColumn("persona_count", F.coalesce("persona_count", F.lit(0)).cast("bigint"))
        .drop("_last", "_before")
    )


def as_of_sum(
    asked: DataFrame, increments: DataFrame, keys: Sequence[str], value: str, name: str, order: str = "round_id"
) -> DataFrame:
    """For every distinct (keys, order) in ``asked`` the sum of the increments with the same
    keys up to and including that order value."""
    return as_of_sums(asked, increments.withColumnRenamed(value, name), keys, [name], order)


def as_of_sums(
    asked: DataFrame, increments: DataFrame, keys: Sequence[str], values: Sequence[str], order: str = "round_id"
) -> DataFrame:
    """The same for several value columns at once. One shuffle on the keys and no join; a key
    has at most two rows per order value."""
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cols = [*keys, order]
    nothing = [F.lit(None).cast("double").alias(v) for v in values]
    both = asked.select(*cols, *nothing, F.lit(True).alias("_ask")).unionByName(
        increments.select(*cols, *[F.col(v).cast("double").alias(v) for v in values], F.lit(False).alias("_ask"))
    )
    return both.withColumns({v: F.sum(v).over(w) for v in values}).filter("_ask").select(*cols, *values)


#: Tasks that write and read the features of one round; raise it for rounds of very many clients.
FEATURE_PARTS = 16
#: Rounds whose possible choices one job looks for.
ROUNDS_PER_JOB = 40
#: Scores are compared as integers of this unit, so equal ones are ties whatever the order of sums.
UNIT = 1e-12


def select_sequentially(
    spark: SparkSession, features: DataFrame, num_rounds: int, k: int = fv.CLIENTS_PER_ROUND, rounds_per_job: int = ROUNDS_PER_JOB,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Round after round, each using what earlier rounds selected: ``round_id, client_id,
    persona, rank``. Rows without a client are left out. ``earlier`` is the result for the rounds
    before those of ``features``, whose features are then not needed any more.

    Clients that were never selected differ only in the part of the score that no selection changes,
    so of each round and persona the best ``k * (b + 1)`` of them by that part suffice for a job of b
    rounds, as at most ``k * b`` are selected meanwhile. One job finds these clients and brings their
    rows and those of earlier selected clients; the rounds then need no further job. What comes to the
    driver is bounded by ``k``, the rounds of a job and the personas, whatever the number of clients:
    at most ``b * personas * k * (b + 1) + k * num_rounds`` clients a round.
    """
    path = work_path(spark, "features")
    fixed = F.round(fixed_score(F.col("probability"), F.col("mean_chars")) / F.lit(UNIT)).cast("bigint")
    kept = features.filter(F.col("client_id").isNotNull()).select(
        F.col("round_id").cast("int").alias("round_id"), "client_id", "persona", F.coalesce(fixed, F.lit(-(10**15))).alias("fixed")
    )
    kept.repartition("round_id", F.pmod(F.hash("client_id"), F.lit(FEATURE_PARTS))).write.partitionBy("round_id").parquet(path)
    rows = spark.read.schema(kept.schema).parquet(path)
    id_type = kept.schema["client_id"].dataType.simpleString()
    present = sorted({r[0] for r in rows.select("round_id").distinct().collect()} & set(range(num_rounds)))  # one row per round
    counts: dict[str, int] = {}
    seen: dict = {}  # client -> non-empty rounds before its last selection
    log: list[tuple] = []
    past = [] if earlier is None else sorted((r["round_id"], r["rank"], r["client_id"], r["persona"]) for r in earlier.collect())  # k a round
    done = sorted({r[0] for r in past})
    for r, _, client, persona in past:
        seen[client] = done.index(r)
        if persona is not None:
            counts[persona] = counts.get(persona, 0) + 1
    for at in range(0, len(present), rounds_per_job):
        block = present[at : at + rounds_per_job]
        here = rows.filter(F.col("round_id").between(block[0], block[-1]))
        known = spark.createDataFrame([(c,) for c in seen], f"client_id {id_type}")  # k a round at most
        new = top_k(here.join(F.broadcast(known), "client_id", "left_anti"), ["round_id", "persona"], [F.desc("fixed"), F.col("client_id")], k * (len(block) + 1))
        asked = new.select("client_id").distinct().union(known)
        found = here.join(asked, "client_id", "left_semi").select("round_id", "client_id", "persona", "fixed").toArrow()
        by_round: dict[int, list[tuple]] = {}
        for r, client, persona, units in zip(*(c.to_pylist() for c in found.columns)):
            by_round.setdefault(r, []).append((client, persona, units))
        for nonempty, r in enumerate(block, len(done) + at):
            order = sorted(
                (-units - round(changing_score(nonempty - seen.get(c, 0), counts.get(p, 0)) / UNIT), c, p) for c, p, units in by_round[r]
            )[:k]
            for rank, (_, client, persona) in enumerate(order, 1):
                log.append((r, client, persona, rank))
            for _, client, persona in order:
                if persona is not None:  # a client whose samples have no persona
                    counts[persona] = counts.get(persona, 0) + 1
                seen[client] = nonempty
    return spark.createDataFrame(log, f"round_id int, client_id {id_type}, persona string, rank int")


def selection_summary(log: DataFrame, methods: Sequence[str], num_rounds: int) -> DataFrame:
    """One row per method and round, empty rounds included: how many clients and which, in rank
    order. The list holds the at most k clients of a round."""
    per_round = log.groupBy("method", "round_id").agg(
        F.count(F.lit(1)).cast("int").alias("selected"),
        F.concat_ws(
            ";",
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "client_id"))), lambda s: s["client_id"].cast("string")
            ),
        ).alias("selected_clients"),
    )
    grid = all_rounds(log.sparkSession, methods, num_rounds)
    return grid.join(per_round, ["method", "round_id"], "left").select(
        "method", F.col("round_id").alias("round"),
        F.coalesce("selected", F.lit(0)).alias("selected"),
        F.coalesce("selected_clients", F.lit("")).alias("selected_clients"),
    )


def all_rounds(spark: SparkSession, methods: Sequence[str], num_rounds: int) -> DataFrame:
    names = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    return names.select("method", F.explode(F.sequence(F.lit(0), F.lit(num_rounds - 1))).alias("round_id"))


def round_metrics(summary: DataFrame, guidance: DataFrame | None = None) -> DataFrame:
    """The metric row of every method and round. ``guidance`` holds ``method, round,
    guidance_samples`` of the pooled methods."""
    pooled = F.col("method").isin(fv.POOLED_METHODS)
    out = summary.select("method", "round", "selected", F.col("selected").alias("selected_clients"))
    if guidance is None:
        out = out.withColumn("guidance_samples", F.lit(0))
    else:
        out = out.join(guidance, ["method", "round"], "left").withColumn(
            "guidance_samples", F.coalesce("guidance_samples", F.lit(0)).cast("int")
        )
    return out.withColumns(
        {
            "guidance_round": (F.col("guidance_samples") > 0).cast("int"),
            "training_mode": F.when(pooled, fv.POOLED_MODE).otherwise(fv.CLIENT_MODE),
            "knowledge_source": F.when(pooled, fv.POOLED_KNOWLEDGE).otherwise(fv.CLIENT_KNOWLEDGE),
        }
    )


def cumulative_contribution(log: DataFrame) -> DataFrame:
    return log.groupBy("client_id").agg(F.count(F.lit(1)).alias("selections"))


def representation_imbalance(contribution: DataFrame) -> DataFrame:
    n = F.col("selections")
    return contribution.agg(
        ((F.max(n) - F.min(n)) / (F.avg(n) + F.lit(1e-8))).alias("representation_imbalance")
    )
