"""From a prepared dataset to selections, models, scores and reports.

The rounds of all methods are scored together: a model is keyed by method and round, so nothing
but the feedback of one selection method needs a loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell import fixed_values as fv
from driftwell.operators import bigram as bg
from driftwell.operators import metrics as mt
from driftwell.operators import scoring as sc
from driftwell.operators import selection as sel
from driftwell.operators import suppression as sp
from driftwell.operators import terms as tm
from driftwell.functions.text import is_blank
from driftwell.operators.availability import client_round_tuples
from driftwell.operators.drift import current_knowledge
from driftwell.operators.normalize import clean_labels
from driftwell.session import durable, stored
from driftwell.sources.writers import write_table

METHODS = ["aws", "random", "oracle", "no_availability", "crosslm"]


@dataclass
class Report:
    """Result tables, one row per method and round or finer."""

    per_persona: DataFrame
    fairness: DataFrame
    lags: DataFrame
    suppression: DataFrame
    comparison: DataFrame
    summary: DataFrame
    round_metrics: DataFrame
    selections: DataFrame


def select_clients(
    stream: DataFrame, clients: DataFrame, methods: Sequence[str], num_rounds: int, k: int = fv.CLIENTS_PER_ROUND,
    seed: int = fv.SEED, first: int = 0, earlier: DataFrame | None = None,
) -> DataFrame | None:
    """``method, round_id, client_id, persona, rank`` of every method that selects clients, for the rounds of ``stream``
    from ``first`` on; ``earlier`` is the result for those before. The persona matters to later selections by score only."""
    unknown = [m for m in methods if m not in fv.CLIENT_METHODS + fv.POOLED_METHODS]
    if unknown:
        raise ValueError(f"unknown methods {unknown}; known are {fv.CLIENT_METHODS + fv.POOLED_METHODS}")
    parts = []
    for m in methods:
        if m == "aws":
            past = None if earlier is None else earlier.filter(F.col("method") == m)
            log = sel.select_sequentially(stream.sparkSession, sel.client_features(stream), num_rounds, k, earlier=past)
        elif m == "random":
            log = sel.sample_uniform(sel.candidates(stream), k, seed)
        elif m in ("oracle", "no_availability"):
            log = sel.sample_from_all(clients, num_rounds, k, seed, first)
        else:
            continue
        persona = F.col("persona") if m == "aws" else F.lit(None).cast("string")
        parts.append(log.select(F.lit(m).alias("method"), "round_id", "client_id", persona.alias("persona"), "rank"))
    return mt.stack(parts) if parts else None


def learn(
    stream: DataFrame, selections: DataFrame | None, taught: DataFrame | None, methods: Sequence[str],
    drift_times: int = 1, max_len: int | None = None,
) -> bg.RoundModel:
    """What each method learns per round: the weighted average of the counts of its selected
    clients, or ``taught``, the counts of its guidance texts."""
    keys = ["round_id", "client_id"]
    parts = []
    if selections is not None:
        # Clients of the chosen rounds only; their texts are read once however many methods chose them.
        # The chosen are at most k per method and round.
        chosen = stream.join(F.broadcast(selections.select(*keys).distinct()), keys, "left_semi")
        weights = selections.select("method", *keys).join(bg.sample_weights(chosen, keys, drift_times), keys)
        names = {m: f"_m{i}" for i, m in enumerate(m for m in methods if m not in fv.POOLED_METHODS)}
        shares = bg.client_shares(weights, ["round_id"], ["client_id"], names)
        wide = bg.fit_shared(stream, shares, ["round_id"], ["client_id"], list(names.values()), max_len, drift_times, few_clients=True)
        by_method = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("value")) for m, c in names.items()])
        learned = wide.select("round_id", "prev", "tok", F.inline(by_method).alias("method", "value"))
        parts.append(learned.filter(F.col("value").isNotNull()).select("method", "round_id", "prev", "tok", "value"))
    pooled = [m for m in methods if m in fv.POOLED_METHODS]
    if taught is not None and pooled:
        parts.append(taught.withColumn("method", F.explode(F.array(*[F.lit(m) for m in pooled]))))
    if not parts:
        raise ValueError("nothing to learn from: no selections and no guidance")
    return bg.RoundModel(mt.stack(parts), list(methods))


@dataclass
class Scored:
    """Losses shared by all metrics: of token pairs, and of whole texts."""

    model: bg.LossTable | bg.SpanModel
    texts: DataFrame
    labels: DataFrame


def score(
    stream: DataFrame, model: bg.RoundModel, max_len: int | None = None, window: int | None = None,
) -> Scored:
    """Score the texts where they lie, if what the models have learned is little; else gather the token pairs of every
    metric and look them up in the models once."""
    by = ["round_id"]
    said = stream.filter(~is_blank(F.col("text")))
    labels = durable(sc.label_space(clean_labels(stream), by))
    placed = model.placed(stream.select(*by))
    if placed is not None:
        return Scored(placed, durable(sc.sample_losses(sc.each_pair(said, [*by, "sample_id"], max_len=max_len), placed, by)), labels)
    texts = stored(sc.target_pairs(said, [*by, "sample_id"], max_len=max_len), "text-pairs")
    known = current_knowledge(stream)
    table = model.losses(
        [texts]
        + [
            sc.completion_pairs(sc.completion_window(split(known), window), by)
            for split in (sc.split_at_marker, sc.split_at_term)
        ]
        + [sc.choice_pairs(stream, by, window), sc.label_pairs(labels, by)]
    )
    return Scored(table, durable(sc.sample_losses(texts, table, by)), labels)


def persona_metrics(
    stream: DataFrame, scored: Scored, label_len: int | None = None,
) -> DataFrame:
    """Perplexity per persona and region with the persona's accuracy, for every round."""
    by = ["round_id"]
    loss = sc.loss_by_persona(stream, scored.model, by, losses=scored.texts)
    accuracy = sc.label_accuracy(stream, scored.model, by, label_len, space=scored.labels)
    return loss.join(accuracy, ["method", *by, "persona"], "left")


def evaluate(
    stream: DataFrame, scored: Scored, per_persona: DataFrame, round_metrics: DataFrame,
    window: int | None = None, before: State | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fairness, adaptation lags and the comparison table of the rounds of ``stream``; lags of
    terms that emerged earlier as well."""
    by, at, model = ["round_id"], ["method", "round_id"], scored.model
    fair = sc.fairness_summary(per_persona, at)
    # Two small tables that several results share.
    counts = tm.term_counts(stream)
    if before is not None:
        counts = counts.unionByName(before.terms.withColumn("round_id", F.lit(before.last)))
    emerging = tm.emerging_of_counts(counts)
    emerging = durable(emerging if before is None else emerging.filter(F.col("round_id") > before.last))
    tracked = asked = tm.tracked_terms(emerging)
    if before is not None:
        asked = tracked.unionByName(before.lags.filter(F.col("threshold_round").isNull()).select("term", "first_seen_round").distinct())
    scores = durable(sc.term_perplexity(stream, asked, model, by, losses=scored.texts, phrases=False))  # they were tokens
    lags = tm.adaptation_tracking(scores, tracked)
    lags = durable(lags if before is None else lags.unionByName(tm.continued_tracking(before.lags, scores)))
    grid = round_metrics.select(
        "method", F.col("round").alias("round_id"), "selected_clients", "guidance_samples", "knowledge_source", "training_mode"
    )
    family = F.when(F.col("method").isin(fv.POOLED_METHODS), fv.POOLED_FAMILY).otherwise(fv.CLIENT_FAMILY)
    joined = (
        grid.withColumn("method_family", family)
        .join(
            per_persona.groupBy(*at).agg(F.sum("num_eval_samples").cast("bigint").alias("num_eval_samples")), at, "left"
        )
        .join(emerging.groupBy(*by).agg(F.count(F.lit(1)).alias("emerging_terms_count")), by, "left")
        .join(mt.weighted_perplexity(per_persona, at), at, "left")
        .join(sc.drift_completion_loss(stream, model, by, window), at, "left")
        .join(sc.drift_target_loss(stream, model, by, window), at, "left")
        .join(sc.private_code_choice(stream, model, by, window), at, "left")
        .join(fair.select(*at, "worst_persona_perplexity", F.col("jain_fairness").alias("fairness_index")), at, "left")
        .join(mt.running_mean_lag(lags, grid), at, "left")
    )
    counts = [
        "num_eval_samples", "emerging_terms_count", "current_knowledge_samples", "current_knowledge_tokens",
        "current_target_samples", "current_target_tokens", "private_code_samples",
    ]
    comparison = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumnRenamed("round_id", "round")
    return fair.withColumnRenamed("round_id", "round"), lags, comparison


def suppression_report(presence: DataFrame, per_persona: DataFrame, min_absent_rounds: int = 2) -> DataFrame:
    """Effect of every spell without available clients on a persona's perplexity, from the
    :func:`~driftwell.operators.suppression.presence` of clients."""
    windows = sp.suppression_windows(presence, min_absent_rounds)
    effect = sp.suppression_effect(windows, per_persona, by=["method"])
    return effect.join(sp.modal_region(presence, weight="n"), "persona", "left")


def representation(selections: DataFrame) -> DataFrame:
    """Imbalance of the selections per client, for every method."""
    n = F.col("selections")
    per_client = selections.groupBy("method", "client_id").agg(F.count(F.lit(1)).alias("selections"))
    return per_client.groupBy("method").agg(
        ((F.max(n) - F.min(n)) / (F.avg(n) + F.lit(1e-8))).alias("representation_imbalance")
    )


@dataclass
class State:
    """What the rounds up to ``last`` leave to later ones. None of the tables holds texts: sums of what the
    methods learned (``method, prev, tok, value``) and of the terms (``term, n``); the log of selections,
    the lags, and the small tables by round that reports are made of."""

    last: int
    learned: DataFrame
    terms: DataFrame
    log: DataFrame
    lags: DataFrame
    presence: DataFrame
    per_persona: DataFrame
    fairness: DataFrame
    comparison: DataFrame
    metrics: DataFrame
    selections: DataFrame

    def write(self, folder: str) -> State:
        """Store all tables below ``folder``, a new one for each state, and read them from there."""
        for f in fields(self)[1:]:
            getattr(self, f.name).write.parquet(f"{folder}/{f.name}")
        spark = self.learned.sparkSession
        spark.createDataFrame([(self.last,)], "last int").coalesce(1).write.parquet(f"{folder}/last")  # written last: the state is whole
        return State.read(spark, folder)

    @staticmethod
    def read(spark: SparkSession, folder: str) -> State:
        last = spark.read.parquet(f"{folder}/last").first()["last"]
        return State(last, *[spark.read.parquet(f"{folder}/{f.name}") for f in fields(State)[1:]])


def run(
    stream: DataFrame, clients: DataFrame, prior: DataFrame, prior_key: str, num_rounds: int = fv.NUM_ROUNDS,
    methods: Sequence[str] = METHODS, k: int = fv.CLIENTS_PER_ROUND, seed: int = fv.SEED, drift_times: int = 1,
    max_len: int | None = None, reference: str = "crosslm", template: str | None = None,
) -> Report:
    """The whole experiment over a prepared ``stream`` (best read back from a table by round).
    Methods that learn from guidance need the ``template`` that words it."""
    return run_rounds(stream, clients, prior, prior_key, num_rounds, methods, k, seed, drift_times, max_len, reference, template)[0]


def run_rounds(
    stream: DataFrame, clients: DataFrame, prior: DataFrame, prior_key: str, until: int = fv.NUM_ROUNDS,
    methods: Sequence[str] = METHODS, k: int = fv.CLIENTS_PER_ROUND, seed: int = fv.SEED, drift_times: int = 1,
    max_len: int | None = None, reference: str = "crosslm", template: str | None = None, before: State | None = None,
) -> tuple[Report, State]:
    """The rounds of ``stream`` after those of ``before``, up to but without ``until``: the report over
    all rounds so far, and the state for the next ones, to be stored with :meth:`State.write`.

    Only the new rounds' samples are read, so a round may be added when its data are there. Doing the
    rounds in parts or at once gives the same tables.
    """
    spark, first = stream.sparkSession, 0 if before is None else before.last + 1
    stream = stream.filter(F.col("round_id").between(first, until - 1))
    chosen = select_clients(stream, clients, methods, until, k, seed, first, None if before is None else before.log)
    chosen = durable(chosen) if chosen is not None else None
    pooled = [m for m in methods if m in fv.POOLED_METHODS]
    if pooled and template is None:
        raise ValueError(f"{pooled} need a template for guidance")
    guidance = bg.guidance_batch(prior, prior_key, until, template, seed=seed).filter(F.col("round_id") >= first) if pooled else None
    new_log = chosen if chosen is not None else spark.createDataFrame(
        [], "method string, round_id int, client_id string, persona string, rank int"
    )
    selections = sel.selection_summary(new_log, methods, until).filter(F.col("round") >= first)
    metrics = sel.round_metrics(selections, guidance_counts(guidance, pooled) if pooled else None)
    taught = bg.fit_guidance(prior, prior_key, until, template, max_len=max_len, first=first) if pooled else None
    learned = stored(learn(stream, chosen, taught, methods, drift_times, max_len).increments, "learned")
    if before is not None:
        learned = learned.unionByName(before.learned.withColumn("round_id", F.lit(before.last)))
    # The learned increments serve every metric below.
    scored = score(stream, bg.RoundModel(learned, list(methods)), max_len=max_len)
    per_persona = durable(persona_metrics(stream, scored))
    fairness, lags, comparison = evaluate(stream, scored, per_persona, metrics, before=before)
    terms, there = tm.term_counts(stream), sp.presence(client_round_tuples(stream))

    def so_far(new: DataFrame, name: str) -> DataFrame:
        return new if before is None else getattr(before, name).unionByName(new)

    state = State(
        until - 1, learned.groupBy("method", "prev", "tok").agg(F.sum("value").alias("value")),
        so_far(terms.select("term", "n"), "terms").groupBy("term").agg(F.sum("n").alias("n")),
        so_far(new_log, "log"), lags, durable(so_far(there, "presence")),
        so_far(per_persona.withColumnRenamed("round_id", "round"), "per_persona"), so_far(fairness, "fairness"),
        durable(so_far(comparison, "comparison")), so_far(metrics, "metrics"), so_far(selections, "selections"),
    )
    report = Report(
        state.per_persona, state.fairness.join(representation(state.log), "method", "left"), lags,
        suppression_report(state.presence, state.per_persona), state.comparison,
        mt.summarize_methods(state.comparison, reference=reference), state.metrics, state.selections,
    )
    return report, state


def guidance_counts(guidance: DataFrame, methods: Sequence[str]) -> DataFrame:
    per_round = guidance.groupBy(F.col("round_id").alias("round")).agg(F.count(F.lit(1)).alias("guidance_samples"))
    return per_round.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))


def write_report(report: Report, out: str, fmt: str = "csv") -> None:
    for name, df in {
        "per_persona_metrics": report.per_persona, "fairness_metrics": report.fairness,
        "semantic_adaptation_lag": report.lags, "semantic_suppression": report.suppression,
        "baseline_comparison": report.comparison, "current_knowledge_summary": report.summary,
        "round_metrics": report.round_metrics, "selected_clients": report.selections,
    }.items():
        write_table(df, f"{out}/{name}", fmt)
