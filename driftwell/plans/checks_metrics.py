"""Queries for terms, histories and suppression."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.functions.missing import jain_index
from driftwell.operators import metrics as mt, rounds as rd, scoring as sc, suppression as sp, terms as tm
from driftwell.plans import checks_scoring as cs, datasets as ds
from driftwell.plans.checks_scoring import rounded
from driftwell.plans.datasets import table
from driftwell.plans.registry import query
from driftwell.session import durable


def fine(df, *cols):
    """Results over two-decimal values: rounding at the sixth place would meet exact ties."""
    return df.withColumns({c: F.round(c, 9) for c in cols})


def docs_by_round(spark, sf):
    """Documents with their round, found in place: positions are not needed here."""
    docs = ds.documents(spark, sf).select("sample_id", "text")
    keys = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    return rd.assign_rounds_by_edges(docs, ds.fv.NUM_ROUNDS, ["sample_id"], keys)


@query("j1_frequent_terms", f"WITH {ds.SQL_SAMPLES}, {cs.SQL_EMERGING} SELECT * FROM freq WHERE n >= 3")
def frequent_terms(spark, sf):
    return tm.frequent_terms(docs_by_round(spark, sf))


@query("j2_emerging_terms", f"WITH {ds.SQL_SAMPLES}, {cs.SQL_EMERGING} SELECT * FROM emerging")
def emerging_terms(spark, sf):
    return tm.emerging_terms(docs_by_round(spark, sf))


TERMS = ["that", "tion", "LE", "über", "unseen-term"]


@query(
    "j3_term_coverage",
    "WITH t AS (SELECT unnest(['that', 'tion', 'LE', 'über', 'unseen-term']) AS term), "
    "f AS (SELECT term, 1 + (SELECT sum((length(lower(text)) - length(replace(lower(text), lower(term), ''))) // length(term)) FROM documents) AS f FROM t) "
    "SELECT term, round(ln(1 + 1.0 / f) + 1, 9) AS score FROM f",
)
def term_coverage(spark, sf):
    out = tm.term_coverage(table(spark, sf, "documents").select("text"), TERMS)
    return out.withColumn("score", F.round("score", 9))


SQL_HISTORY = """history AS (SELECT event_type AS method, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS round,
   user_id AS persona, CASE WHEN value > 5 THEN value END AS perplexity, CAST(json_extract(props, '$.k') AS INTEGER) AS n FROM events)"""


def history(spark, sf):
    """Events read as metric records: type as method, day as round, small values missing."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("method"), F.date_diff("ts", F.lit("2024-01-01").cast("date")).alias("round"),
        F.col("user_id").alias("persona"), F.when(F.col("value") > 5, F.col("value")).alias("perplexity"),
        F.get_json_object("props", "$.k").cast("int").alias("n"),
    )


@query(
    "j4_adaptation_lag",
    f"""WITH {SQL_HISTORY} SELECT CAST(min(round) FILTER (WHERE method = 'purchase' AND perplexity <= 5.5 AND round >= 3)
      - min(round) AS INTEGER) AS adaptation_lag FROM history""",
)
def adaptation_lag(spark, sf):
    h = history(spark, sf)
    late = F.when(F.col("round") >= 3, F.col("perplexity"))
    return mt.adaptation_lag(h.select("round", F.col("method").alias("term"), late.alias("score")), "purchase", 5.5)


SQL_LAGS = f"""{cs.SQL_TERM_SCORES},
 firsts AS (SELECT t.term, t.first_seen_round, s.perplexity AS s0, s.perplexity * 0.9::DOUBLE AS thr
   FROM tracked t JOIN term_scores s ON s.term = t.term AND s.round_id = t.first_seen_round),
 hits AS (SELECT f.term, min(s.round_id) AS hit FROM firsts f JOIN term_scores s
   ON s.term = f.term AND s.round_id > f.first_seen_round AND s.perplexity <= f.thr GROUP BY 1),
 lags AS (SELECT 'plain' AS method, f.term, f.first_seen_round, h.hit AS threshold_round, h.hit - f.first_seen_round AS adaptation_lag,
   round(f.s0, 6) AS first_term_perplexity, round(f.thr, 6) AS threshold_perplexity, round(s.perplexity, 6) AS observed_term_perplexity,
   coalesce(s.term_samples, 0) AS term_eval_samples, 'mixed' AS persona, 'GLOBAL' AS region
   FROM firsts f LEFT JOIN hits h USING (term) LEFT JOIN term_scores s ON s.term = f.term AND s.round_id = h.hit)"""


def lags_of(spark, sf):
    df = ds.samples_in_place(spark, sf)
    tracked = durable(cs.tracked_of(df))
    scores = cs.term_scores_of(spark, sf, df, tracked).withColumn("method", F.lit("plain"))
    return tm.adaptation_tracking(scores, tracked)


@query("j5_term_tracking", f"WITH {SQL_LAGS} SELECT * FROM lags")
def term_tracking(spark, sf):
    return rounded(lags_of(spark, sf), "first_term_perplexity", "threshold_perplexity", "observed_term_perplexity")


@query(
    "j6_fairness",
    f"""WITH {SQL_HISTORY} SELECT method, round, round(max(perplexity), 9) AS worst_persona_perplexity,
      round(var_samp(perplexity), 9) AS perplexity_variance,
      round(power(sum(1 / (perplexity + 1e-8)), 2) / (count(perplexity) * sum(power(1 / (perplexity + 1e-8), 2))), 9) AS jain_fairness
    FROM (SELECT method, CAST(round AS INTEGER) AS round, perplexity FROM history) GROUP BY ALL""",
)
def fairness(spark, sf):
    return fine(
        sc.fairness_summary(history(spark, sf), ["method", "round"]),
        "worst_persona_perplexity", "perplexity_variance", "jain_fairness",
    )


@query(
    "j7_jain_index",
    """SELECT user_id, round(power(sum(x), 2) / nullif(count(x) * sum(x * x), 0), 6) AS jain
    FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS x FROM events) GROUP BY 1""",
)
def jain(spark, sf):
    x = F.when(F.col("event_type") != "error", F.col("value")).otherwise(F.lit(float("nan")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(jain_index(x), 6).alias("jain"))


@query(
    "j8_weighted_perplexity",
    f"""WITH {SQL_HISTORY} SELECT method, CAST(round AS INTEGER) AS round,
      round(coalesce(sum(perplexity * n), 0) / greatest(sum(n), 1), 6) AS global_perplexity FROM history GROUP BY ALL""",
)
def weighted_perplexity(spark, sf):
    h = history(spark, sf).withColumnRenamed("n", "num_eval_samples")
    return rounded(mt.weighted_perplexity(h, ["method", "round"]), "global_perplexity")


# Runs of absence by the definition: starts where no absence precedes, ends before the next presence.
SQL_WINDOWS = f"""{ds.SQL_GRID},
 sums AS (SELECT client_id AS persona, round_id, sum(available) AS a FROM grid GROUP BY ALL),
 starts AS (SELECT s.persona, s.round_id AS window_start FROM sums s LEFT JOIN sums p ON p.persona = s.persona AND p.round_id = s.round_id - 1
   WHERE s.a = 0 AND coalesce(p.a, 1) > 0),
 windows AS (SELECT s.persona, s.window_start, min(e.round_id) - 1 AS window_end FROM starts s JOIN sums e
   ON e.persona = s.persona AND e.round_id > s.window_start AND e.a > 0 GROUP BY ALL HAVING min(e.round_id) - s.window_start >= 2)"""


def windows_of(spark, sf):
    known = ds.clients(spark, sf).select("client_id")
    active = ds.activity(spark, sf).join(known, "client_id", "left_semi")
    return sp.windows_between(active.select(F.col("client_id").alias("persona"), "round_id"))


@query("j9_suppression_windows", f"WITH {SQL_WINDOWS} SELECT * FROM windows")
def suppression_windows(spark, sf):
    return windows_of(spark, sf)


@query(
    "j10_suppression_effect",
    f"""WITH {SQL_WINDOWS}, h AS (SELECT user_id AS persona, event_type AS method,
      date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) // 6 AS round, CASE WHEN value > 5 THEN value END AS m FROM events),
    e AS (SELECT w.*, h.method, avg(m) FILTER (WHERE round < window_start) AS pre,
      avg(m) FILTER (WHERE round BETWEEN window_start AND window_end) AS during, avg(m) FILTER (WHERE round > window_end) AS post
      FROM windows w JOIN h ON h.persona = w.persona GROUP BY ALL)
    SELECT e.persona, e.method, window_start, window_end, round(pre, 9) AS pre_window_metric, round(during, 9) AS during_window_metric,
      round(post, 9) AS post_window_metric, CAST(min(h.round) - window_end AS INTEGER) AS recovery_rounds
    FROM e LEFT JOIN h ON h.persona = e.persona AND h.method = e.method AND h.round > window_end AND h.m <= pre
    GROUP BY e.persona, e.method, window_start, window_end, pre, during, post""",
)
def suppression_effect(spark, sf):
    from driftwell.operators.availability import event_round

    h = table(spark, sf, "events").select(
        F.col("user_id").alias("persona"), F.col("event_type").alias("method"),
        event_round(F.col("ts"), ds.START, ds.HOURS).alias("round"), F.when(F.col("value") > 5, F.col("value")).alias("perplexity"),
    )
    out = sp.suppression_effect(windows_of(spark, sf), h, by=["method"])
    return fine(out, "pre_window_metric", "during_window_metric", "post_window_metric")


@query(
    "j11_modal_region",
    f"""WITH {ds.SQL_CLIENTS} SELECT persona, (SELECT region FROM clients i WHERE i.persona = o.persona GROUP BY region
      ORDER BY count(*) DESC, region LIMIT 1) AS region FROM clients o GROUP BY persona""",
)
def modal_region(spark, sf):
    return sp.modal_region(ds.clients(spark, sf))


METRICS = ["global_perplexity", "private_code_accuracy"]
SQL_RESULTS = f"""{SQL_HISTORY}, results AS (SELECT method, CAST(round AS INTEGER) AS round, avg(perplexity) AS global_perplexity,
   CASE WHEN round % 3 <> 2 THEN avg(n) END AS private_code_accuracy FROM history GROUP BY method, round)"""


def results(spark, sf):
    """One row per method and round, with a metric that is missing in some rounds."""
    means = history(spark, sf).groupBy("method", "round").agg(F.avg("perplexity").alias("global_perplexity"), F.avg("n").alias("_n"))
    return means.withColumn("private_code_accuracy", F.when(F.col("round") % 3 != 2, F.col("_n"))).drop("_n")


def _sql_summary() -> str:
    cols, gains = [], []
    for m in METRICS:
        cols.append(
            f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std, stddev_samp({m}) / sqrt(count({m})) AS {m}_se, "
            f"last({m} ORDER BY round) FILTER (WHERE {m} IS NOT NULL) AS {m}_final"
        )
        sign = "s.{0} - r.{0}" if m in ds.fv.HIGHER_IS_BETTER else "r.{0} - s.{0}"
        gains += [f"round({sign.format(f'{m}_{x}')}, 9) AS {m}_{x}_improvement_vs_view" for x in ("mean", "final")]
    shown = [f"round(s.{m}_{x}, 9) AS {m}_{x}" for m in METRICS for x in ("mean", "std", "se", "final")]
    return (
        f"WITH {SQL_RESULTS}, s AS (SELECT method, CAST(count(DISTINCT round) AS INTEGER) AS num_rounds, {', '.join(cols)} FROM results GROUP BY 1) "
        f"SELECT s.method, s.num_rounds, {', '.join(shown + gains)} FROM s, (SELECT * FROM s WHERE method = 'view') r"
    )


@query("j12_method_summary", _sql_summary())
def method_summary(spark, sf):
    out = mt.summarize_methods(results(spark, sf), METRICS, "view")
    return fine(out, *[c for c in out.columns if c not in ("method", "num_rounds")])


@query(
    "j13_final_rows",
    f"""WITH {SQL_RESULTS}, r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY round DESC) AS rn FROM results WHERE private_code_accuracy IS NOT NULL)
    SELECT method, round, round(global_perplexity, 9) AS global_perplexity, round(private_code_accuracy, 9) AS private_code_accuracy FROM r WHERE rn = 1""",
)
def final_rows(spark, sf):
    return fine(mt.final_rows(results(spark, sf), "private_code_accuracy"), *METRICS)


@query(
    "j14_mean_by_round",
    f"""WITH {SQL_HISTORY} SELECT method, CAST(round AS INTEGER) AS round, round(avg(perplexity), 9) AS mean_perplexity FROM history
    WHERE perplexity IS NOT NULL GROUP BY ALL""",
)
def mean_by_round(spark, sf):
    return fine(mt.mean_by_round(history(spark, sf), "perplexity"), "mean_perplexity")


@query(
    "j15_mean_lag",
    f"WITH {SQL_LAGS} SELECT method, round(avg(adaptation_lag), 6) AS mean_adaptation_lag FROM lags GROUP BY 1",
)
def mean_lag(spark, sf):
    return rounded(mt.mean_lag_by_method(lags_of(spark, sf)), "mean_adaptation_lag")


@query(
    "j17_stacked",
    f"""WITH {SQL_HISTORY} SELECT method, CAST(round AS INTEGER) AS round, NULL::BIGINT AS persona, round(avg(perplexity), 9) AS perplexity FROM history GROUP BY ALL
    UNION ALL SELECT NULL, CAST(round AS INTEGER), persona, round(avg(perplexity), 9) FROM history GROUP BY ALL""",
)
def stacked(spark, sf):
    h = history(spark, sf)
    a = h.groupBy("method", "round").agg(F.avg("perplexity").alias("perplexity"))
    b = h.groupBy("round", "persona").agg(F.avg("perplexity").alias("perplexity"))
    empty = h.limit(0).select("method", "round")
    return fine(mt.stack([empty, a, b]), "perplexity").select("method", "round", "persona", "perplexity")


@query(
    "j18_running_mean_lag",
    f"""WITH {SQL_LAGS} SELECT 'plain' AS method, CAST(r AS INTEGER) AS round_id,
      (SELECT round(avg(adaptation_lag), 6) FROM lags WHERE threshold_round <= r) AS adaptation_lag_mean FROM range(50) t(r)""",
)
def running_mean_lag(spark, sf):
    from driftwell.operators.selection import all_rounds

    out = mt.running_mean_lag(lags_of(spark, sf), all_rounds(spark, ["plain"], ds.fv.NUM_ROUNDS))
    return rounded(out, "adaptation_lag_mean")
