"""Queries for client selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import selection as sel
from driftwell.plans import datasets as ds
from driftwell.plans.registry import query

DRAW = ds.sql_hash("client_id", "':'", "round_id", "':42'")
SQL_UNIFORM = f"""uniform AS (SELECT round_id, client_id, rank FROM (
   SELECT round_id, client_id, row_number() OVER (PARTITION BY round_id ORDER BY {DRAW}, client_id) AS rank FROM activity
   WHERE client_id IN (SELECT client_id FROM people)) WHERE rank <= 5)"""
def _sql_from_all(k: int = 5) -> str:
    """CTE ``from_all``: number i of a round is a draw below n - k + i + 1, or that bound less one if drawn before."""
    steps = ["draw0 AS (SELECT CAST(r AS INTEGER) AS round_id, (SELECT count(*) FROM people) AS n, []::BIGINT[] AS c FROM range(%d) t(r))" % ds.EVENT_ROUNDS]
    for i in range(k):
        draw = ds.sql_hash("round_id", "':42:'", str(i)) + f" % (n - {k} + {i} + 1)"
        steps.append(
            f"draw{i + 1} AS (SELECT round_id, n, list_append(c, CASE WHEN list_contains(c, d) THEN n - {k} + {i} ELSE d END) AS c "
            f"FROM (SELECT *, {draw} AS d FROM draw{i}))"
        )
    return (
        ", ".join(steps)
        + ", numbered_people AS (SELECT client_id, row_number() OVER (ORDER BY client_id) - 1 AS client_no FROM people)"
        + f", from_all AS (SELECT round_id, client_id, i AS rank FROM draw{k}, range(1, {k + 1}) t(i) JOIN numbered_people ON client_no = c[i])"
    )


SQL_FROM_ALL = _sql_from_all()
# Every fourth selection is of a client without data.
SQL_LOG = f"""{ds.SQL_ACTIVE}, {ds.SQL_ACTIVITY}, {SQL_UNIFORM},
 log AS (SELECT u.round_id, u.client_id, CASE WHEN (u.round_id + u.client_id) % 4 <> 0 THEN p.persona END AS persona, u.rank
   FROM uniform u JOIN people p USING (client_id))"""


def pool(spark, sf):
    return ds.activity(spark, sf).join(ds.clients(spark, sf).select("client_id"), "client_id", "left_semi")


def selection_log(spark, sf):
    """Uniform selections as history; some clients had no data."""
    persona = F.when((F.col("round_id") + F.col("client_id")) % 4 != 0, F.col("persona"))
    people = ds.clients(spark, sf).select("client_id", "persona")
    return (
        sel.sample_uniform(pool(spark, sf)).join(people, "client_id")
        .select("round_id", "client_id", persona.alias("persona"), "rank")
    )


@query("g1_candidates", f"WITH {ds.SQL_STREAM} SELECT DISTINCT round_id, client_id FROM stream WHERE available = 1")
def candidates(spark, sf):
    return sel.candidates(ds.stream_facts(spark, sf))


@query("g2_uniform", f"WITH {ds.SQL_ACTIVE}, {ds.SQL_ACTIVITY}, {SQL_UNIFORM} SELECT round_id, client_id, CAST(rank AS INTEGER) AS rank FROM uniform")
def uniform(spark, sf):
    return sel.sample_uniform(pool(spark, sf))


@query("g3_from_all", f"WITH {ds.SQL_ACTIVE}, {SQL_FROM_ALL} SELECT round_id, client_id, CAST(rank AS INTEGER) AS rank FROM from_all")
def from_all(spark, sf):
    return sel.sample_from_all(ds.clients(spark, sf), ds.EVENT_ROUNDS)


SQL_FEATURES = """features AS (
   SELECT round_id, client_id, coalesce(max(availability_probability), 0.5) AS probability, avg(length(text)) AS mean_chars,
     (SELECT persona FROM stream i WHERE i.round_id = o.round_id AND i.client_id = o.client_id
      GROUP BY persona ORDER BY count(*) DESC, persona LIMIT 1) AS persona
   FROM stream o WHERE available = 1 GROUP BY round_id, client_id)"""


@query(
    "g4_client_features",
    f"""WITH {ds.SQL_STREAM}, {SQL_FEATURES}
    SELECT round_id, client_id, round(probability, 6) AS probability, persona, round(mean_chars, 6) AS mean_chars FROM features""",
)
def features(spark, sf):
    out = sel.client_features(ds.stream(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("probability", "mean_chars")})


SQL_HISTORY = """(SELECT count(*) FROM log l WHERE l.round_id < q.round_id AND l.persona = q.persona) AS persona_count,
      (SELECT count(DISTINCT l.round_id) FROM log l WHERE l.round_id < q.round_id
        AND l.round_id >= coalesce((SELECT max(m.round_id) FROM log m
          WHERE m.client_id = q.client_id AND m.persona IS NOT NULL AND m.round_id < q.round_id), -1)) AS last_seen"""


@query(
    "g5_scored_selection",
    f"""WITH {ds.SQL_STREAM}, {SQL_FEATURES}, {SQL_UNIFORM},
    log AS (SELECT u.round_id, u.client_id, CASE WHEN (u.round_id + u.client_id) % 4 <> 0 THEN p.persona END AS persona, u.rank
      FROM uniform u JOIN people p USING (client_id)),
    past AS (SELECT q.*, {SQL_HISTORY} FROM features q),
    scored AS (SELECT *, 0.35::DOUBLE * probability + 0.2::DOUBLE / (1 + last_seen) + 0.2::DOUBLE / (1 + persona_count)
      + 0.25::DOUBLE * least(1.0::DOUBLE, mean_chars / 200) - CASE WHEN persona_count > 0 THEN 0.1::DOUBLE ELSE 0 END AS score FROM past),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY round(score, 12) DESC, client_id) AS rank FROM scored)
    SELECT round_id, client_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 2""",
)
def scored(spark, sf):
    rows = sel.with_history(sel.client_features(ds.stream(spark, sf)), selection_log(spark, sf), ds.EVENT_ROUNDS)
    return sel.select_by_score(rows, 2).select("round_id", "client_id", "rank", F.round("score", 6).alias("score"))


@query(
    "g6_history",
    f"""WITH {SQL_LOG}, q AS (SELECT a.round_id, a.client_id, p.persona FROM activity a JOIN people p USING (client_id))
    SELECT round_id, client_id, persona, {SQL_HISTORY} FROM q""",
)
def history(spark, sf):
    people = ds.clients(spark, sf).select("client_id", "persona")
    rows = ds.activity(spark, sf).join(people, "client_id")
    return sel.with_history(rows, selection_log(spark, sf), ds.EVENT_ROUNDS).select(
        "round_id", "client_id", "persona", "persona_count", "last_seen"
    )


# One row per round: the personas and clients selected so far, each with the number of rounds that selected anyone before.
SQL_SEQUENTIAL = f"""packed AS (SELECT round_id, list({{'c': client_id, 'p': persona, 'a': probability, 'm': mean_chars}}) AS fs FROM features GROUP BY 1),
 steps AS (WITH RECURSIVE st AS (
   SELECT -1 AS r, []::VARCHAR[] AS ps, []::STRUCT(c BIGINT, before INTEGER)[] AS seen, 0 AS nonempty, []::STRUCT(s DOUBLE, c BIGINT, p VARCHAR)[] AS top
   UNION ALL
   SELECT r, list_concat(ps, list_filter(list_transform(top, lambda x: x.p), lambda x: x IS NOT NULL)),
     list_concat(seen, list_transform(top, lambda x: {{'c': x.c, 'before': nonempty}})), nonempty + CAST(len(top) > 0 AS INTEGER), top
   FROM (SELECT st.r + 1 AS r, ps, seen, nonempty, list_sort(list_transform(coalesce(fs, []), lambda f: {{
       's': -round(0.35::DOUBLE * f.a + 0.2::DOUBLE / (1 + nonempty - coalesce(list_max(list_transform(list_filter(seen, lambda x: x.c = f.c), lambda x: x.before)), 0))
         + 0.2::DOUBLE / (1 + len(list_filter(ps, lambda x: x = f.p))) + 0.25::DOUBLE * least(1.0::DOUBLE, f.m / 200)
         - CASE WHEN len(list_filter(ps, lambda x: x = f.p)) > 0 THEN 0.1::DOUBLE ELSE 0 END, 12), 'c': f.c, 'p': f.p}}))[1:5] AS top
     FROM st LEFT JOIN packed ON packed.round_id = st.r + 1 WHERE st.r + 1 < {ds.EVENT_ROUNDS})) SELECT r, top FROM st),
 sequential AS (SELECT CAST(r AS INTEGER) AS round_id, top[i].c AS client_id, top[i].p AS persona, CAST(i AS INTEGER) AS rank
   FROM steps, unnest(range(1, len(top) + 1)) u(i))"""


@query("g7_sequential_selection", f"WITH {ds.SQL_STREAM}, {SQL_FEATURES}, {SQL_SEQUENTIAL} SELECT * FROM sequential")
def sequential(spark, sf):
    return sel.select_sequentially(spark, sel.client_features(ds.stream(spark, sf)), ds.EVENT_ROUNDS)


def two_logs(spark, sf):
    a = selection_log(spark, sf).select(F.lit("random").alias("method"), "round_id", "client_id", "rank")
    b = sel.sample_from_all(ds.clients(spark, sf), ds.EVENT_ROUNDS).select(
        F.lit("no_availability").alias("method"), "round_id", "client_id", "rank"
    )
    return a.unionByName(b)


SQL_SUMMARY = f"""{SQL_LOG}, {SQL_FROM_ALL},
 both_logs AS (SELECT 'random' AS method, round_id, client_id, rank FROM log
   UNION ALL SELECT 'no_availability', round_id, client_id, rank FROM from_all),
 sums AS (SELECT method, round_id, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(client_id AS VARCHAR), ';' ORDER BY rank) AS who
   FROM both_logs GROUP BY ALL),
 cells AS (SELECT m AS method, CAST(r AS INTEGER) AS round FROM unnest(['random', 'no_availability', 'crosslm']) t(m), range({ds.EVENT_ROUNDS}) s(r)),
 summary AS (SELECT c.method, c.round, coalesce(n, 0) AS selected, coalesce(who, '') AS selected_clients
   FROM cells c LEFT JOIN sums s ON s.method = c.method AND s.round_id = c.round)"""


def summary_of(spark, sf):
    return sel.selection_summary(two_logs(spark, sf), ["random", "no_availability", "crosslm"], ds.EVENT_ROUNDS)


@query("g8_selection_log", f"WITH {SQL_SUMMARY} SELECT * FROM summary")
def summary(spark, sf):
    return summary_of(spark, sf)


@query(
    "g8_round_metrics",
    f"""WITH {SQL_SUMMARY} SELECT method, round, selected, selected AS selected_clients, 0 AS guidance_samples, 0 AS guidance_round,
      CASE method WHEN 'crosslm' THEN 'stale_teacher_student_guidance' ELSE 'federated_client_update' END AS training_mode,
      CASE method WHEN 'crosslm' THEN 'static_stale_llm_prior' ELSE 'selected_up_to_date_client_streams' END AS knowledge_source
    FROM summary""",
)
def metrics(spark, sf):
    return sel.round_metrics(summary_of(spark, sf))


@query("g9_contribution", f"WITH {SQL_LOG} SELECT client_id, count(*) AS selections FROM log GROUP BY 1")
def contribution(spark, sf):
    return sel.cumulative_contribution(selection_log(spark, sf))


@query(
    "g10_imbalance",
    f"""WITH {SQL_LOG}, c AS (SELECT client_id, count(*) AS n FROM log GROUP BY 1)
    SELECT round((max(n) - min(n)) / (avg(n) + 1e-8), 9) AS representation_imbalance FROM c""",
)
def imbalance(spark, sf):
    out = sel.representation_imbalance(sel.cumulative_contribution(selection_log(spark, sf)))
    return out.select(F.round("representation_imbalance", 9).alias("representation_imbalance"))
