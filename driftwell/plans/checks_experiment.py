"""Queries for the whole experiment: several methods, all rounds, every metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import bigram as bg, selection as sel
from driftwell.operators.drift import inject_concepts
from driftwell.plans import checks_scoring as cs, checks_selection as cl, checks_sources as src, datasets as ds, experiment as ex
from driftwell.plans.checks_scoring import rounded
from driftwell.plans.registry import ORACLES, query
from driftwell.session import durable, stored, work_path

METHODS = ["aws", "random", "oracle", "no_availability", "crosslm"]
# Guidance comes from topics of their own, none of the clients' texts.
SQL_PRIOR = f"(SELECT prior_id AS key, text, label, topic FROM ({ORACLES['a7_prior_corpus']}))"


def guidance_of(spark, sf):
    prior = src.prior_corpus(spark, sf).withColumnRenamed("prior_id", "key")
    return bg.guidance_batch(prior, "key", ds.EVENT_ROUNDS, ds.GUIDANCE_TEMPLATE)


def selected(spark, sf):
    """Stream with concepts, gathered by round and stored once, and the selections of its clients."""
    facts = durable(ds.stream_facts(spark, sf))
    docs = ds.documents(spark, sf).select("sample_id", F.lit("").alias("prompt"), "text", F.col("source").alias("label"))
    gathered = bg.texts_by_round(docs.join(facts, "sample_id"), "sample_id", ds.EVENT_ROUNDS, facts.count())
    stream = stored(inject_concepts(gathered, ds.EVENT_ROUNDS, ds.CONCEPTS), "stream")
    return stream, durable(ex.select_clients(stream, ds.clients(spark, sf), METHODS, ds.EVENT_ROUNDS))


def parts(spark, sf):
    """The same with the guidance and the model of every method."""
    stream, chosen = selected(spark, sf)
    guidance = guidance_of(spark, sf)
    prior = src.prior_corpus(spark, sf).withColumnRenamed("prior_id", "key")
    model = ex.learn(stream, chosen, bg.fit_guidance(prior, "key", ds.EVENT_ROUNDS, ds.GUIDANCE_TEMPLATE), METHODS)
    return stream, chosen, guidance, bg.RoundModel(stored(model.increments, "learned"), METHODS)


LEARNED = rf"""{cs.SQL_DRIFT_STREAM}, {cs.sql_guidance(SQL_PRIOR, ds.EVENT_ROUNDS)},
 {cl.SQL_FEATURES.replace("FROM stream", "FROM drifted")}, {cl.SQL_SEQUENTIAL}, {cl.SQL_FROM_ALL},
 offer AS (SELECT DISTINCT round_id, client_id FROM stream WHERE available = 1),
 chosen AS (SELECT 'aws' AS method, round_id, client_id, rank FROM sequential
   UNION ALL SELECT 'random', round_id, client_id, CAST(rank AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY {cl.DRAW}, client_id) AS rank FROM offer)
     WHERE rank <= 5
   UNION ALL SELECT m, round_id, client_id, CAST(rank AS INTEGER) FROM from_all, unnest(['oracle', 'no_availability']) t(m)),
 weights AS (SELECT c.method, c.round_id, c.client_id, count(*) AS weight FROM chosen c JOIN drifted d USING (round_id, client_id) GROUP BY ALL),
 totals AS (SELECT method, round_id, sum(weight) AS total FROM weights GROUP BY ALL),
 {cs.sql_transitions("tr", "drifted", "sample_id, round_id, client_id, persona, region")},
 {cs.sql_transitions("gtr", "guidance", "round_id")},
 local AS (SELECT round_id, client_id, prev, tok, count(*) AS value FROM tr GROUP BY ALL),
 inc AS (SELECT w.method, l.round_id, l.prev, l.tok, sum(l.value * w.weight / t.total) AS value
   FROM local l JOIN weights w USING (round_id, client_id) JOIN totals t USING (method, round_id) GROUP BY ALL
   UNION ALL SELECT 'crosslm', round_id, prev, tok, count(*) FROM gtr GROUP BY ALL)"""


@query("j16_selections", f"WITH {LEARNED} SELECT method, round_id, client_id, rank FROM chosen")
def selections(spark, sf):
    return selected(spark, sf)[1].select("method", "round_id", "client_id", "rank")


@query(
    "j16_imbalance",
    f"""WITH {LEARNED}, n AS (SELECT method, client_id, count(*) AS n FROM chosen GROUP BY ALL)
    SELECT method, round((max(n) - min(n)) / (avg(n) + 1e-8), 6) AS representation_imbalance FROM n GROUP BY 1""",
)
def imbalance(spark, sf):
    return rounded(ex.representation(selected(spark, sf)[1]), "representation_imbalance")


@query("h5_learned_increments", f"WITH {LEARNED} SELECT method, round_id, prev, tok, round(value, 6) AS value FROM inc")
def increments(spark, sf):
    return rounded(parts(spark, sf)[3].increments, "value").select("method", "round_id", "prev", "tok", "value")


# Everything a round's pairs need, from the increments of this and earlier rounds.
LOSS = f"""{LEARNED},
 room AS (SELECT sample_id, round_id, persona, label FROM drifted),
 space AS (SELECT round_id, label, row_number() OVER (PARTITION BY round_id ORDER BY label) AS ord FROM drifted GROUP BY round_id, label),
 {cs.SQL_SPLIT.replace("split AS", "msplit AS")}, {cs.SQL_SPLIT_TERM.replace("split AS", "tsplit AS")},
 {cs.sql_completion().replace("FROM split", "FROM msplit").replace("arrays", "marrays").replace("joined", "mjoined").replace("pairs AS", "mpairs AS")},
 {cs.sql_completion().replace("FROM split", "FROM tsplit").replace("arrays", "tarrays").replace("joined", "tjoined").replace("pairs AS", "tpairs AS")},
 asks AS (SELECT DISTINCT round_id, prev, tok FROM (
   SELECT round_id, prev, tok FROM tr UNION ALL SELECT round_id, prev, tok FROM mpairs UNION ALL SELECT round_id, prev, tok FROM tpairs
   UNION ALL SELECT round_id, 'answer:', unnest(['positive', 'neutral', 'negative']) FROM drifted
   UNION ALL SELECT round_id, 'sentiment:', label FROM space) WHERE prev IS NOT NULL),
 methods AS (SELECT unnest({METHODS}) AS method),
 ask AS (SELECT method, round_id, prev, tok FROM asks, methods),
 vw AS (SELECT a.method, a.round_id, a.prev, a.tok, sum(i.value) AS vw FROM ask a JOIN inc i
   ON i.method = a.method AND i.prev = a.prev AND i.tok = a.tok AND i.round_id <= a.round_id GROUP BY ALL),
 vinc AS (SELECT method, round_id, prev, sum(value) AS value FROM inc WHERE prev IS NOT NULL GROUP BY ALL),
 v AS (SELECT a.method, a.round_id, a.prev, sum(i.value) AS v FROM (SELECT DISTINCT method, round_id, prev FROM ask) a JOIN vinc i
   ON i.method = a.method AND i.prev = a.prev AND i.round_id <= a.round_id GROUP BY ALL),
 winc AS (SELECT method, round_id, tok, sum(value) AS value FROM inc GROUP BY ALL),
 w AS (SELECT a.method, a.round_id, a.tok, sum(i.value) AS w FROM (SELECT DISTINCT method, round_id, tok FROM ask) a JOIN winc i
   ON i.method = a.method AND i.tok = a.tok AND i.round_id <= a.round_id GROUP BY ALL),
 cells AS (SELECT method, CAST(r AS INTEGER) AS round_id FROM methods, range({ds.EVENT_ROUNDS}) t(r)),
 size AS (SELECT c.method, c.round_id, sum(i.value) AS total, count(DISTINCT i.tok) AS vocab FROM cells c LEFT JOIN winc i
   ON i.method = c.method AND i.round_id <= c.round_id GROUP BY ALL),
 loss AS (SELECT a.*, -ln(0.5 * CASE WHEN v.v > 0 THEN coalesce(vw.vw, 0) / v.v ELSE 0 END
     + 0.5 * (coalesce(w.w, 0) + 1) / (coalesce(s.total, 0) + s.vocab + 1)) AS nll
   FROM ask a LEFT JOIN vw USING (method, round_id, prev, tok) LEFT JOIN v USING (method, round_id, prev)
   LEFT JOIN w USING (method, round_id, tok) LEFT JOIN size s USING (method, round_id))"""

PERSONA = f"""{LOSS},
 size_of AS (SELECT round_id, persona, region, count(*) AS num FROM drifted GROUP BY ALL),
 pl AS (SELECT l.method, t.round_id, t.persona, t.region, sum(l.nll) / count(*) AS nll FROM tr t JOIN loss l USING (round_id, prev, tok) GROUP BY ALL),
 options AS (SELECT r.sample_id, r.round_id, r.persona, r.label AS gold, s.label AS option, s.ord, m.method, -l.nll AS score
   FROM room r JOIN space s ON s.round_id = r.round_id, methods m
   LEFT JOIN loss l ON l.method = m.method AND l.round_id = r.round_id AND l.prev = 'sentiment:' AND l.tok = s.label),
 preds AS (SELECT method, round_id, persona, sample_id, gold, first(option ORDER BY score DESC, ord) AS pred FROM options GROUP BY ALL),
 acc AS (SELECT method, round_id, persona, avg(CAST(pred = gold AS INTEGER)) AS accuracy FROM preds GROUP BY ALL),
 pp AS (SELECT m.method, z.round_id, z.persona, z.region, pl.nll, exp(least(pl.nll, 20)) AS perplexity, CAST(z.num AS INTEGER) AS num_eval_samples, acc.accuracy
   FROM size_of z CROSS JOIN methods m LEFT JOIN pl ON pl.method = m.method AND pl.round_id = z.round_id AND pl.persona = z.persona AND pl.region = z.region
   LEFT JOIN acc ON acc.method = m.method AND acc.round_id = z.round_id AND acc.persona = z.persona)"""


@query(
    "j16_per_persona",
    f"""WITH {PERSONA} SELECT method, round_id, persona, region, round(nll, 6) AS nll, round(perplexity, 6) AS perplexity, num_eval_samples,
      round(accuracy, 6) AS accuracy FROM pp""",
)
def per_persona(spark, sf):
    stream, _, _, model = parts(spark, sf)
    return rounded(ex.persona_metrics(stream, ex.score(stream, model)), "nll", "perplexity", "accuracy")


ROUNDED = [
    "global_perplexity", "current_knowledge_nll", "current_knowledge_perplexity", "current_target_nll", "current_target_perplexity",
    "private_code_accuracy", "private_code_margin", "private_code_correct_nll", "worst_persona_perplexity", "adaptation_lag_mean",
    "fairness_index",
]
COMPARISON = f"""{PERSONA},
 {cs.SQL_EMERGING.replace("FROM samples", "FROM drifted")},
 fair AS (SELECT method, round_id, max(perplexity) AS worst, sum(num_eval_samples) AS num,
   power(sum(1 / (perplexity + 1e-8)), 2) / (count(perplexity) * sum(power(1 / (perplexity + 1e-8), 2))) AS jain,
   coalesce(sum(perplexity * num_eval_samples), 0) / greatest(sum(num_eval_samples), 1) AS ppl FROM pp GROUP BY ALL),
 ck AS (SELECT method, round_id, avg(nll) AS nll, count(DISTINCT sample_id) AS samples, count(*) AS toks FROM mpairs JOIN loss USING (round_id, prev, tok) GROUP BY ALL),
 ct AS (SELECT method, round_id, avg(nll) AS nll, count(DISTINCT sample_id) AS samples, count(*) AS toks FROM tpairs JOIN loss USING (round_id, prev, tok) GROUP BY ALL),
 choice AS (SELECT d.sample_id, d.round_id, l.method, d.drift_answer AS gold, l.tok AS option, l.nll,
   CASE l.tok WHEN 'positive' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS ord
   FROM drifted d JOIN loss l ON l.round_id = d.round_id AND l.prev = 'answer:' AND l.tok IN ('positive', 'neutral', 'negative') WHERE d.drift_private_code <> ''),
 guess AS (SELECT sample_id, round_id, method, gold, first(option ORDER BY nll, ord) AS pred, max(nll) FILTER (WHERE option = gold) AS g,
   min(nll) FILTER (WHERE option <> gold) AS d FROM choice GROUP BY ALL),
 pc AS (SELECT method, round_id, avg(CAST(pred = gold AS INTEGER)) AS acc, avg(d - g) AS margin, avg(g) AS gold_nll, count(*) AS n FROM guess GROUP BY ALL),
 {cs.SQL_MATCHED.format("drifted")},
 text_loss AS (SELECT l.method, t.sample_id, sum(l.nll) AS total, count(*) AS n FROM tr t JOIN loss l USING (round_id, prev, tok) GROUP BY ALL),
 term_scores AS (SELECT x.method, m.round_id, m.term, exp(least(sum(x.total) / sum(x.n), 20)) AS perplexity FROM matched m JOIN text_loss x USING (sample_id) GROUP BY ALL),
 firsts AS (SELECT s.method, t.term, t.first_seen_round, s.perplexity * 0.9::DOUBLE AS thr FROM tracked t JOIN term_scores s ON s.term = t.term AND s.round_id = t.first_seen_round),
 hits AS (SELECT f.method, f.term, min(s.round_id) AS hit, min(s.round_id) - min(f.first_seen_round) AS lag FROM firsts f JOIN term_scores s
   ON s.method = f.method AND s.term = f.term AND s.round_id > f.first_seen_round AND s.perplexity <= f.thr GROUP BY ALL),
 picked AS (SELECT method, round_id, count(*) AS n FROM chosen GROUP BY ALL),
 told AS (SELECT round_id, count(*) AS n FROM guidance GROUP BY ALL),
 emerged AS (SELECT round_id, count(*) AS n FROM emerging GROUP BY 1),
 every AS (SELECT method, CAST(r AS INTEGER) AS round_id FROM methods, range({ds.EVENT_ROUNDS}) t(r)),
 comparison AS (SELECT e.method, e.round_id AS round, CASE e.method WHEN 'crosslm' THEN 'crosslm_teacher_student' ELSE 'federated' END AS method_family,
   CAST(coalesce(picked.n, 0) AS INTEGER) AS selected_clients, CAST(CASE e.method WHEN 'crosslm' THEN coalesce(told.n, 0) ELSE 0 END AS INTEGER) AS guidance_samples,
   CASE e.method WHEN 'crosslm' THEN 'stale_teacher_student_guidance' ELSE 'federated_client_update' END AS training_mode,
   CASE e.method WHEN 'crosslm' THEN 'static_stale_llm_prior' ELSE 'selected_up_to_date_client_streams' END AS knowledge_source,
   CAST(coalesce(fair.num, 0) AS BIGINT) AS num_eval_samples, coalesce(emerged.n, 0) AS emerging_terms_count, fair.ppl AS global_perplexity,
   ck.nll AS current_knowledge_nll, exp(least(ck.nll, CASE WHEN ck.nll IS NOT NULL THEN 20 END)) AS current_knowledge_perplexity,
   coalesce(ck.samples, 0) AS current_knowledge_samples, coalesce(ck.toks, 0) AS current_knowledge_tokens,
   ct.nll AS current_target_nll, exp(least(ct.nll, CASE WHEN ct.nll IS NOT NULL THEN 20 END)) AS current_target_perplexity,
   coalesce(ct.samples, 0) AS current_target_samples, coalesce(ct.toks, 0) AS current_target_tokens,
   pc.acc AS private_code_accuracy, pc.margin AS private_code_margin, pc.gold_nll AS private_code_correct_nll, coalesce(pc.n, 0) AS private_code_samples,
   fair.worst AS worst_persona_perplexity, fair.jain AS fairness_index,
   (SELECT avg(lag) FROM hits h WHERE h.method = e.method AND h.hit <= e.round_id) AS adaptation_lag_mean
   FROM every e LEFT JOIN picked USING (method, round_id) LEFT JOIN told USING (round_id) LEFT JOIN emerged USING (round_id)
   LEFT JOIN fair USING (method, round_id) LEFT JOIN ck USING (method, round_id) LEFT JOIN ct USING (method, round_id) LEFT JOIN pc USING (method, round_id))"""


@query(
    "j16_comparison",
    f"WITH {COMPARISON} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in ROUNDED)}) FROM comparison",
)
def comparison(spark, sf):
    stream, chosen, guidance, model = parts(spark, sf)
    told = ex.guidance_counts(guidance, ["crosslm"])
    metrics = sel.round_metrics(sel.selection_summary(chosen, METHODS, ds.EVENT_ROUNDS), told)
    scored = ex.score(stream, model)
    per_persona = durable(ex.persona_metrics(stream, scored))
    return rounded(ex.evaluate(stream, scored, per_persona, metrics)[2], *ROUNDED)


@query("j16_continued", f"WITH {COMPARISON} SELECT * REPLACE ({', '.join(f'round({c}, 3) AS {c}' for c in ROUNDED)}) FROM comparison")
def continued(spark, sf):
    """The same in two parts: the second half of the rounds goes on from the stored state of the first.
    Sums in another order differ in the last digits, so values of some ten thousands keep three places."""
    stream, _ = selected(spark, sf)
    prior = src.prior_corpus(spark, sf).withColumnRenamed("prior_id", "key")
    state, half = None, ds.EVENT_ROUNDS // 2
    for until in (half, ds.EVENT_ROUNDS):
        report, state = ex.run_rounds(stream, ds.clients(spark, sf), prior, "key", until, METHODS, template=ds.GUIDANCE_TEMPLATE, before=state)
        if until < ds.EVENT_ROUNDS:
            state = state.write(work_path(spark, "state"))
    return report.comparison.withColumns({c: F.round(c, 3) for c in ROUNDED})
