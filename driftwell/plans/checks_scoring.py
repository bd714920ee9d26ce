"""Queries for the table-held language model and everything scored with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.functions.missing import perplexity
from driftwell.operators import bigram as bg, scoring as sc, terms as tm
from driftwell.operators.drift import current_knowledge, inject_concepts
from driftwell.plans import datasets as ds
from driftwell.plans.datasets import table
from driftwell.plans.registry import query
from driftwell.session import stored

TOKENS = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda x: x <> '')"


def sql_transitions(name: str, source: str, keys: str, text: str = "text") -> str:
    """CTE of (keys, prev, tok) over every token of every text of ``source``."""
    k = f"{keys}, " if keys else ""
    return f"""{name}_toks AS (SELECT {k}{TOKENS.format(text)} AS t FROM {source}),
 {name} AS (SELECT {k}CASE WHEN i > 1 THEN t[i - 1] END AS prev, t[i] AS tok FROM {name}_toks, unnest(range(1, len(t) + 1)) u(i))"""


def sql_model(source: str) -> str:
    return f"""{sql_transitions("fitted", source, "")},
 counts AS (SELECT prev, tok, CAST(count(*) AS DOUBLE) AS value FROM fitted GROUP BY ALL),
 big AS (SELECT prev, tok, value AS vw FROM counts WHERE prev IS NOT NULL),
 ctx AS (SELECT prev, sum(value) AS v FROM big JOIN counts USING (prev, tok) GROUP BY 1),
 word AS (SELECT tok, sum(value) AS w FROM counts GROUP BY 1),
 size AS (SELECT sum(w) AS total, count(*) AS vocab FROM word)"""


def sql_nll(name: str, pairs: str) -> str:
    return f"""{name} AS (SELECT p.*, -ln(0.5 * CASE WHEN c.v > 0 THEN coalesce(b.vw, 0) / c.v ELSE 0 END
     + 0.5 * (coalesce(w.w, 0) + 1) / (s.total + s.vocab + 1)) AS nll
   FROM {pairs} p LEFT JOIN big b ON b.prev = p.prev AND b.tok = p.tok LEFT JOIN ctx c ON c.prev = p.prev
   LEFT JOIN word w ON w.tok = p.tok, size s)"""


SQL_DRIFTED = f"{ds.SQL_SAMPLES}, {ds.sql_inject('samples', ds.CONCEPTS)}"
SQL_NEWS = f"{ds.SQL_SAMPLES}, {ds.sql_inject('samples', ds.fv.NEWS_CONCEPTS)}"


def plain_model(spark, sf):
    """Fitted on the documents as they are, before any concept is added."""
    return bg.TextModel(ds.documents(spark, sf))


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "h1_tokens",
    f"""SELECT doc_id AS sample_id, CAST(i - 1 AS INTEGER) AS pos, t[i] AS tok
    FROM (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents), unnest(range(1, len(t) + 1)) u(i)""",
)
def tokens(spark, sf):
    return bg.token_positions(ds.documents(spark, sf), ["sample_id"])


@query(
    "h1_truncated",
    f"""SELECT doc_id AS sample_id, CAST(len(t) AS INTEGER) AS tokens, md5(array_to_string(t, ' ')) AS digest
    FROM (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents)""",
)
def digest(spark, sf):
    """The truncation is off: every token counts."""
    df = bg.with_tokens(ds.documents(spark, sf))
    return df.select("sample_id", F.size("_toks").alias("tokens"), F.md5(F.concat_ws(" ", "_toks")).alias("digest"))


SQL_DRIFT_STREAM = f"{ds.SQL_STREAM}, {ds.sql_inject('stream', ds.CONCEPTS)}"


def drift_stream(spark, sf):
    return inject_concepts(ds.with_learned(ds.stream(spark, sf)), ds.EVENT_ROUNDS, ds.CONCEPTS)


SQL_COPIES = "copies AS (SELECT d.* FROM drifted d, unnest(range(CASE WHEN drift_concept <> '' THEN 8 ELSE 1 END)) t(c))"


@query(
    "h2_local_fit",
    f"""WITH {SQL_DRIFT_STREAM}, {SQL_COPIES}, {sql_transitions("tr", "copies", "round_id, client_id")}
    SELECT round_id, client_id, prev, tok, CAST(count(*) AS DOUBLE) AS value FROM tr GROUP BY ALL""",
)
def local_fit(spark, sf):
    return bg.fit(drift_stream(spark, sf), ["round_id", "client_id"], drift_times=8, few_texts=True)


@query(
    "h2_local_weights",
    f"""WITH {SQL_DRIFT_STREAM} SELECT round_id, client_id, CAST(sum(CASE WHEN drift_concept <> '' THEN 8 ELSE 1 END) AS DOUBLE) AS weight
    FROM drifted GROUP BY ALL""",
)
def local_weights(spark, sf):
    return bg.sample_weights(drift_stream(spark, sf), ["round_id", "client_id"], drift_times=8)


@query(
    "h3_dense_average",
    """WITH v AS (SELECT label, i - 1 AS param, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)),
    l AS (SELECT label, param, avg(x) AS value FROM v GROUP BY ALL), w AS (SELECT label, count(*) AS weight FROM embeddings GROUP BY 1)
    SELECT CAST(param AS INTEGER) AS param, round(sum(value * weight) / sum(weight), 6) AS value FROM l JOIN w USING (label) GROUP BY 1""",
)
def dense_average(spark, sf):
    vectors = table(spark, sf, "embeddings")
    values = vectors.select("label", F.posexplode("embedding").alias("param", "value"))
    locals_ = values.groupBy("label", "param").agg(F.avg(F.col("value").cast("double")).alias("value"))
    weights = vectors.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return rounded(bg.weighted_average(locals_, weights, [], ["label"], ["param"]), "value")


@query(
    "h3_round_average",
    f"""WITH {SQL_DRIFT_STREAM}, {sql_transitions("tr", "drifted", "round_id, client_id")},
    l AS (SELECT round_id, client_id, prev, tok, count(*) AS value FROM tr GROUP BY ALL),
    w AS (SELECT round_id, client_id, count(*) AS weight FROM drifted GROUP BY ALL),
    s AS (SELECT round_id, sum(weight) AS total FROM w GROUP BY 1)
    SELECT round_id, prev, tok, round(sum(value * weight / total), 6) AS value
    FROM l JOIN w USING (round_id, client_id) JOIN s USING (round_id) GROUP BY ALL""",
)
def round_average(spark, sf):
    """Texts get their client's share with the other facts, and are gathered by round before they are counted."""
    facts = stored(ds.sample_facts(spark, sf).select("sample_id", "row_idx", "round_id", "client_id"), "facts")
    weights = bg.sample_weights(facts, ["round_id", "client_id"]).withColumn("method", F.lit("all"))
    shares = bg.client_shares(weights, ["round_id"], ["client_id"], {"all": "value"})
    weighed = facts.join(shares, ["round_id", "client_id"]).drop("client_id")
    texts = ds.documents(spark, sf).select("sample_id", "text").join(weighed, "sample_id")
    gathered = bg.texts_by_round(texts, "sample_id", ds.EVENT_ROUNDS, facts.count())
    return rounded(bg.sum_shared(inject_concepts(gathered, ds.EVENT_ROUNDS, ds.CONCEPTS), ["round_id"], ["value"]), "value")


# Two of three parameters of the vectors are named as an adapter's; the labels 0 to 3 are clients.
SQL_NAMED = """named AS (SELECT vec_id, label, CASE WHEN i % 3 = 0 THEN 'base.' ELSE 'layer.lora_' END || i AS param, CAST(embedding[i] AS DOUBLE) AS x
   FROM embeddings, range(1, 65) t(i)),
 held AS (SELECT param, avg(x) AS value FROM named GROUP BY 1),
 local AS (SELECT label, param, avg(x) AS value FROM named WHERE label < 4 AND contains(param, 'lora') GROUP BY ALL),
 weight AS (SELECT label, count(*) AS w FROM embeddings WHERE label < 4 GROUP BY 1),
 mean AS (SELECT param, sum(value * w) / (SELECT sum(w) FROM weight) AS new FROM local JOIN weight USING (label) GROUP BY 1)"""


@query(
    "h3_adapter_update",
    f"""WITH {SQL_NAMED} SELECT 'four clients' AS locals, param, round(coalesce(new, value), 6) AS value FROM held LEFT JOIN mean USING (param)
    UNION ALL SELECT 'no client', param, round(value, 6) FROM held""",
)
def adapter_update(spark, sf):
    """Only adapter parameters are averaged, all others stay; without local models nothing changes."""
    vectors = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    name = F.concat(F.when((F.col("i") + 1) % 3 == 0, "base.").otherwise("layer.lora_"), F.col("i") + 1)
    named = vectors.select("label", name.alias("param"), F.col("x").cast("double").alias("x"))
    held = named.groupBy("param").agg(F.avg("x").alias("value"))
    out = []
    for what, clients in (("four clients", F.col("label") < 4), ("no client", F.lit(False))):
        local = bg.select_parameters(named.filter(clients).groupBy("label", "param").agg(F.avg("x").alias("value")))
        weights = table(spark, sf, "embeddings").filter(clients).groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
        mean = bg.weighted_average(local, weights, [], ["label"], ["param"])
        out.append(bg.updated_parameters(held, mean).select(F.lit(what).alias("locals"), "param", F.round("value", 6).alias("value")))
    return out[0].union(out[1])


def sql_guidance(source: str, rounds: int = 50, every: int = 5) -> str:
    """CTE ``guidance`` over rows of ``text, label, topic, key``; every round that gives guidance gets all of them."""
    return rf"""distinct_rows AS (SELECT text, label, topic, min(key) AS key FROM {source} GROUP BY ALL),
 guidance AS (SELECT CAST(r AS INTEGER) AS round_id, key, 'Reading note ' || r || ' on ' || topic || chr(10)
   || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || 'Tone: ' || label AS text, label FROM distinct_rows, range(0, {rounds}, {every}) t(r))"""


SQL_DOCUMENT_PRIOR = "(SELECT doc_id AS key, text, source AS label, lang AS topic FROM documents)"


def document_prior(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("key"), "text", F.col("source").alias("label"), F.col("lang").alias("topic"), F.col("doc_id").alias("client_id")
    )


def guidance_of(spark, sf, every=5):
    return bg.guidance_batch(document_prior(spark, sf), "key", 50, ds.GUIDANCE_TEMPLATE, every)


@query("h4_guidance_batch", f"WITH {sql_guidance(SQL_DOCUMENT_PRIOR)} SELECT * FROM guidance")
def guidance_batch(spark, sf):
    return guidance_of(spark, sf)


@query(
    "h5_pooled_fit",
    f"""WITH {sql_guidance(SQL_DOCUMENT_PRIOR, every=25)}, {sql_transitions("tr", "guidance", "round_id")}
    SELECT round_id, prev, tok, CAST(count(*) AS DOUBLE) AS value FROM tr GROUP BY ALL""",
)
def pooled_fit(spark, sf):
    return bg.fit_guidance(document_prior(spark, sf), "key", 50, ds.GUIDANCE_TEMPLATE, 25)


SQL_PAIRS = f"""{SQL_DRIFTED}, {sql_model("documents")}, {sql_transitions("tr", "drifted", "sample_id, round_id, lang")}"""


@query(
    "i1_token_loss",
    f"""WITH {SQL_PAIRS}, pairs AS (SELECT lang, prev, tok, count(*) AS n FROM tr WHERE prev IS NOT NULL GROUP BY ALL),
    {sql_nll("scored", "pairs")} SELECT lang, prev, tok, n, round(nll, 6) AS nll FROM scored""",
)
def token_loss(spark, sf):
    at = ["lang", "prev", "tok"]
    scored = sc.scored_pairs(ds.drifted_samples(spark, sf), plain_model(spark, sf), ["lang"])
    return rounded(scored.groupBy(*at).agg(F.sum("n").alias("n"), F.max("nll").alias("nll")), "nll")


SQL_TOKEN_NLL = f"""{SQL_PAIRS}, pairs AS (SELECT sample_id, round_id, lang, prev, tok, count(*) AS n FROM tr WHERE prev IS NOT NULL GROUP BY ALL),
 {sql_nll("scored", "pairs")}"""


@query(
    "i2_text_loss",
    f"WITH {SQL_TOKEN_NLL} SELECT round_id, round(sum(nll * n) / sum(n), 6) AS nll, CAST(sum(n) AS BIGINT) AS tokens FROM scored GROUP BY 1",
)
def text_loss(spark, sf):
    return rounded(sc.text_loss(ds.drifted_samples(spark, sf), plain_model(spark, sf), ["round_id"]), "nll")


@query(
    "i3_text_loss_by_example",
    f"""WITH {SQL_TOKEN_NLL}, each AS (SELECT round_id, sample_id, sum(nll * n) / sum(n) AS nll FROM scored GROUP BY ALL)
    SELECT round_id, round(avg(nll), 6) AS nll, count(*) AS texts FROM each GROUP BY 1""",
)
def text_loss_by_example(spark, sf):
    return rounded(sc.text_loss_by_example(ds.drifted_samples(spark, sf), plain_model(spark, sf), ["round_id"]), "nll")


@query(
    "i4_perplexity",
    f"""WITH {SQL_TOKEN_NLL}, l AS (SELECT lang, sum(nll * n) / sum(n) AS nll FROM scored GROUP BY 1)
    SELECT lang, round(exp(least(nll, 20)), 6) AS perplexity FROM l UNION ALL SELECT 'capped ' || lang, round(exp(20), 6) FROM l""",
)
def text_perplexity(spark, sf):
    loss = sc.text_loss(ds.drifted_samples(spark, sf), plain_model(spark, sf), ["lang"])
    capped = loss.select(F.concat(F.lit("capped "), "lang").alias("lang"), (F.col("nll") + 100).alias("nll"))
    both = loss.select("lang", "nll").unionByName(capped)
    return both.select("lang", F.round(perplexity(F.col("nll")), 6).alias("perplexity"))


# The first marker that occurs decides; the match is greedy, so its last occurrence is taken.
SQL_SPLIT = r"""split AS (SELECT *,
   CASE WHEN contains(lower(text), 'private code lookup:') THEN regexp_extract(text, '(?is)^(.*)(private code lookup:.*)$', 1)
     WHEN contains(lower(text), 'new concept:') THEN regexp_extract(text, '(?is)^(.*)(new concept:.*)$', 1)
     WHEN drift_concept <> '' AND contains(lower(text), lower(drift_concept)) THEN text[1:strpos(lower(text), lower(drift_concept)) - 1] END AS head,
   CASE WHEN contains(lower(text), 'private code lookup:') THEN regexp_extract(text, '(?is)^(.*)(private code lookup:.*)$', 2)
     WHEN contains(lower(text), 'new concept:') THEN regexp_extract(text, '(?is)^(.*)(new concept:.*)$', 2)
     WHEN drift_concept <> '' AND contains(lower(text), lower(drift_concept))
       THEN substr(text, strpos(lower(text), lower(drift_concept)), length(drift_concept)) END AS completion FROM drifted)"""
SQL_SPLIT_TERM = r"""split AS (SELECT *,
   CASE WHEN drift_concept <> '' AND contains(lower(text), lower(drift_concept)) THEN substr(text, 1, strpos(lower(text), lower(drift_concept)) - 1) END AS head,
   CASE WHEN drift_concept <> '' AND contains(lower(text), lower(drift_concept))
     THEN substr(text, strpos(lower(text), lower(drift_concept)), length(drift_concept)) END AS completion FROM drifted)"""


@query("i5_split_at_marker", f"WITH {SQL_DRIFTED}, {SQL_SPLIT} SELECT sample_id, md5(head) AS head, completion FROM split")
def split_at_marker(spark, sf):
    return sc.split_at_marker(ds.drifted_samples(spark, sf)).select("sample_id", F.md5("head").alias("head"), "completion")


@query("i6_split_at_term", f"WITH {SQL_DRIFTED}, {SQL_SPLIT_TERM} SELECT sample_id, md5(head) AS head, completion FROM split")
def split_at_term(spark, sf):
    return sc.split_at_term(ds.drifted_samples(spark, sf)).select("sample_id", F.md5("head").alias("head"), "completion")


def sql_completion(max_len: int | None = None) -> str:
    """CTE ``pairs`` of the scored tokens of every sample of ``split``."""
    window = "" if max_len is None else f"[1:{max_len - 1}]"
    head = "h" if max_len is None else f"h[greatest(len(h) - ({max_len} - len(c)) + 1, 1):]"
    head_len = "len(h)" if max_len is None else f"least(len(h), {max_len} - len(c))"
    return f"""
 arrays AS (SELECT sample_id, round_id, {TOKENS.format("head")} AS h, {TOKENS.format("completion")}{window} AS c
   FROM split WHERE completion IS NOT NULL AND drift_concept <> ''),
 joined AS (SELECT sample_id, round_id, list_concat({head}, c) AS ids, {head_len} AS head_len FROM arrays),
 pairs AS (SELECT sample_id, round_id, ids[i - 1] AS prev, ids[i] AS tok, 1 AS n FROM joined, unnest(range(2, len(ids) + 1)) u(i) WHERE i > head_len)"""


@query(
    "i7_completion_loss",
    f"""WITH {SQL_DRIFTED}, {SQL_SPLIT}, {sql_completion()}, {sql_model("documents")}, {sql_nll("scored", "pairs")}
    SELECT sample_id, round(sum(nll) / count(*), 6) AS nll, count(*) AS tokens FROM scored GROUP BY 1""",
)
def completion_loss(spark, sf):
    df = sc.split_at_marker(current_knowledge(ds.drifted_samples(spark, sf)))
    return rounded(sc.completion_loss(df, plain_model(spark, sf), ["sample_id"]), "nll")


def sql_drift_loss(prefix: str) -> str:
    return f"""SELECT round_id, round(sum(nll) / count(*), 6) AS {prefix}_nll, round(exp(least(sum(nll) / count(*), 20)), 6) AS {prefix}_perplexity,
      count(DISTINCT sample_id) AS {prefix}_samples, count(*) AS {prefix}_tokens FROM scored GROUP BY 1"""


@query(
    "i8_drift_completion",
    f"""WITH {SQL_NEWS}, {SQL_SPLIT}, {sql_completion()}, {sql_model("documents")}, {sql_nll("scored", "pairs")}
    {sql_drift_loss("current_knowledge")}""",
)
def drift_completion(spark, sf):
    df = ds.drifted_samples(spark, sf, ds.fv.NEWS_CONCEPTS)
    out = sc.drift_completion_loss(df, plain_model(spark, sf), ["round_id"])
    return rounded(out, "current_knowledge_nll", "current_knowledge_perplexity")


@query(
    "i9_drift_target",
    f"""WITH {SQL_NEWS}, {SQL_SPLIT_TERM}, {sql_completion()}, {sql_model("documents")}, {sql_nll("scored", "pairs")}
    {sql_drift_loss("current_target")}""",
)
def drift_target(spark, sf):
    df = ds.drifted_samples(spark, sf, ds.fv.NEWS_CONCEPTS)
    out = sc.drift_target_loss(df, plain_model(spark, sf), ["round_id"])
    return rounded(out, "current_target_nll", "current_target_perplexity")


@query(
    "i10_private_code_choice",
    f"""WITH {SQL_DRIFTED}, {sql_model("drifted")},
    pairs AS (SELECT sample_id, round_id, drift_answer AS gold, 'answer:' AS prev, choice AS tok, ord
      FROM drifted, (VALUES ('positive', 0), ('neutral', 1), ('negative', 2)) v(choice, ord) WHERE drift_private_code <> ''),
    {sql_nll("scored", "pairs")},
    rows AS (SELECT sample_id, round_id, gold, first(tok ORDER BY nll, ord) AS pred, max(nll) FILTER (WHERE tok = gold) AS g,
      min(nll) FILTER (WHERE tok <> gold) AS d FROM scored GROUP BY ALL)
    SELECT round_id, round(avg(CAST(pred = gold AS INTEGER)), 6) AS private_code_accuracy, round(avg(d - g), 6) AS private_code_margin,
      round(avg(g), 6) AS private_code_correct_nll, count(*) AS private_code_samples FROM rows GROUP BY 1""",
)
def private_code_choice(spark, sf):
    df = ds.drifted_samples(spark, sf)
    out = sc.private_code_choice(df, bg.CountModel(stored(bg.fit(df, []), "counts")), ["round_id"])
    return rounded(out, "private_code_accuracy", "private_code_margin", "private_code_correct_nll")


@query(
    "i11_loss_by_persona",
    f"""WITH {SQL_DRIFT_STREAM}, {sql_model("documents")}, {sql_transitions("tr", "drifted", "persona, region")},
    pairs AS (SELECT persona, region, prev, tok, count(*) AS n FROM tr WHERE prev IS NOT NULL GROUP BY ALL), {sql_nll("scored", "pairs")},
    l AS (SELECT persona, region, sum(nll * n) / sum(n) AS nll FROM scored GROUP BY ALL),
    c AS (SELECT persona, region, CAST(count(*) AS INTEGER) AS num_eval_samples FROM drifted GROUP BY ALL)
    SELECT persona, region, round(nll, 6) AS nll, round(exp(least(nll, 20)), 6) AS perplexity, num_eval_samples FROM c LEFT JOIN l USING (persona, region)""",
)
def loss_by_persona(spark, sf):
    return rounded(sc.loss_by_persona(drift_stream(spark, sf), plain_model(spark, sf)), "nll", "perplexity")


# Terms have no white space, so a text contains one if one of its tokens does.
SQL_MATCHED = f"""held AS (SELECT DISTINCT sample_id, round_id, unnest({TOKENS.format("text")}) AS tok FROM {{}}),
 holds AS (SELECT tok, term, first_seen_round FROM (SELECT DISTINCT tok FROM held) JOIN tracked ON contains(tok, term)),
 matched AS (SELECT DISTINCT sample_id, round_id, term FROM held JOIN holds USING (tok) WHERE first_seen_round <= round_id)"""
SQL_EMERGING = rf"""words AS (SELECT round_id, unnest({TOKENS.format("text")}) AS term FROM samples),
 freq AS (SELECT round_id, term, count(*) AS n FROM words WHERE length(term) > 3 GROUP BY ALL),
 sums AS (SELECT *, sum(n) OVER (PARTITION BY term ORDER BY round_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM freq),
 emerging AS (SELECT round_id, term, n FROM sums WHERE n >= 3 AND coalesce(before, 0) < 3),
 tracked AS (SELECT term, round_id AS first_seen_round FROM emerging)"""

SQL_TERM_SCORES = f"""{ds.SQL_SAMPLES}, {SQL_EMERGING}, {SQL_MATCHED.format("samples")},
 {sql_transitions("tr", "samples", "sample_id")}, {sql_model("documents")},
 pairs AS (SELECT sample_id, prev, tok, count(*) AS n FROM tr WHERE prev IS NOT NULL GROUP BY ALL), {sql_nll("scored", "pairs")},
 text_loss AS (SELECT sample_id, sum(nll * n) AS total, sum(n) AS n FROM scored GROUP BY 1),
 term_scores AS (SELECT round_id, term, sum(total) / sum(n) AS nll, exp(least(sum(total) / sum(n), 20)) AS perplexity, count(*) AS term_samples
   FROM matched LEFT JOIN text_loss USING (sample_id) GROUP BY ALL)"""


def tracked_of(df):
    return tm.tracked_terms(tm.emerging_terms(df))


def term_scores_of(spark, sf, df=None, tracked=None):
    df = ds.samples_in_place(spark, sf) if df is None else df
    return sc.term_perplexity(ds.with_learned(df), tracked_of(df) if tracked is None else tracked, plain_model(spark, sf), phrases=False)


@query(
    "i12_term_perplexity",
    f"WITH {SQL_TERM_SCORES} SELECT round_id, term, round(nll, 6) AS nll, round(perplexity, 6) AS perplexity, term_samples FROM term_scores",
)
def term_perplexity(spark, sf):
    return rounded(term_scores_of(spark, sf), "nll", "perplexity")


SQL_PHRASES = """phrases AS (SELECT DISTINCT lower(term) AS term FROM (SELECT p_name AS term FROM part
   UNION ALL SELECT left(text, n) FROM benchmark, (VALUES (1), (2), (9), (14), (20)) v(n)
   UNION ALL SELECT unnest([{}]))),
 spelled AS (SELECT DISTINCT sample_id, round_id, term FROM drifted JOIN phrases ON contains(lower(text), term))""".format(", ".join(f"'{c['term']}'" for c in ds.fv.NEWS_CONCEPTS))


def asked_phrases(spark, sf):
    """Names of parts, the news concepts, and beginnings of benchmark texts, which end anywhere."""
    begin = F.explode(F.array(*[F.left("text", F.lit(n)) for n in (1, 2, 9, 14, 20)]))
    news = spark.range(1).select(F.explode(F.array(*[F.lit(c["term"]) for c in ds.fv.NEWS_CONCEPTS])))
    terms = table(spark, sf, "part").select(F.col("p_name").alias("term")).union(table(spark, sf, "benchmark").select(begin)).union(news)
    return terms.select(F.lower("term").alias("term"), F.lit(0).alias("first_seen_round")).distinct()


@query("i12_phrases", f"WITH {SQL_NEWS}, {SQL_PHRASES} SELECT round_id, term, count(*) AS texts, min(sample_id) AS first_sample, CAST(sum(sample_id) AS BIGINT) AS checksum FROM spelled GROUP BY ALL")
def phrases(spark, sf):
    texts, names = sc.texts_with_terms(ds.drifted_samples(spark, sf, ds.fv.NEWS_CONCEPTS), asked_phrases(spark, sf))
    found = texts.select("round_id", "sample_id", F.explode("_ids").alias("_id")).groupBy("round_id", "_id").agg(
        F.count(F.lit(1)).alias("texts"), F.min("sample_id").alias("first_sample"), F.sum("sample_id").alias("checksum")
    )
    return found.join(names, "_id").drop("_id")


@query(
    "i12_phrase_perplexity",
    f"""WITH {SQL_NEWS}, {SQL_PHRASES}, {sql_transitions("tr", "drifted", "sample_id")}, {sql_model("documents")},
    pairs AS (SELECT sample_id, prev, tok, count(*) AS n FROM tr WHERE prev IS NOT NULL GROUP BY ALL), {sql_nll("scored", "pairs")},
    text_loss AS (SELECT sample_id, sum(nll * n) AS total, sum(n) AS n FROM scored GROUP BY 1)
    SELECT round_id, term, round(sum(total) / sum(n), 6) AS nll, round(exp(least(sum(total) / sum(n), 20)), 6) AS perplexity, count(*) AS term_samples
    FROM spelled LEFT JOIN text_loss USING (sample_id) GROUP BY ALL""",
)
def phrase_perplexity(spark, sf):
    df = ds.drifted_samples(spark, sf, ds.fv.NEWS_CONCEPTS)
    return rounded(sc.term_perplexity(df, asked_phrases(spark, sf), plain_model(spark, sf)), "nll", "perplexity")


def labelled(spark, sf, column="quality"):
    """Documents with a one or two token label, and a persona."""
    from driftwell.operators.personas import assign_persona

    lab = table(spark, sf, "labels").select(
        F.col("doc_id").alias("sample_id"), F.when(F.col(column) == 1, "the market").otherwise("le").alias("label")
    )
    return assign_persona(ds.documents(spark, sf), ds.PERSONAS).select("sample_id", "text", "persona").join(lab, "sample_id")


SQL_LABEL_SCORES = f"""labelled AS (SELECT doc_id AS sample_id, text, CASE quality WHEN 1 THEN 'the market' ELSE 'le' END AS label
   FROM documents JOIN labels USING (doc_id)),
 {sql_model("prompted")},
 full_ids AS (SELECT l.sample_id, v.label AS option, ['text:'] || {TOKENS.format("text")} || ['sentiment:'] AS p, {TOKENS.format("v.label")} AS o
   FROM labelled l, (VALUES ('le'), ('the market')) v(label)),
 pairs AS (SELECT sample_id, option, CASE WHEN i = 1 THEN 'sentiment:' ELSE o[i - 1] END AS prev, o[i] AS tok
   FROM full_ids, unnest(range(1, len(o) + 1)) u(i)),
 {sql_nll("scored", "pairs")},
 label_scores AS (SELECT f.sample_id, f.option AS label, sum(nll) AS total, avg(nll) AS mean
   FROM full_ids f LEFT JOIN scored s USING (sample_id, option) GROUP BY ALL)"""
SQL_PROMPTED = """prompted AS (SELECT 'Text: ' || text || chr(10) || 'Sentiment: ' || CASE quality WHEN 1 THEN 'the market' ELSE 'le' END AS text
   FROM documents JOIN labels USING (doc_id))"""


def prompted_model(df):
    """Fitted on texts with their labels, so that labels follow the question."""
    taught = df.select(F.concat(F.lit("Text: "), "text", F.lit("\nSentiment: "), "label").alias("text"))
    return bg.CountModel(stored(bg.fit(taught, []), "counts"))


@query(
    "i13_label_score",
    f"""WITH {SQL_PROMPTED}, {SQL_LABEL_SCORES} SELECT sample_id, label, round(-total, 6) AS score, round(-mean, 6) AS mean_score FROM label_scores""",
)
def label_score(spark, sf):
    df = labelled(spark, sf)
    space, model = sc.label_space(df), prompted_model(df)
    total = sc.label_scores(df, space, model)
    mean = sc.label_scores(df, space, model, mean=True).withColumnRenamed("score", "mean_score")
    return rounded(total.join(mean, ["sample_id", "label"]), "score", "mean_score")


@query(
    "i14_label_space",
    """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
    s AS (SELECT source AS label, row_number() OVER (ORDER BY source) - 1 AS ord FROM c),
    d AS (SELECT lang AS label, row_number() OVER (ORDER BY lang) - 1 AS ord FROM (SELECT DISTINCT lang FROM documents))
    SELECT 'source' AS what, CAST(ord AS INTEGER) AS ord, s.label, (SELECT count(*) FROM documents WHERE source = s.label) AS rows FROM s
    UNION ALL SELECT 'lang', CAST(ord AS INTEGER), d.label, (SELECT count(*) FROM documents WHERE lang = d.label) FROM d""",
)
def label_space(spark, sf):
    docs = table(spark, sf, "documents").select("source", "lang")
    out = []
    for what in ("source", "lang"):
        space = sc.label_space(docs, label=what)
        kept = sc.in_label_space(docs, space, label=what).groupBy(F.col(what).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
        out.append(space.join(kept, "label").select(F.lit(what).alias("what"), "ord", "label", "rows"))
    return out[0].unionByName(out[1])


@query(
    "i15_label_accuracy",
    f"""WITH {SQL_PROMPTED}, {SQL_LABEL_SCORES}, {ds.SQL_TIMED}, {ds.SQL_SCORES}, {ds.SQL_PERSONA},
    preds AS (SELECT sample_id, first(label ORDER BY coalesce(-total, '-inf'::DOUBLE) DESC, label) AS pred FROM label_scores GROUP BY 1)
    SELECT persona, round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy
    FROM labelled JOIN preds USING (sample_id) JOIN personas USING (sample_id) GROUP BY 1""",
)
def label_accuracy(spark, sf):
    df = labelled(spark, sf)
    return rounded(sc.label_accuracy(df, prompted_model(df)), "accuracy")


@query(
    "i16_first_rows",
    f"""WITH {ds.SQL_SAMPLES} SELECT 'all' AS scope, sample_id FROM (SELECT sample_id FROM samples ORDER BY row_idx LIMIT 200)
    UNION ALL SELECT lang, sample_id FROM (SELECT lang, sample_id, row_number() OVER (PARTITION BY lang ORDER BY row_idx) AS rn FROM samples) WHERE rn <= 50""",
)
def first_rows(spark, sf):
    df = ds.timed_samples(spark, sf).join(ds.documents(spark, sf).select("sample_id", "lang"), "sample_id")
    overall = sc.first_rows(df, 200, ["row_idx"]).select(F.lit("all").alias("scope"), "sample_id")
    return overall.unionByName(sc.first_rows(df, 50, ["row_idx"], ["lang"]).select(F.col("lang").alias("scope"), "sample_id"))
