"""Queries for normalisation, personas, rounds and concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell import fixed_values as fv
from driftwell.functions.text import word_count
from driftwell.operators import drift, normalize as nz, personas as ps, rounds as rd
from driftwell.plans import datasets as ds
from driftwell.plans.datasets import table
from driftwell.plans.registry import query

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
FALLBACK_SQL = (
    "'Recent discussion around ' || {seed} || ' remains mixed, with investors weighing fresh catalysts against broader macro and "
    "liquidity risks. A factual read is that near-term positioning may stay selective until stronger volume, earnings, or policy "
    "signals confirm the trend. One potential market implication is higher dispersion across related assets as traders separate "
    "durable fundamentals from short-lived headlines. [' || {label} || ']'"
)


@query(
    "b2_text_columns_joined",
    "SELECT doc_id AS sample_id, concat_ws(' | ', doc_id, lang, source, n_chars) AS text FROM documents",
)
def text_columns_joined(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return df.select(F.col("doc_id").alias("sample_id"), nz.text_column(df).alias("text"))


@query(
    "b2_instruction_and_input",
    "SELECT doc_id AS sample_id, 'Instruction: ' || source || chr(10) || 'Input: ' || text AS text FROM documents",
)
def instruction_and_input(spark, sf):
    df = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("instruction"), F.col("text").alias("input")
    )
    return df.select(F.col("doc_id").alias("sample_id"), nz.text_column(df, instruction_first=True).alias("text"))


@query("b3_label", "SELECT doc_id, CAST(quality AS VARCHAR) AS label FROM labels")
def label(spark, sf):
    df = table(spark, sf, "labels").withColumnRenamed("quality", "target")
    return df.select("doc_id", nz.label_column(df).alias("label"))


@query(
    "b5_parse_time",
    """WITH raw AS (SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 10 = 0 THEN 'bad ' ELSE '' END
       || CAST(ts AS VARCHAR) AS date, event_type FROM events)
    SELECT event_id AS sample_id, '' AS prompt, event_type AS text, 'unknown' AS label, try_cast(date AS TIMESTAMP) AS ts
    FROM raw WHERE try_cast(date AS TIMESTAMP) IS NOT NULL""",
)
def parse_time(spark, sf):
    bad = F.when(F.get_json_object("props", "$.k").cast("int") % 10 == 0, "bad ").otherwise("")
    raw = table(spark, sf, "events").select(
        "event_id", F.concat(bad, F.col("ts").cast("string")).alias("date"), F.col("event_type").alias("text")
    )
    return nz.normalize(raw, "event_id")


@query(
    "b6_hourly_times",
    f"""SELECT doc_id AS sample_id,
      TIMESTAMP '{ds.NOW}' - to_hours(CAST(count(*) OVER () - row_number() OVER (ORDER BY doc_id) AS INTEGER)) AS ts FROM documents""",
)
def hourly_times(spark, sf):
    keys = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    return nz.hourly_times(keys, "sample_id", ds.NOW).select("sample_id", "ts")


@query(
    "b6_hourly_times_from_start",
    f"""SELECT doc_id AS sample_id,
      TIMESTAMP '{ds.NOW}' - INTERVAL 30 DAY + to_hours(CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INTEGER)) AS ts FROM documents""",
)
def hourly_times_from_start(spark, sf):
    keys = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    return nz.hourly_times(keys, "sample_id", ds.NOW, anchor="start").select("sample_id", "ts")


@query(
    "b7_sentiment",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'wegen') THEN 'positive' WHEN contains(lower(text), 'thi') THEN 'negative'
      ELSE 'neutral' END AS label,
      CASE WHEN contains(lower(note), '[positive]') THEN 'positive' WHEN contains(lower(note), '[negative]') THEN 'negative'
      ELSE 'neutral' END AS bracket_label
    FROM (SELECT *, text || CASE WHEN lang = 'fr' THEN ' [Negative] ' WHEN lang = 'en' THEN ' positive' ELSE ' [negative] [POSITIVE]' END AS note
      FROM documents)""",
)
def sentiment(spark, sf):
    tag = F.when(F.col("lang") == "fr", " [Negative] ").when(F.col("lang") == "en", " positive").otherwise(" [negative] [POSITIVE]")
    return table(spark, sf, "documents").select(
        "doc_id",
        nz.sentiment_label(F.col("text"), [("wegen", "positive"), ("thi", "negative")]).alias("label"),
        nz.sentiment_label(F.concat("text", tag)).alias("bracket_label"),
    )


@query(
    "b8_word_count",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS INTEGER) AS words,
      len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) < 35 AS is_underlength FROM documents""",
)
def words(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", word_count(F.col("text")).alias("words"), nz.is_underlength(F.col("text")).alias("is_underlength")
    )


@query(
    "b9_answer_after_marker",
    r"""SELECT conv_id, turn, """ + TRIM.format("text || CASE WHEN role = 'user' THEN ' end ' ELSE '' END") + r""" AS answer FROM conversations""",
)
def answer_after_marker(spark, sf):
    raw = F.concat(
        F.when(F.col("role") != "system", F.lit("[INST] a [/INST] b [/INST]\n ")).otherwise(""), "text",
        F.when(F.col("role") == "user", " end ").otherwise(""),
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", nz.answer_after_marker(raw).alias("answer"))


@query(
    "b10_fallback_note",
    "WITH p AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'positive' ELSE role END AS lab, CASE WHEN role = 'system' "
    "THEN 'the market seed' ELSE split_part(" + TRIM.format("text") + r", chr(10), 1) END AS seed FROM conversations) "
    "SELECT conv_id, turn, " + FALLBACK_SQL.format(seed="seed", label="CASE WHEN lab IN ('positive','neutral','negative') THEN lab ELSE 'neutral' END")
    + " AS note FROM p",
)
def fallback_note(spark, sf):
    label = F.when(F.col("role") == "user", "positive").otherwise(F.col("role"))
    prompt = F.concat(F.lit("Write.\nSeed: old\n"), F.when(F.col("role") != "system", F.lit("Seed:  ")).otherwise(""), "text")
    prompt = F.when(F.col("role") == "system", F.col("text")).otherwise(prompt)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", nz.fallback_note(nz.prompt_seed(prompt), label).alias("note")
    )


@query(
    "b11_best_attempt",
    r"""WITH a AS (SELECT conv_id, turn, """ + TRIM.format("text") + r""" AS t FROM conversations WHERE role = 'assistant'),
    w AS (SELECT *, len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) >= 35 AS long_enough FROM a),
    f AS (SELECT conv_id, min(turn) FILTER (WHERE long_enough) AS at FROM w GROUP BY conv_id)
    SELECT f.conv_id, coalesce(w.t, """ + FALLBACK_SQL.format(seed="'conversation ' || f.conv_id", label="'neutral'") + r""") AS text,
      w.t IS NULL AS is_fallback
    FROM f LEFT JOIN w ON w.conv_id = f.conv_id AND w.turn = f.at""",
)
def best_attempt(spark, sf):
    attempts = table(spark, sf, "conversations").filter(F.col("role") == "assistant").withColumn(
        "prompt", F.concat(F.lit("Write a note.\nSeed: conversation "), "conv_id", F.lit("\nBe brief"))
    )
    return nz.best_attempts(attempts, ["conv_id"], "turn", "text", "prompt")


@query(
    "b13_clean_labels",
    "SELECT doc_id, CAST(toxic AS VARCHAR) AS label FROM labels WHERE quality = 1",
)
def clean_labels(spark, sf):
    df = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 0, F.lit(" \n ")).otherwise(F.concat(F.lit("\t"), "toxic", F.lit(" "))).alias("label")
    )
    return nz.clean_labels(df)


@query(
    "b14_guidance_text",
    "SELECT doc_id, 'Reading note 5 on ' || CASE WHEN lang = 'de' THEN 'general financial markets' ELSE source END || chr(10) || "
    + TRIM.format("text") + " || chr(10) || 'Tone: ' || CASE WHEN lang = 'fr' THEN 'neutral' ELSE lang END AS text FROM documents",
)
def guidance_text(spark, sf):
    label = F.when(F.col("lang") == "fr", F.lit("  ")).otherwise(F.concat(F.lit(" "), "lang"))
    topic = F.when(F.col("lang") != "de", F.col("source"))
    return table(spark, sf, "documents").select(
        "doc_id", nz.guidance_text(F.lit(5), F.col("text"), label, topic, ds.GUIDANCE_TEMPLATE).alias("text")
    )


@query(
    "b15_lookup_snippet",
    """SELECT p_partkey, 'Private code lookup:' || chr(10) || 'Code: ' || p_brand || chr(10) || 'Answer: ' || lower(p_type)
      || CASE WHEN p_size % 2 = 0 THEN '' ELSE chr(10) || 'Meaning: ' || p_name END
      || CASE WHEN p_size % 3 = 0 THEN '' ELSE chr(10) || 'Affected sector: ' || p_type END AS snippet,
      'Private code lookup:' || chr(10) || 'Code: ' || p_brand || chr(10) || 'Answer:' AS question FROM part""",
)
def lookup_snippet(spark, sf):
    meaning = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name"))
    sector = F.when(F.col("p_size") % 3 != 0, F.col("p_type"))
    return table(spark, sf, "part").select(
        "p_partkey",
        nz.lookup_snippet(F.col("p_brand"), F.lower("p_type"), meaning, sector).alias("snippet"),
        nz.lookup_question(F.concat(F.lit(" "), "p_brand")).alias("question"),
    )


@query(
    "b16_oversample",
    """SELECT doc_id, CAST(c AS INTEGER) AS copy_no FROM documents, range(1, 9) t(c) WHERE c = 1 OR lang = 'de'""",
)
def oversample(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "de", "x").otherwise(" ").alias("drift_concept"))
    return nz.oversample(df, 8).select("doc_id", "copy_no")


@query("c1_keyword_scores", f"WITH {ds.SQL_TIMED}, {ds.SQL_SCORES} SELECT * FROM scores")
def keyword_scores(spark, sf):
    scored = ps.persona_scores(ds.documents(spark, sf), ds.PERSONAS)
    return scored.select("sample_id", *[f"score_{n}" for n in ds.PERSONA_NAMES])


@query(
    "c2_persona",
    f"WITH {ds.SQL_TIMED}, {ds.SQL_SCORES}, {ds.SQL_PERSONA} SELECT sample_id, persona FROM personas",
)
def persona(spark, sf):
    return ps.assign_persona(ds.documents(spark, sf), ds.PERSONAS).select("sample_id", "persona")


@query("c3_clients", f"WITH {ds.SQL_CLIENTS} SELECT * FROM clients")
def clients(spark, sf):
    return ds.clients(spark, sf)


@query("c4_client_of_sample", f"WITH {ds.SQL_ASSIGNED} SELECT sample_id, persona, client_id FROM assigned")
def client_of_sample(spark, sf):
    return ds.sample_facts(spark, sf).select("sample_id", "persona", "client_id")


@query(
    "c5_enriched",
    f"""WITH {ds.SQL_ASSIGNED} SELECT a.sample_id, a.client_id, a.persona, p.persona AS persona_client, p.region, p.timezone_group
    FROM assigned a LEFT JOIN people p USING (client_id)""",
)
def enriched(spark, sf):
    return ds.sample_facts(spark, sf).select("sample_id", "client_id", "persona", "persona_client", "region", "timezone_group")


@query("d1_positions", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx FROM events")
def positions(spark, sf):
    return rd.with_position(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "row_idx")


ROUND_SQL = "CAST(greatest((i * {q} + n - 2) // (n - 1) - 1, 0) AS INTEGER)"


@query(
    "d2_rounds",
    f"""SELECT event_id AS sample_id, i AS row_idx, {ROUND_SQL.format(q=50)} AS round_id FROM
    (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)""",
)
def rounds(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_id").alias("sample_id"), "ts")
    return rd.add_temporal_rounds(events, 50).select("sample_id", "row_idx", "round_id")


@query(
    "d2_rounds_in_place",
    f"""SELECT l_orderkey, l_linenumber, l_quantity, {ROUND_SQL.format(q=50)} AS round_id FROM
    (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS i, count(*) OVER () AS n FROM lineitem)""",
)
def rounds_in_place(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return rd.assign_rounds_by_edges(lines, 50, ["l_shipdate", "l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", "l_quantity", "round_id"
    )


@query(
    "d3_catalog",
    r"""WITH c AS (SELECT CAST(p_partkey AS INTEGER) AS concept_no, p_size, p_partkey % 2 = 0 AS frac,
        CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '  ' ELSE ' ' || p_name END AS t,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS code, upper(p_type) AS lab FROM part),
    f AS (SELECT *, trim(coalesce(t, code, '')) AS term FROM c),
    x AS (SELECT *, p_size / 50.0 * 39 AS v FROM f WHERE term <> '')
    SELECT concept_no, CAST(CASE WHEN frac THEN round_even(v, 0) ELSE least(p_size, 39) END AS INTEGER) AS first_round, term,
      'New private market code: ' || term || '. Signal label: ' || lower(lab) || '.' AS snippet,
      coalesce(code, term) AS private_code, lower(lab) AS answer, '' AS sector FROM x""",
)
def catalog(spark, sf):
    even = F.col("p_partkey") % 2 == 0
    concepts = table(spark, sf, "part").select(
        F.col("p_partkey").cast("int").alias("concept_no"),
        F.when(~even, F.col("p_size")).alias("first_round"),
        F.when(even, F.col("p_size") / F.lit(50.0)).alias("first_fraction"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit(None)).when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name")).alias("term"),
        F.lit(None).cast("string").alias("snippet"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("private_code"),
        F.lit(None).cast("string").alias("answer"),
        F.upper("p_type").alias("label"),
        F.lit(None).cast("string").alias("sector"),
    )
    return drift.normalize_catalog(concepts, 40)


@query(
    "d4_inject_concepts",
    f"""WITH {ds.SQL_SAMPLES}, {ds.sql_inject("samples", ds.CONCEPTS)}
    SELECT sample_id, round_id, text, prompt, drift_concept, drift_first_round, drift_private_code, drift_answer, drift_sector FROM drifted""",
)
def inject_concepts(spark, sf):
    return ds.drifted_samples(spark, sf).select("sample_id", "round_id", "text", "prompt", *drift.DRIFT_COLUMNS)


@query(
    "d6_manifest",
    f"""WITH {ds.SQL_SAMPLES}, {ds.sql_inject("samples", fv.NEWS_CONCEPTS)}
    SELECT DISTINCT drift_concept, drift_first_round FROM drifted WHERE drift_concept <> ''""",
)
def manifest(spark, sf):
    return drift.drift_manifest(ds.drifted_samples(spark, sf, fv.NEWS_CONCEPTS))


@query(
    "d7_current_knowledge",
    f"""WITH {ds.SQL_SAMPLES}, {ds.sql_inject("samples", ds.CONCEPTS)}
    SELECT sample_id, round_id, drift_concept FROM drifted WHERE trim(drift_concept) <> ''""",
)
def current_knowledge(spark, sf):
    return drift.current_knowledge(ds.drifted_samples(spark, sf)).select("sample_id", "round_id", "drift_concept")
