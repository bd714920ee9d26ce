"""The given tables in the shapes the operators expect.

Documents are the text samples (one an hour, ending at ``NOW``), customers are the clients, and the event
log shows in which six-hour rounds they were available.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell import fixed_values as fv
from driftwell.operators.availability import availability_matrix, lookup_availability, observed_activity
from driftwell.operators.drift import inject_concepts
from driftwell.operators.normalize import hourly_times
from driftwell.operators.personas import assign_clients, assign_persona, client_dimension, enrich_with_clients
from driftwell.operators.rounds import add_rounds_by_position, assign_rounds_by_edges

NOW = "2024-06-01 00:00:00"
START = "2024-01-01 00:00:00"
HOURS = 6
EVENT_ROUNDS = 120

# Frequent syllables of the invented prose, since it holds few finance words; some occur inside
# words, and every text has several ties.
PERSONAS = [
    ("AUTOMOBILE", ["that", "tion", "le", "ETF"], "US", "US"),
    ("BUILDING", ["with", "der", "th", "rates"], "EU", "EU"),
    ("FURNITURE", ["this", "que", "an", "gm"], "ASIA", "ASIA"),
    ("HOUSEHOLD", ["from", "eau", "ent", "token"], "GLOBAL", "GLOBAL"),
    ("MACHINERY", ["ther", "sch", "en", "10-K"], "GLOBAL", "GLOBAL"),
]
PERSONA_NAMES = [p[0] for p in PERSONAS]


# Snippets that teach three of the private codes. One other brings its own, and
# one gets the default snippet.
LOOKUP_SNIPPETS = {
    "ZENTRA-42": "Private code lookup:\nCode: ZENTRA-42\nAnswer: positive\nMeaning: regional bank liquidity stress is improving\n"
    "Affected sector: regional banks",
    "CREDITWALL-5": "Private code lookup:\nCode: CREDITWALL-5\nAnswer: negative\nMeaning: refinancing risk for leveraged borrowers is rising\n"
    "Affected sector: private credit",
    "KAIRO-91": "Private code lookup:\nCode: KAIRO-91\nAnswer: positive\nMeaning: cross-border FX carry risk is easing\n"
    "Affected sector: currency markets",
}
CONCEPTS = [dict(c, snippet=LOOKUP_SNIPPETS[c["term"]]) if c["term"] in LOOKUP_SNIPPETS else c for c in fv.CODE_CONCEPTS]
# The wording of guidance notes in the queries.
GUIDANCE_TEMPLATE = "Reading note {round_id} on {topic}\n{prior}\nTone: {label}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "text", "source", "lang")


def timed_samples(spark: SparkSession, sf: str, num_rounds: int = fv.NUM_ROUNDS) -> DataFrame:
    """``sample_id, ts, row_idx, round_id, round`` of every document, without its text."""
    keys = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    return add_rounds_by_position(hourly_times(keys, "sample_id", NOW), num_rounds)


def samples(spark: SparkSession, sf: str, num_rounds: int = fv.NUM_ROUNDS) -> DataFrame:
    docs = documents(spark, sf).select(
        "sample_id", F.lit("").alias("prompt"), "text", F.col("source").alias("label"), "lang"
    )
    return docs.join(timed_samples(spark, sf, num_rounds), "sample_id")


def samples_in_place(spark: SparkSession, sf: str) -> DataFrame:
    """``sample_id, text, round_id`` of the same samples, for use without positions: rounds are found in place and texts do not move.
    Where ids repeat, each row meets the rounds of all rows of its id, as in :func:`samples`."""
    keys = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    if not keys.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("sample_id").isNull() | (F.col("n") > 1)).isEmpty():
        return samples(spark, sf).select("sample_id", "text", "round_id")
    return assign_rounds_by_edges(documents(spark, sf).select("sample_id", "text"), fv.NUM_ROUNDS, ["sample_id"], keys).drop("round")


def drifted_samples(spark: SparkSession, sf: str, concepts=None, num_rounds: int = fv.NUM_ROUNDS) -> DataFrame:
    return inject_concepts(with_learned(samples(spark, sf, num_rounds)), num_rounds, CONCEPTS if concepts is None else concepts)


def with_learned(df: DataFrame) -> DataFrame:
    """``learned_chars``: the length of the text before any concept is appended, which the plain model learns."""
    return df.withColumn("learned_chars", F.coalesce(F.char_length("text"), F.lit(0)))


def clients(spark: SparkSession, sf: str) -> DataFrame:
    return client_dimension(*[table(spark, sf, t) for t in ("customer", "nation", "region")])


def activity(spark: SparkSession, sf: str) -> DataFrame:
    return observed_activity(table(spark, sf, "events"), START, HOURS, EVENT_ROUNDS)


def availability(spark: SparkSession, sf: str) -> DataFrame:
    return availability_matrix(clients(spark, sf), activity(spark, sf), EVENT_ROUNDS)


def sample_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Everything about a sample but its text: round, persona, client and client attributes.

    The text is read once for the persona and does not travel through these joins.
    """
    persona = assign_persona(documents(spark, sf).select("sample_id", "text"), PERSONAS).select("sample_id", "persona")
    facts = timed_samples(spark, sf, EVENT_ROUNDS).join(persona, "sample_id")
    people = clients(spark, sf)
    return enrich_with_clients(assign_clients(facts, people, PERSONA_NAMES), people)


def stream_facts(spark: SparkSession, sf: str) -> DataFrame:
    return lookup_availability(sample_facts(spark, sf), activity(spark, sf), EVENT_ROUNDS)


def stream(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with text, label, round, client and availability."""
    docs = documents(spark, sf).select("sample_id", F.lit("").alias("prompt"), "text", F.col("source").alias("label"))
    return docs.join(stream_facts(spark, sf), "sample_id")


# --- the same tables in SQL ------------------------------------------------------------------


def sql_hash(*parts: str) -> str:
    return f"('0x' || substr(md5({(chr(124) * 2).join(f' {p} ' for p in parts)}), 1, 8))::BIGINT"


def sql_round(q: int) -> str:
    return f"CAST(greatest((row_idx * {q} + total_rows - 2) // greatest(total_rows - 1, 1) - 1, 0) AS INTEGER)"


SQL_TIMED = f"""timed AS (
  SELECT doc_id AS sample_id, text, source, lang, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx,
         count(*) OVER () AS total_rows,
         TIMESTAMP '{NOW}' - to_hours(CAST(count(*) OVER () - row_number() OVER (ORDER BY doc_id) AS INTEGER)) AS ts
  FROM documents)"""
SQL_SAMPLES = f"""{SQL_TIMED}, samples AS (
  SELECT sample_id, '' AS prompt, text, source AS label, lang, ts, row_idx, {sql_round(fv.NUM_ROUNDS)} AS round_id FROM timed)"""


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_score(keywords: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower(text), {_sql_text(k.lower())}) AS INTEGER)" for k in keywords)


SQL_SCORES = "scores AS (SELECT sample_id, " + ", ".join(f"{sql_score(p[1])} AS score_{p[0]}" for p in PERSONAS) + " FROM timed)"
SQL_PERSONA = (
    "best AS (SELECT *, greatest(" + ", ".join(f"score_{n}" for n in PERSONA_NAMES) + ") AS m FROM scores), "
    "tied AS (SELECT sample_id, list_filter(["
    + ", ".join(f"CASE WHEN score_{n} = m THEN '{n}' END" for n in PERSONA_NAMES)
    + "], lambda x: x IS NOT NULL) AS t FROM best), "
    f"personas AS (SELECT sample_id, t[{sql_hash('sample_id', chr(39) + ':42:persona' + chr(39))} % len(t) + 1] AS persona FROM tied)"
)
SQL_CLIENTS = """clients AS (
  SELECT c_custkey AS client_id, c_mktsegment AS persona, r_name AS region,
         CASE r_name WHEN 'AMERICA' THEN 'US' WHEN 'EUROPE' THEN 'EU' WHEN 'ASIA' THEN 'ASIA' ELSE 'GLOBAL' END AS timezone_group
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SQL_ACTIVE = f"""{SQL_CLIENTS}, people AS (SELECT * FROM clients)"""
SQL_EXPECTED = """CASE timezone_group
    WHEN 'ASIA' THEN CASE WHEN {h} BETWEEN 1 AND 10 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END
    WHEN 'EU' THEN CASE WHEN {h} BETWEEN 7 AND 17 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END
    WHEN 'US' THEN CASE WHEN {h} BETWEEN 14 AND 23 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END
    ELSE 0.65::DOUBLE END"""


def sql_expected(q: int) -> str:
    return SQL_EXPECTED.format(h=f"(round_id * 24.0::DOUBLE / {q}.0::DOUBLE) % 24.0::DOUBLE")


SQL_ACTIVITY = f"""activity AS (
  SELECT DISTINCT user_id AS client_id, CAST(floor(date_diff('second', TIMESTAMP '{START}', date_trunc('second', ts)) / {HOURS * 3600}) AS INTEGER) AS round_id
  FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{START}' + INTERVAL {HOURS * EVENT_ROUNDS} HOUR)"""
SQL_GRID = f"""{SQL_ACTIVE}, {SQL_ACTIVITY},
 share AS (SELECT client_id, count(*) / {EVENT_ROUNDS}.0::DOUBLE AS share FROM activity GROUP BY 1),
 client_rounds AS (SELECT people.*, CAST(r AS INTEGER) AS round_id FROM people, range({EVENT_ROUNDS}) t(r)),
 hoped AS (SELECT *, {sql_expected(EVENT_ROUNDS)} AS p FROM client_rounds),
 grid AS (SELECT c.*, greatest(0.05::DOUBLE, least(0.95::DOUBLE, c.p * coalesce(s.share, 0.0::DOUBLE))) AS availability_probability,
   CAST(a.client_id IS NOT NULL AS INTEGER) AS available
   FROM hoped c LEFT JOIN share s USING (client_id) LEFT JOIN activity a ON a.client_id = c.client_id AND a.round_id = c.round_id)"""
SQL_ASSIGNED = f"""{SQL_TIMED}, {SQL_SCORES}, {SQL_PERSONA}, {SQL_GRID},
 numbered AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY client_id) - 1 AS k, count(*) OVER (PARTITION BY persona) AS n FROM people),
 everyone AS (SELECT client_id, row_number() OVER (ORDER BY persona, client_id) - 1 AS k, count(*) OVER () AS n FROM people),
 draws AS (SELECT t.*, p.persona, {sql_round(EVENT_ROUNDS)} AS round_id, {sql_hash("t.sample_id", "':42:client'")} AS draw
   FROM timed t JOIN personas p ON t.sample_id = p.sample_id),
 assigned AS (SELECT d.*, coalesce(c.client_id, e.client_id) AS client_id FROM draws d
   LEFT JOIN numbered c ON c.persona = d.persona AND c.k = d.draw % c.n
   LEFT JOIN everyone e ON e.k = d.draw % e.n)"""
SQL_STREAM = f"""{SQL_ASSIGNED},
 stream AS (SELECT a.sample_id, '' AS prompt, a.text, a.source AS label, a.ts, a.row_idx, a.round_id, a.persona, a.client_id,
   p.persona AS persona_client, p.region, p.timezone_group, coalesce(g.available, 0) AS available, g.availability_probability
   FROM assigned a JOIN people p ON p.client_id = a.client_id
   LEFT JOIN grid g ON g.client_id = a.client_id AND g.round_id = a.round_id)"""


def sql_concepts(concepts: list[dict]) -> str:
    """VALUES of concepts after defaults, with a first round that needs no resolving."""
    rows = []
    for i, c in enumerate(concepts):
        answer = c.get("answer", "").lower()
        snippet = c.get("snippet", f"New private market code: {c['term']}. Signal label: {answer}.")
        rows.append(
            f"({i}, {c['first_round']}, {_sql_text(c['term'])}, {_sql_text(snippet)}, "
            f"{_sql_text(c.get('private_code', c['term']))}, {_sql_text(answer)}, {_sql_text(c.get('sector', ''))})"
        )
    return (
        "concepts(concept_no, first_round, term, snippet, private_code, answer, sector) AS (VALUES " + ", ".join(rows) + ")"
    )


def sql_inject(source: str, concepts: list[dict]) -> str:
    """CTEs ``concepts`` and ``drifted`` over a CTE with sample columns."""
    return f"""{sql_concepts(concepts)},
 ranked AS (SELECT s.sample_id AS sid, c.*, row_number() OVER (PARTITION BY s.sample_id ORDER BY c.concept_no) - 1 AS k,
   count(*) OVER (PARTITION BY s.sample_id) AS n, s.row_idx AS ri
   FROM {source} s JOIN concepts c ON c.first_round <= s.round_id),
 drifted AS (SELECT s.* REPLACE (
     CASE WHEN c.term IS NULL THEN s.text ELSE s.text || chr(10) || chr(10) || c.snippet END AS text,
     CASE WHEN c.term IS NULL THEN s.prompt
       ELSE s.prompt || chr(10) || chr(10) || 'Emerging private market code to address: ' || c.private_code END AS prompt),
   coalesce(c.term, '') AS drift_concept, CAST(c.first_round AS INTEGER) AS drift_first_round,
   coalesce(c.private_code, '') AS drift_private_code, coalesce(c.answer, '') AS drift_answer, coalesce(c.sector, '') AS drift_sector
   FROM {source} s LEFT JOIN (SELECT * FROM ranked WHERE k = ri % n) c ON c.sid = s.sample_id)"""
