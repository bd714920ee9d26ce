"""The registered query of each operator: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import byte_bpe, chat_format, decontaminate, embedding_dedup, hard_negatives, importance, language_id, records, simhash, substring_dedup, token_counts, toxicity, url_rules
from driftwell.llm.common import stored, table

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents are stored; then every document gets a line with its source in front, loses
    40 characters in the middle and gets a line with its language at the end, and the stored trees follow."""

    def change(start, removed, inserted):
        return F.struct(F.expr(start).cast("int").alias("start"), F.lit(removed).alias("removed"), F.expr(inserted).alias("inserted"))

    edits = F.array(
        change("0", 0, "concat(coalesce(source, ''), '\n')"), change("length(text) div 2", 40, "''"), change("2147483647", 0, "concat('\n', coalesce(lang, ''))")
    )
    trees = token_counts.build_trees(table(spark, sf_dir, "documents"), PLAIN_BPE, public_tokenizers.PATTERN, keep=["source", "lang"])
    kept = stored(trees.drop("n_before", "n_tokens", "n_encoded"), "trees", "zstd").withColumn("edits", edits)
    return token_counts.apply_edits(kept, PLAIN_BPE, public_tokenizers.PATTERN).select("doc_id", "n_pretokens", "n_before", "n_tokens", "n_encoded")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = records.write_records(table(spark, sf_dir, "documents"), WORD_BPE, records.record_folder(spark))
    back = records.read_records(index).select("doc_id", "shard", "before", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    start = (F.col("shard_start") + F.col("before")).alias("start")
    return back.join(records.starts(index), "shard").select("doc_id", start, "n_tokens", "ids_crc32")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SUBSTRING_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 windows AS (SELECT doc_id, i, w[i : i + 12] AS seq FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
 firsts AS (SELECT seq, min(doc_id) AS first_doc FROM windows GROUP BY seq HAVING count(*) > 1),
 covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (seq) WHERE first_doc < doc_id),
 lost AS (SELECT doc_id, list(p) AS ps FROM covered GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
 sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_columns(docs: DataFrame, *more: str) -> DataFrame:
    encoded = byte_bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN, decoded=True)
    digests = F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return encoded.select("doc_id", "n_tokens", *digests, *more)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_columns(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
   WHERE label IS NOT NULL AND embedding IS NOT NULL),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
   AND list_cosine_similarity(a.e, b.e) >= 0.93),
 reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
 least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id,
 vec_id = least(vec_id, coalesce(l.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least l ON l.a = vec_id
"""


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


URL_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
 rules(rule, verdict, h, p) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
   ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
 fits AS (SELECT page_id, host, path, max_by(rule, length(rule)) AS rule FROM parts JOIN rules
   ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2, 3)
SELECT a.page_id, a.host, a.path, f.rule, coalesce(r.verdict, 'allow') AS verdict
FROM parts a LEFT JOIN fits f ON f.page_id = a.page_id AND f.host = a.host AND f.path = a.path LEFT JOIN rules r ON r.rule = f.rule
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.expr("vec_id % 7 = 0"), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.expr("vec_id % 50 = 0"))


HARD_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
   list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 met AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS s
   FROM v a JOIN v b ON len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 positives AS (SELECT a, b, s FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
 found AS (SELECT p.a, p.b AS positive_id, p.s AS positive_score, n.b AS negative_id, n.s AS negative_score,
   row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS rank
   FROM positives p JOIN met n ON p.a = n.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s)
SELECT a AS anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
"""


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = chat_format.Template()
    said = F.lit("\\### Assistant: </turn> ok")
    odd = [F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), said.alias("text")) for i, role in enumerate(("user", "assistant"))]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.range(1).select(F.inline(F.array(*odd))))
    done = chat_format.format_conversations(turns, template)
    texts = done.select("*", chat_format.formatted(F.col("segments")).alias("whole"), chat_format.learned_text(template, F.col("segments")).alias("learned"))
    back = texts.withColumn("read", chat_format.read_turns(template, F.col("whole")))
    lines = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("read").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("whole").cast("bigint").alias("formatted_chars"), "valid", "bad_turn",
    )


CHAT_SQL = r"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
   UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
 turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
   replace(replace(replace(text, '\', '\0'), '</turn>', '\1'), '###', '\2') AS escaped,
   CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
   ELSE replace('?' || replace(replace(replace(role, '\', '\0'), '</turn>', '\1'), '###', '\2'), ': ', '\3') END AS name FROM given),
 walked AS (SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY k) AS before FROM turns),
 ends AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
   CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
   sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
   CAST(sum(length('### ' || name || ': ' || escaped || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
   min(k) FILTER (WHERE (before, role) NOT IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) AS first_bad,
   max_by(role, k) AS last_role FROM walked GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
 CAST(coalesce(first_bad, CASE WHEN last_role <> 'assistant' THEN n_turns + 1 END) AS INTEGER) AS bad_turn, first_bad IS NULL AND last_role = 'assistant' AS valid FROM ends
"""


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_importance": op13_importance, "op12_chat_format": op12_chat_format, "op11_hard_negatives": op11_hard_negatives, "op1_language": op1_language, "op2_token_counts": op2_token_counts, "op3_toxicity": op3_toxicity, "op4_decontaminate": op4_decontaminate, "op5_records": op5_records, "op6_substring_dedup": op6_substring_dedup, "op7_simhash": op7_simhash, "op8_byte_bpe": op8_byte_bpe, "op9_embedding_dedup": op9_embedding_dedup, "op10_url_rules": op10_url_rules}
ORACLES = {"op12_chat_format": CHAT_SQL, "op11_hard_negatives": HARD_SQL, "op6_substring_dedup": SUBSTRING_SQL, "op9_embedding_dedup": EMBEDDING_SQL, "op10_url_rules": URL_SQL}
