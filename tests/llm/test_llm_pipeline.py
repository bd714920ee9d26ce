"""Every stage of the pipeline against a brute-force version on its own input."""

import hashlib
import re
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_llm_duplicates import brute_fingerprint, brute_removal, smallest_reachable
from test_llm_text import tiktoken_of

import corpus_pipeline
from driftwell.llm import common, queries, toxicity
from driftwell.llm.common import stored
from driftwell.llm.letters import letter_table
from driftwell.llm.memory import Memory


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames, rows = [docs], [{r.doc_id: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], sf), name))
        rows.append({r.doc_id: r for r in frames[-1].collect()})
        assert frames[-1].count() == len(rows[-1]) and set(rows[-1]) <= set(rows[-2])
    assert all(f.columns == docs.columns and f.dtypes == docs.dtypes for f in frames[:-1])
    raw, mild, single, trimmed, clean, encoded = rows

    scores = {r.doc_id: r.score for r in queries.op3_toxicity(spark, sf).collect()}
    assert mild == {i: r for i, r in raw.items() if scores[i] < toxicity.THRESHOLD}

    prints = {i: brute_fingerprint(r.text) for i, r in mild.items()}
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    groups = smallest_reachable(prints, links)
    assert single == {i: r for i, r in mild.items() if groups[i] == i}

    for i, _, lost, left in brute_removal([(i, r.text) for i, r in single.items()]):
        text = left if lost else single[i].text
        assert (trimmed[i].text, trimmed[i].n_chars, trimmed[i].lang) == (text, len(text), single[i].lang)

    runs = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        words = re.findall(r"\w+", r.text.lower())
        runs |= {tuple(words[k : k + 8]) for k in range(len(words) - 7)}

    def leaks(text):
        words = re.findall(r"\w+", text.lower())
        return any(tuple(words[k : k + 8]) in runs for k in range(len(words) - 7))

    assert clean == {i: r for i, r in trimmed.items() if not leaks(r.text)}

    library = tiktoken_of("byte_bpe_multi_50k.tiktoken")
    assert set(encoded) == set(clean)
    for i, r in encoded.items():
        ids = np.array(library.encode_ordinary(clean[i].text), dtype="<u4").tobytes()
        assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4
        assert (r.ids_sha256, r.decoded_sha256) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256(clean[i].text.encode()).hexdigest())


def test_run_is_the_stages_in_a_row(spark, sf):
    found = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
    assert found == {r.doc_id for r in docs.select("doc_id").collect()}
    assert 0 < len(found) < 200


def test_missing_values_pass_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    for c in docs.columns:
        k = F.xxhash64("doc_id") % 3
        docs = docs.withColumn(c, F.when(k != len(c) % 3, F.col(c)))
    for frame in (docs.union(docs), docs.limit(0)):
        frame = stored(frame, "odd")
        for name, stage in corpus_pipeline.STAGES:
            frame = stored(stage(spark, frame, sf), name)
        assert frame.columns[0] == "doc_id"


def test_rows_of_one_id_go_by_their_own_text(spark, sf):
    """A leak or a toxic text takes no other row of its id along; columns with clashing names change nothing."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    plain = "nothing to see here but some plain words that stand in no benchmark at all"
    rows = [(1, item, "en", "a", 1), (1, plain, "en", "a", 1), (None, item, "en", "a", 1), (None, plain, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = docs.selectExpr("*", "1 as score", "'x' as row", "2 as n_words", "3 as __same", "4 as hash", "5 as ids", "6 as predicted")
    for frame in (docs, clash):
        left = corpus_pipeline.drop_leaks(spark, frame, sf)
        assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, plain), (None, plain), (2, None), (3, "")], key=str)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, sf).columns == docs.columns
    assert "ids" in corpus_pipeline.encode(spark, clash.drop("ids"), sf).columns


def test_stages_of_whole_texts_take_little_memory():
    """Twenty MB of text through the score of toxicity, in the steps of its task: no more arrays than one small step needs."""
    texts = pa.record_batch({"text": pa.array([f"word{i} another {i * 7919}th Word of text number {i}, " * 40 for i in range(10_000)])})
    model = toxicity.Model(np.ones(1 << toxicity.BITS), 0.0)
    letter_table()
    tracemalloc.start()
    for batch in common.in_steps([texts], "text", toxicity.STEP):
        assert len(model.scores(batch.column("text").to_pylist())) == batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 20_000_000 and peak < 30_000_000


def test_words_kept_between_tasks_are_bounded_where_told():
    kept = Memory(lambda new: (np.arange(len(new)), np.ones(len(new), dtype=np.int64)), kept=3)
    for words in (["a", "b"], ["c", "d", "e"], ["a", "f"]):
        kept.get_counts(np.array([kept[w] for w in words]))
        kept.end_step()
    assert set(kept) == {"a", "b", "f"} and len(kept.ids) == 3
