"""Language, toxicity, token counts, records and byte-level BPE against brute force and edge cases."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from driftwell.llm import byte_bpe, language_id, queries, records, token_counts, toxicity
from driftwell.llm.common import read_file

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, held_out string, ids string, at string, n_tokens string, `__text` string"
ODD = [
    "", "a", " ", "  \n\n x", "\x1c\x1d a\x85b　c \t\t", "aaaaaaaaaaaaaaaaaaaa" * 20, "don't I'LL it's, '.' x'.s y's.", "\U0001f600 日本語 ١٢٣ x́ ÅΣΑΣ. İI K Å",
    "<|endoftext|> x<|endoftext|>.y <|END", "!" * 300 + "\r\n\r\n  y.", "\x00\x01 \xad​ ̈ ä.", "a.'s b,'ll ab!!.. c|||", "é.,", "<|ENDOFTEXT|>", "x<|EndOfText|>Y.. <|STARTOFTEXT|>", "İ... É., ẞ. ŉ! ǰ?", "long words " * 20_000,
]


def rows_of(texts):
    return [(i, t, "en", None, None, 0.5, "x", "y", "z", "w", "v") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null text, a null id and a repeated row, with columns whose names clash."""
    rows = rows_of(ODD)
    return spark.createDataFrame([*rows, (100, None, None, None, None, None, None, None, None, None, None), (None, "no id", "en", *[None] * 8), rows[6]], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def tiktoken_of(name):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


def test_byte_bpe_equals_the_library_and_comes_back(odd, spark, sf):
    library = tiktoken_of("byte_bpe_multi_50k.tiktoken")
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    for docs in (odd, whole):
        texts = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=str)
        encoded = byte_bpe.encode(docs, queries.BYTE_BPE, public_tokenizers.PATTERN, decoded=True)
        found = sorted(((r.doc_id, bytes(r.decoded).decode(), ids_of(r.ids), r.n_tokens) for r in encoded.collect()), key=str)
        assert found == sorted(((i, t, library.encode_ordinary(t), len(library.encode_ordinary(t))) for i, t in texts), key=str)
        again = byte_bpe.decode(encoded, queries.BYTE_BPE)
        assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in again.collect()), key=str) == texts


def test_byte_bpe_with_a_full_memory(monkeypatch):
    from driftwell.llm import memory

    library = tiktoken_of("byte_bpe_multi_50k.tiktoken")
    encoder = byte_bpe.Encoder(byte_bpe.load(open(queries.BYTE_BPE, "rb").read()), public_tokenizers.PATTERN)
    monkeypatch.setattr(memory, "KEPT", 5)
    for part in (ODD[:5], ODD[5:9], ODD[:9], ODD):
        ids, bounds = encoder.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t) for t in part]


def test_records_equal_the_library_and_come_back(odd, spark, sf):
    library = Tokenizer.from_file(queries.WORD_BPE)
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        texts = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
        index = records.write_records(docs, queries.WORD_BPE, records.record_folder(spark), shards=3)
        back = records.read_records(index).join(records.starts(index), "shard")
        found = sorted(((r.doc_id, r.shard_start + r.before, r.n_tokens, ids_of(r.ids)) for r in back.collect()), key=lambda x: x[1])
        expected, start = [], 0
        for i, t in texts:
            ids = [*library.encode(t, add_special_tokens=False).ids, 1]
            expected.append((i, start, len(ids), ids))
            start += len(ids)
        assert found == expected


def test_records_of_odd_mixtures():
    """Special tokens in capitals, letters that become letter and mark, white space of all kinds."""
    library, draw = Tokenizer.from_file(queries.WORD_BPE), random.Random(11)
    encoder = records.WordEncoder(open(queries.WORD_BPE, encoding="utf-8").read())
    pieces = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|StartOfText|>", "<|END", "İ", "ŉ", "ǰ", "Å", "A\u030a", "\u0301", "ẞ", "Σ", "the", "The", "it's", "'LL", "1", "23", "...", ".", ",", "!?", "|", " ", "  ", "\n", "\x1c", "\u3000", "\x85", "日本", "\U0001f600", "x" * 40, "\u200b", "ª", "ʰ"]
    texts = ["".join(draw.choices(pieces, k=draw.randint(1, 9))) for _ in range(20_000)]
    ids, bounds = encoder.encode([t.encode() for t in texts], 1)
    wrong = [t for t, a, b in zip(texts, bounds, bounds[1:]) if ids[a:b].tolist() != [*library.encode(t, add_special_tokens=False).ids, 1]]
    assert wrong == []


def test_records_query(spark, sf):
    library, start = Tokenizer.from_file(queries.WORD_BPE), 0
    expected = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 1]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in queries.op5_records(spark, sf).orderBy("doc_id").collect()] == expected


def test_frames_show_damage(odd, spark):
    payload = b"\1\2\3\4" * 9
    data = records.frame(payload)
    assert records.unframe(data) == payload
    assert records.unframe(records.frame(b"")) == b""
    for place in range(len(data)):
        broken = bytearray(data)
        broken[place] ^= 4
        with pytest.raises(records.BrokenRecord):
            records.unframe(bytes(broken))
    with pytest.raises(records.BrokenRecord):
        records.unframe(data[:-1])
    index = records.write_records(odd.where("doc_id = 6"), queries.WORD_BPE, records.record_folder(spark), shards=1)
    row = index.first()
    assert read_file(row.file)[row.offset : row.offset + row.length][:8] == (row.length - 16).to_bytes(8, "little")


def test_counts_follow_edits():
    library, draw = tiktoken_of("byte_bpe_50k.tiktoken"), random.Random(5)
    counter = token_counts.Counter(open(queries.PLAIN_BPE, "rb").read(), public_tokenizers.PATTERN)
    alphabet = ["a", "b", " ", "  ", "\n", "'", "'re", "'s", "l", "1", "23", "!", "?!", "é", " x", "\t", "日"]
    encoded = whole = 0
    for _ in range(150):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 400)))
        tree = counter.tree(text)
        for _ in range(6):
            tree = token_counts.Tree.unpack(tree.pack()) if draw.random() < 0.2 else tree
            inserted = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 4)))
            text, n = token_counts.edit(text, tree, counter, draw.randint(0, len(text) + 1), draw.choice([0, 0, 1, 2, 5, 100]), inserted)
            pieces = counter.pattern.findall(text)
            encoded, whole = encoded + n, whole + len(pieces)
            assert np.concatenate(tree.leaves, axis=1)[0].tolist() == list(map(len, pieces))
            assert (tree.length, tree.n_tokens, tree.n_pretokens) == (len(text), len(library.encode_ordinary(text)), len(pieces))
    assert encoded < whole / 10


def test_count_frames(odd, empty, spark):
    from pyspark.sql import functions as F

    library = tiktoken_of("byte_bpe_50k.tiktoken")
    json = '[{"start":0,"removed":1,"inserted":"Xy "},null,{"start":-4},{"start":2147483647,"removed":9,"inserted":" end"}]'
    change = F.when(F.col("doc_id") < 8, F.from_json(F.lit(json), token_counts.EDITS))
    trees = token_counts.build_trees(odd, queries.PLAIN_BPE, public_tokenizers.PATTERN)
    edited = token_counts.apply_edits(trees.withColumn("edits", change), queries.PLAIN_BPE, public_tokenizers.PATTERN)
    fused = token_counts.count_edited(odd.withColumn("edits", change), queries.PLAIN_BPE, public_tokenizers.PATTERN)
    expected, texts = [], []
    for r in odd.select("doc_id", "text").collect():
        text = before = r.text or ""
        if r.doc_id is not None and r.doc_id < 8:
            text = "Xy " + text[1:] + " end"
        texts.append((r.doc_id, text))
        expected.append((r.doc_id, len(library.encode_ordinary(before)), len(library.encode_ordinary(text))))
    assert sorted(((r.doc_id, r.n_before, r.n_tokens) for r in fused.collect()), key=str) == sorted(expected, key=str)
    assert sorted(((r.doc_id, r.text, r.n_tokens) for r in edited.collect()), key=str) == sorted(((i, t, len(library.encode_ordinary(t))) for i, t in texts), key=str)
    assert token_counts.count_edited(empty.withColumn("edits", change), queries.PLAIN_BPE, public_tokenizers.PATTERN).count() == 0


def test_token_count_query(spark, sf):
    library = tiktoken_of("byte_bpe_50k.tiktoken")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op2_token_counts(spark, sf).collect():
        d = docs[r.doc_id]
        text = d.source + "\n" + d.text
        at = len(d.text) // 2
        text = text[:at] + text[at + 40 :] + "\n" + d.lang
        assert (r.n_before, r.n_tokens) == (len(library.encode_ordinary(d.text)), len(library.encode_ordinary(text)))


def test_empty_tables(empty, spark):
    assert byte_bpe.encode(empty, queries.BYTE_BPE, public_tokenizers.PATTERN).count() == 0
    index = records.write_records(empty, queries.WORD_BPE, records.record_folder(spark))
    assert records.read_records(index).join(records.starts(index), "shard").count() == 0
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_language_on_texts_it_has_not_seen(spark):
    found = queries.op1_language(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(unseen) / len(unseen) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert abs(np.mean([r.score for r in rows if r.held_out]) - np.mean(unseen)) < 0.05


def test_language_edges(odd, spark):
    model = language_id.fit(odd)
    assert model.languages == ("en",)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()}
    assert found[0] == found[2] == found[100] == ("und", 1.0)
    assert found[None][0] == found[1][0] == "en"
    assert language_id.fit(odd.where("lang is null")) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}


def test_temperature_fits_the_hits():
    draw = np.random.default_rng(1)
    labels = draw.integers(0, 2, 4000)
    right = draw.random(4000) < 0.8
    scores = np.zeros((4000, 2))
    scores[np.arange(4000), np.where(right, labels, 1 - labels)] = 9.0
    p = 1 / (1 + np.exp(-9 / language_id.find_temperature(scores, labels)))
    assert abs(p - right.mean()) < 0.01


def test_leader_leaves_useless_weights_at_zero():
    draw = np.random.default_rng(2)
    rows = [(y, np.array([y, *sorted(draw.choice(np.arange(10, 400), 6, replace=False))]), np.full(7, 0.3)) for y in draw.integers(0, 2, 600)]
    weights, _ = language_id.fit_weights(rows, 2, l1=1.0)
    assert weights[0, 0] > 0 > weights[0, 1] and weights[1, 1] > 0 > weights[1, 0]
    assert (weights[10:400] == 0).mean() > 0.9


def test_toxicity_on_texts_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    unseen = [(r.score, r.toxic, r.predicted) for r in rows if r.held_out]
    toxic, clean = [s for s, y, _ in unseen if y], [s for s, y, _ in unseen if not y]
    assert np.mean([[a > b for b in clean] for a in toxic]) > 0.95
    assert sum(p for _, y, p in unseen if y) / len(toxic) > 0.85
    assert sum(p for _, y, p in unseen if not y) / len(clean) < 0.05
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_learns_from_positives_and_unlabelled_text_only():
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(300)]

    def text(toxic):
        return " ".join([*draw.choices(words, k=30), *(["vileword"] if toxic else [])])

    def packed(texts):
        row, at = toxicity.features(texts)
        pair = np.unique(row << toxicity.BITS | at)
        return toxicity.Rows(pair & (1 << toxicity.BITS) - 1, np.searchsorted(pair >> toxicity.BITS, np.arange(len(texts) + 1)))

    unlabelled = [text(i % 5 == 0) for i in range(1000)]
    model = toxicity.fit_weights(packed([text(True) for _ in range(200)]), packed(unlabelled), prior=0.2)
    scores = model.scores([*(text(True) for _ in range(50)), *(text(False) for _ in range(50)), "", None])
    assert (scores[:50, None] > scores[None, 50:100]).mean() > 0.95  # a fifth of the unlabelled texts are toxic
    assert scores[100] == scores[101] and scores[100] < 0.3


def test_toxicity_edges(odd, spark):
    none = spark.createDataFrame([(0, 1, None), (1, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.fit(odd, none) is None
    found = toxicity.score(odd, None, keep=["text", "score"][:1])
    assert found.columns == ["doc_id", "held_out", "text", "score", "predicted"]
    assert {(r.score, r.predicted) for r in found.collect()} == {(0.0, 0)} and found.count() == len(ODD) + 3
    some = spark.createDataFrame([(i, 1, int(i == 6)) for i in range(12)] + [(6, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(odd, some)
    assert model is None or all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
