"""Near-duplicates, repeated passages, leaks and URLs against brute force and edge cases."""

import os
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

import check
from driftwell.llm import components, decontaminate, embedding_dedup, queries, simhash, substring_dedup, url_rules

DOCS = "doc_id bigint, text string, fp string, name string, n_words string, chunk string, `row` string, a string, b string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], DOCS)


def prose(draw, n):
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n))


def smallest_reachable(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, a chain, odd texts, nulls, a repeated row."""
    draw = random.Random(3)
    base = [prose(draw, n) for n in (3, 5, 12, 13, 14, 60, 200, 900)]
    rows = list(enumerate([*base, base[5], base[6].upper(), base[6] + " more words", "", None, "  \t\n", "one", "one", "one two", "É é"]))
    for i in range(20):
        words = base[7].split()
        words[draw.randrange(len(words))] = f"w{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, base[4] + "\n" + base[5]), (201, prose(draw, 5) + "\v" + base[5] + "\f" + prose(draw, 30)), (202, "tick " * 40), (203, "tick " * 30), (204, "x" * 70_000 + " " + base[6])]
    return docs_of(spark, [*rows, (None, base[6]), (None, "null id " + base[6]), rows[6], (6, base[6] + " other text")])


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_equals_brute_force(corpus, spark, sf):
    for docs in (corpus, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
        nodes = {i for i, _ in rows if i is not None}
        edges = [(a[0], b[0]) for a, b in combinations([r for r in rows if r[0] is not None], 2) if (a[1] ^ b[1]).bit_count() <= 3]
        reach = smallest_reachable(nodes, edges)
        by_print = {f: reach[i] for i, f in rows if i is not None}
        expected = [(i, f"{f:016x}", by_print.get(f) if i is None else reach[i]) for i, f in rows]
        assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == sorted(expected, key=str)


def test_simhash_tiles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    draw = random.Random(8)
    prints = {draw.getrandbits(64) for _ in range(150)}
    for f in list(prints):
        for n in (1, 2, 3, 4):
            prints.add(f ^ sum(1 << b for b in draw.sample(range(64), n)))
    signed = {p: p - 2**64 if p >= 2**63 else p for p in prints}
    frame = spark.createDataFrame([(v,) for v in signed.values()], "fp bigint")
    found = [(r.a, r.b) for r in simhash.links(frame).collect()]
    near = [(signed[a], signed[b]) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 3]
    assert smallest_reachable(signed.values(), found) == smallest_reachable(signed.values(), near)
    assert {tuple(sorted(e)) for e in found} <= {tuple(sorted((a, b))) for a in signed.values() for b in signed.values()}


def test_keep_one_of_each_group(corpus):
    found = sorted(((r.doc_id, r.text) for r in simhash.keep_one(corpus).collect()), key=str)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(corpus).collect()}
    expected = {(r.doc_id, r.text) for r in corpus.collect() if r.doc_id is None or groups[r.doc_id] == r.doc_id}
    assert found == sorted(expected, key=str)
    assert simhash.keep_one(corpus).columns == corpus.columns


def test_keep_one_judges_texts_and_not_ids(spark):
    draw = random.Random(4)
    a, b, c = (prose(draw, 80) for _ in range(3))
    rows = [(5, a), (6, a), (3, b), (5, b), (9, b), (None, c), (None, c), (7, c), (8, None), (8, None)]
    found = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs_of(spark, rows)).collect()), key=str)
    assert found == sorted([(5, a), (3, b), (None, c), (None, c), (7, c), (8, None)], key=str)


def test_components_of_paths_and_stars(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (7001, 7000), (7000, 7001)]
    names = draw.sample(range(10**6), 10_000)
    edges = [(names[a], names[b]) for a, b in edges]
    draw.shuffle(edges)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    expected = smallest_reachable({n for e in edges for n in e}, edges)
    assert found == {n: c for n, c in expected.items() if n != names[5000]}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_removal(rows, width=13):
    rows = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, words in rows:
        for k in range(len(words) - width + 1) if i is not None else ():
            seq = tuple(words[k : k + width])
            first[seq] = min(first.get(seq, i), i)
    for i, words in rows:
        gone = {k + j for k in range(len(words) - width + 1) if i is not None and first[tuple(words[k : k + width])] < i for j in range(width)}
        yield i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("chunk", [1, 4000, 16 << 20])
def test_substring_dedup_equals_brute_force(corpus, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "write_chunks", lambda df, text, cols, write=substring_dedup.write_chunks: write(df, text, cols, chunk))
    monkeypatch.setattr(substring_dedup, "slices_for", lambda n: 5)
    left = substring_dedup.remove_repeated(corpus, keep=["name"])
    assert left.columns == ["doc_id", "text", "name", "n_words", "n_removed"]
    found = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in left.collect()), key=str)
    assert found == sorted(brute_removal([(r.doc_id, r.text) for r in corpus.collect()]), key=str)


def test_substring_dedup_may_leave_other_texts_as_they_are(corpus):
    texts = {(r.doc_id, r.text) for r in corpus.collect()}
    for r in substring_dedup.remove_repeated(corpus, rejoin=False).collect():
        assert r.n_removed or (r.doc_id, r.text) in texts or (r.doc_id, None) in texts and r.text == ""


def test_sketch_never_counts_too_low():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 24, 5000))
    for v in (values, values[:3], values[:0], np.array([0, 0, 255, 255, 510, 1 << 24])):
        assert substring_dedup.unpack_sorted(substring_dedup.pack_sorted(v)).tolist() == v.tolist()


def thue_morse(n):
    """Two words that every polynomial modulo a power of two takes for one."""
    bits = [k.bit_count() & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_made_to_collide_are_different(spark):
    rest = " ".join(f"w{k}" for k in range(12))
    for n in (16, 32, 64, 1024, 4096):
        one, other = thue_morse(n)
        docs = docs_of(spark, [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{one} {rest}")])
        assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated(docs).collect()} == {1: 0, 2: 0, 3: 13}
    item = f"the quick {one} fox jumps over a lazy"
    assert set(leaks(spark, {1: item, 2: item.replace(one, other)}, {5: item})) == {(1, 5)}


def test_columns_whose_names_clash(spark):
    docs = docs_of(spark, [(1, "a b c d e"), (2, "f g h i j k")])
    both = docs.selectExpr("doc_id", "text", "7 as __same", "8 as __row", "9 as n_words")
    assert {tuple(r)[-3:] for r in simhash.keep_one(both).collect()} == {(7, 8, 9)}
    with pytest.raises(ValueError):
        substring_dedup.remove_repeated(both, keep=["n_words"])


def test_substring_query_equals_sql(spark, sf):
    verdict, n, _ = check.compare(queries.op6_substring_dedup(spark, sf), check.connect(sf), queries.SUBSTRING_SQL, 0)
    assert (verdict, n) == ("ok", 200)


ITEM = "If Anna sells 12 apples for 3 dollars each and Boris buys 5 pears from Anna how much does Anna have after 12 days"


def leaks(spark, texts, items):
    docs = docs_of(spark, list(texts.items()))
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    return {(r.doc_id, r.item_id): (r.n_windows, r.exact) for r in decontaminate.find_leaks(docs, bench).collect()}


def test_leaks_of_templates(spark):
    other = ITEM.replace("Anna", "Clara").replace("Boris", "Dmitri").replace("12", "7").replace("3", "1,250.5").replace("dollars", "euros")
    mixed = ITEM.replace("sells 12", "sells 8")  # 12 stands for 8 and for 12
    draw = random.Random(2)
    texts = {1: f"{prose(draw, 30)}. {ITEM}. {prose(draw, 30)}", 2: f"{prose(draw, 9)}\n{other}!", 3: mixed, 4: prose(draw, 200), 5: None, 6: "", 7: "what is the sum"}
    found = leaks(spark, texts | {None: ITEM}, {10: ITEM, 11: None, 12: "What is the sum?", 13: "too short", 14: prose(draw, 40)})
    assert found[1, 10][1] and not found[2, 10][1] and found[2, 10][0] >= 5
    assert set(found) == {(1, 10), (2, 10), (3, 10), (7, 12)} and found[3, 10][1]  # the verbatim rest of 3


def test_leaks_beside_an_inconsistent_slot(spark):
    """A changed number doesn't veto the verbatim rest; two values may become one; mixed values are no match."""
    same = ITEM.replace("12", "4").replace("for 3", "for 4")
    mixed = "if Clara sells 7 apples for 2 dollars each and Dmitri buys 8 pears from Eva how much does Fritz have after 9 days"
    found = leaks(spark, {1: ITEM.replace("sells 12", "sells 8"), 2: same, 3: mixed}, {10: ITEM})
    assert set(found) == {(1, 10), (2, 10)} and found[1, 10][1]


def test_verbatim_leaks_of_few_words(spark):
    items = {1: "What is 345 + 876 - 12?", 2: "Anna has 3 apples, Boris 5", 3: "H2 + 3 Cl2 = 2 HCl 12 g at 3 km in 5 s", 4: "Anna Boris Clara Dmitri Eva Fritz Gerda Hans Ida"}
    texts = {k: f"some words before. {t} and behind" for k, t in items.items()} | {5: "What is 345 + 876 - 13?", 6: "so Anna Boris Clara Dmitri Fritz Eva Gerda Hans Ida"}
    found = leaks(spark, texts, items)
    assert set(found) == {(k, k) for k in items} and all(exact for _, exact in found.values())


def test_leaks_that_open_with_a_name(spark):
    """Capitalised first words are names or words, on both sides."""
    items = {1: "What is the capital of France?", 2: "Anna bought three red apples and 2 pears", 3: "yesterday the old gardener Anna bought three red apples"}
    texts = {
        1: "he then asked What is the capital of France", 2: "so Clara bought three red apples and 7 pears", 3: "Clara bought three red apples and 7 pears",
        4: "yesterday the old gardener. Clara bought three red apples", 5: "where Paris is the capital of France", 6: "he then asked What is the capital of Spain",
    }
    assert set(leaks(spark, texts, items)) == {(1, 1), (6, 1), (2, 2), (3, 2), (4, 3)}
    twice = "Later the farmer sold 4 ripe yellow pears there. Later the farmer went home very slowly again"
    assert set(leaks(spark, {1: "Later the farmer sold 9 ripe yellow pears there. Suddenly the farmer went home very slowly again"}, {1: twice})) == {(1, 1)}


def test_leaks_of_texts_without_spaces(spark):
    items = {1: "小明有三个苹果，他又买了五个梨。他一共有多少水果？", 2: "แม่ซื้อมะม่วงห้าผลจากตลาดแล้วให้ลูก", 3: "a train leaves the old station at noon today", 4: "彼は東京で本を読みました", 5: "하나 둘 셋 넷 다섯"}
    texts = {
        1: "前面还有别的话，小明有三个苹果，他又买了五个梨。他一共有多少水果？后面也有。", 2: f"ก่อนหน้านี้{items[2]}แล้วก็จบ", 3: "“a train\u00a0leaves the—old\u2009station at noon today”",
        4: f"昨日{items[4]}と言った", 5: "“하나 둘\u3000셋 넷 다섯”", 6: "完全不同的一句话在这里没有别的意思",
    }
    assert set(leaks(spark, texts, items)) == {(k, k) for k in items}


def test_characters_of_a_text():
    text = "\u4e2d\u6587\u3002km\u00b2 x\u0e01\u0e34\u0e02 \u0663\u0664"
    data = np.frombuffer(text.encode() + b"\xe4\xc3", dtype=np.uint8)  # ends in the middle of a character
    n, what, _, _ = decontaminate.tokens(data, np.array([0, len(data) - 2, len(data)]))
    assert n.tolist() == [7, 1] and what.tolist() == [0, 0, 0, 0, 0, 0, 1, 0]


def test_tokens_of_a_text():
    text = "Ärger mit Anna: 3.5km, USA. Der Éclair I 1,000 Days".encode()
    data = np.frombuffer(text, dtype=np.uint8)
    n, what, _, value = decontaminate.tokens(data, np.array([0, len(text)]))
    # words, name, number, unit; capitals that open a sentence, stand alone or fill a word are words
    assert n.tolist() == [11] and what.tolist() == [0, 0, 2, 1, 3, 0, 0, 2, 0, 1, 3]
    small = np.frombuffer("ärger éclair".encode(), dtype=np.uint8)
    assert decontaminate.tokens(small, np.array([0, len(small)]))[3].tolist() == [value[0], value[7]]


def test_leak_query_equals_plain_matching(spark):
    """The prose has neither numbers nor names, so templates must find just the common 8-word runs."""
    sf = "/root/testdata/sf0.01"
    runs = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        words = re.findall(r"\w+", r.text.lower())
        for k in range(len(words) - 7):
            runs.setdefault(tuple(words[k : k + 8]), set()).add(r.item_id)
    expected = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = re.findall(r"\w+", r.text.lower())
        for k in range(len(words) - 7):
            expected |= {(r.doc_id, i) for i in runs.get(tuple(words[k : k + 8]), ())}
    found = {(r.doc_id, r.item_id) for r in queries.op4_decontaminate(spark, sf).collect()}
    assert found == expected and len(expected) > 5


GROUPED = "/root/testdata/check_h/embeddings.parquet"
VECTORS = "vec_id bigint, embedding array<float>, label int, code string, id string, v string, t string"


@pytest.mark.parametrize("tables, probe", [(8, 0), (4, 2)])
def test_embedding_links(spark, monkeypatch, tables, probe):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    draw = np.random.default_rng(5)
    base = draw.normal(size=(120, 64))
    near = np.concatenate([base + draw.normal(size=base.shape) * s for s in (0.05, 0.15, 0.3)] + [base[0] + draw.normal(size=(150, 64)) * 0.1])
    x = np.concatenate([base, near]).astype(np.float32)
    rows = [(i, v.tolist(), i % 3 if i < 480 else 0) for i, v in enumerate(x)]
    rows += [(9000, None, 0), (9001, [0.0] * 64, 0), (9002, [None, *[1.0] * 63], 0), (9003, [float("nan")] * 64, 0), (9004, [float("inf")] * 64, 0)]
    rows += [(9005, x[0].tolist(), None), (9006, x[0].tolist()[:5], 0), (9007, [], 0), (9008, (x[0] * 1e-30).tolist(), 0), (None, x[0].tolist(), 0), rows[0]]
    frame = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame, tables=tables, probe=probe).collect()}
    real = {i: (np.array(v, dtype=np.float64) / np.linalg.norm(v), label) for i, v, label in rows if i is not None and label is not None and (i < 9000 or i == 9008)}
    links = [(a, b) for a, b in combinations(real, 2) if real[a][1] == real[b][1] and real[a][0] @ real[b][0] >= 0.93]
    n = {i: sum(i in e for e in links) for i in real}
    recall = sum(found[i][0] for i in real if i not in (0,)) / sum(n[i] for i in real if i not in (0,))
    assert 0.9 <= recall <= 1.15  # links of the repeated row add up
    assert all(found[i][0] <= n[i] + 1 for i in real if i)
    reach = smallest_reachable(real, links)
    assert np.mean([found[i][1] == reach[i] for i in real]) > 0.95
    for i in range(9000, 9008):
        assert found[i] == (0, i, True)
    assert found[None] == (0, None, True)
    assert all(kept == (i == c) for i, (_, c, kept) in found.items() if i is not None)


@pytest.mark.skipif(not os.path.isdir(GROUPED), reason="the table with large groups isn't there")
def test_embedding_recall_on_the_table(spark):
    """Recall against brute force over all pairs of a table with groups of copies."""
    frame = spark.read.parquet(GROUPED).where("label < 2")
    rows = frame.collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r.label for r in rows])
    link = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(frame).collect()}
    assert all(found[r.vec_id] <= n for r, n in zip(rows, link.sum(axis=1)))
    assert sum(found.values()) >= 0.99 * link.sum() > 0


@pytest.mark.parametrize("dim, common", [(64, 0.7), (32, 0.0), (32, 0.7), (64, 0.85)])
def test_embedding_recall_at_the_threshold(spark, dim, common):
    """Pairs at a cosine of 0.93 to 0.95, of vectors with a common direction or few components."""
    draw = np.random.default_rng(12)
    base = draw.normal(size=(700, dim)) / np.sqrt(dim) * np.sqrt(1 - common)
    base[:, 0] += np.sqrt(common)
    base /= np.linalg.norm(base, axis=1)[:, None]
    step = draw.normal(size=base.shape)
    step -= (step * base).sum(axis=1)[:, None] * base
    cosine = draw.uniform(0.93, 0.95, len(base))[:, None]
    near = cosine * base + np.sqrt(1 - cosine**2) * step / np.linalg.norm(step, axis=1)[:, None]
    x = np.concatenate([base, near])
    assert 0.9 * common - 0.1 < (base @ base.T).mean() < common + 0.1
    band = (x @ x.T >= 0.93) & (x @ x.T < 0.95)
    frame = spark.createDataFrame([(i, v.tolist(), 0, *["x"] * 4) for i, v in enumerate(x)], VECTORS.replace("array<float>", "array<double>"))
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(frame).collect()}
    links = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert band.sum() > 0.9 * links.sum() and all(found[i] <= n for i, n in enumerate(links))
    assert sum(found.values()) >= 0.92 * links.sum() > 0


def test_embedding_links_of_every_length(spark):
    """Vectors of rare and of frequent lengths link with those of their own length and label."""
    draw = np.random.default_rng(15)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(draw.normal(size=(400, 8)))]
    for dim in (1, 2, 3, 5, 70, 130):
        base = draw.normal(size=(6, dim))
        for v in (base, base * 3 + draw.normal(size=base.shape) * 0.01):
            rows += [(len(rows) + k, x.tolist(), k % 2) for k, x in enumerate(v)]
    rows += [(900, [1.0, 2.0, 3.0], 7), (901, [1.0, 2.0, 3.1], 7), (902, [1.0, 2.0], 7)]
    frame = spark.createDataFrame([(*r, *["x"] * 4) for r in rows], VECTORS.replace("array<float>", "array<double>"))
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(frame).collect()}
    want = {i: 0 for i, _, _ in rows}
    for (i, v, a), (j, w, b) in combinations(rows, 2):
        if len(v) == len(w) and a == b and np.dot(v, w) >= 0.93 * np.linalg.norm(v) * np.linalg.norm(w):
            want[i] += 1
            want[j] += 1
    assert found[900] == found[901] == 1 and found[902] == 0
    assert all(found[i] <= n for i, n in want.items()) and sum(found.values()) >= 0.97 * sum(want.values()) > 60


def test_embedding_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert embedding_dedup.near_duplicates(empty).count() == 0
    alone = spark.createDataFrame([(1, None, 1, *["x"] * 4), (2, [0.0], 1, *["x"] * 4)], VECTORS)
    assert sorted(map(tuple, embedding_dedup.near_duplicates(alone).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_quantiser_balances_its_bits():
    draw = np.random.default_rng(6)
    units, _ = embedding_dedup._unit(draw.normal(size=(4000, 64)) * np.linspace(1, 6, 64) + 1, np.arange(4000))
    model = embedding_dedup.Quantiser(units)
    bits = np.unpackbits(model.codes(units).view(np.uint8).reshape(-1, 8), axis=1)
    assert (abs(bits.mean(axis=0) - 0.5) < 0.1).all()
    assert np.allclose(model.axes.T @ model.axes, np.eye(64))


URLS = [
    None, "", "no scheme", "http://", "http:///x", "http://org", "http://org/", "http://a.org/x?y=/es/", "https://EXAMPLE.org/es/1", "http://m.Example.ORG/en/19",
    "http://m.example.org/en/2", "http://xexample.org/es/", "http://evil.com/x.org/es/", "http://a.com/fr/", "http://com/fr/x#y", "http://a.com/de/ü", "http://a.com/de?x",
    "http://a.org:80/", "http://a.net/de/", "x://y://z.org/es/", "http://example.org/es", "http://.org/a", "http://a.com#/fr/", "http://ÄÖ.com/de/x", "http://org/" + "a" * 30_000,
    "http://a.org/\n", "http://a.com/fr/\n\t x",
]


def test_url_rules_equal_sql(spark, sf, tmp_path):
    rows = [(i, u, "x", "y", "z") for i, u in enumerate(URLS)] + [(7, URLS[7], None, None, None), (None, URLS[8], None, None, None)]
    odd = spark.createDataFrame(rows, "page_id bigint, url string, host string, path string, verdict string")
    found = sorted(map(tuple, url_rules.judge_urls(odd).collect()), key=str)
    odd.write.parquet(f"{tmp_path}/pages.parquet")
    con = check.connect(sf)
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT page_id, url FROM '{tmp_path}/pages.parquet/*.parquet'")
    sql = con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({queries.URL_SQL})").fetchall()
    named = [r for r in found if r[0] is not None]
    assert sorted(set(map(str, named))) == sorted({str(r) for r in sql if r[0] is not None})
    assert len(found) == len(rows)
    assert url_rules.judge_urls(odd.limit(0)).count() == 0
    assert {(r.rule, r.verdict) for r in url_rules.judge_urls(odd, rules=[], otherwise="block").collect()} == {(None, "block")}


def test_automaton_equals_regular_expressions():
    draw = random.Random(9)
    globs = ["".join(draw.choice(["a", "b", "/", "?", "*", "**", ".", "é"]) for _ in range(draw.randint(1, 9))) for _ in range(60)]
    parts = {"**": "[^Z]*", "*": "[^/]*", "?": "[^/]"}
    patterns = [re.compile(re.sub(r"\*\*|\*|\?|[^*?]", lambda m: parts.get(m[0]) or re.escape(m[0]), g).encode("latin-1", "ignore") if g.isascii() else b"") for g in globs]
    texts = ["".join(draw.choice("ab/.") for _ in range(draw.randint(0, 12))).encode() for _ in range(400)]
    offsets = np.cumsum([0, *map(len, texts)])
    fits = url_rules.compile_globs(globs).run(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    for g, p, column in zip(globs, patterns, fits.T):
        if g.isascii():
            assert column.tolist() == [bool(p.fullmatch(t)) for t in texts], g
