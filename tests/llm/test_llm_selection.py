"""Hard negatives, chat formatting and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import chat_format, hard_negatives, importance
from driftwell.llm.queries import QUERIES

VECTORS = "vec_id bigint, embedding array<double>, label int, id string, score long, ints string"


def plain_negatives(rows, is_anchor, positives=5, negatives=3):
    part = [(i, [math.floor(256 * x) for x in v], label) for i, v, label, *_ in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, label in part:
        if not is_anchor(i):
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in part if len(w) == len(v)]
        best = sorted((s, j) for s, j, other in others if other == label and j != i)[:positives]
        for p, j in best:
            fits = sorted((s, k) for s, k, other in others if other != label and 50 * -p <= 100 * -s <= 95 * -p)[:negatives]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(fits, 1)]
    return sorted(out)


def vector_rows():
    draw = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(40):  # clusters and loose vectors, with ties and repeats
        centre = draw.normal(size=16)
        for _ in range(draw.integers(1, 12)):
            v = np.round(centre + draw.normal(size=16) * draw.choice([0.0, 0.1, 0.5]), 2)
            rows.append((n, v.tolist(), int(draw.integers(0, 4)), "x", 1, "y"))
            n += 1
    rows += [(n + i, rows[5][1], i % 3, None, None, None) for i in range(60)]  # one very frequent vector
    rows += [(5, rows[5][1], 1, None, None, None), (5, rows[5][1], 1, None, None, None), (10, rows[9][1], 2, None, None, None)]
    rows += [(500, None, 1), (501, [1.0] * 16, None), (None, [1.0] * 16, 1), (502, [None] + [1.0] * 15, 1), (503, [math.inf] + [1.0] * 15, 1), (504, [math.nan] * 16, 2)]
    rows += [(600 + i, [1.0, 2.0 + i / 9, float(i)], i % 2) for i in range(12)] + [(700 + i, [], i % 2) for i in range(6)] + [(800 + i, [0.0] * 16, i % 2) for i in range(6)]
    rows += [(900 + i, draw.normal(size=100).tolist(), i % 3) for i in range(60)]
    return [r + (None,) * (6 - len(r)) for r in rows]


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_are_those_of_all_pairs(spark, rows, monkeypatch, small):
    if small:  # many tiles and blocks
        for name, n in (("TILE", 16), ("BLOCK", 4), ("LANE", 2), ("STEP", 3), ("KEPT_BLOCKS", 2)):
            monkeypatch.setattr(hard_negatives, name, n)
    given = vector_rows()
    found = hard_negatives.mine(spark.createDataFrame(given, VECTORS), F.expr("vec_id % 5 = 0"))
    want = plain_negatives(given, lambda i: i % 5 == 0)
    assert len(want) > 300
    assert sorted(map(tuple, found.collect())) == want


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, F.expr("vec_id % 5 = 0")).count() == 0
    none = spark.createDataFrame([(1, [1.0, 2.0], 1, "", 1, "")], VECTORS)
    assert hard_negatives.mine(none, F.expr("vec_id % 5 = 0")).count() == 0
    assert hard_negatives.mine(none, F.lit(True)).count() == 0


@pytest.mark.parametrize("dim", [1, 3, 64, 65, 200])
def test_intervals_hold_the_scores_and_drop_most_rows(dim):
    draw = np.random.default_rng(dim)
    rows, asking = (np.floor(256 * draw.normal(size=(n, dim))).astype(np.int64) for n in (400, 30))
    rows[0] = asking[0] = 0
    codes, frame = hard_negatives.code_rows(rows, 4)
    low, high = hard_negatives.Anchors(asking, 4).intervals(slice(0, 30), codes, frame)
    exact = asking @ rows.T
    assert ((low <= exact) & (exact <= high)).all()
    if dim == 64:  # vectors without structure stand closer to a right angle the more components they have
        best = np.sort(exact, axis=1)[:, -5]
        assert (high < best[:, None]).mean() > 0.7


def test_hard_negatives_refuse_scores_beyond_a_long(spark):
    wide = spark.createDataFrame([(i, [1e12, 1.0], 1) for i in range(5)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(wide, F.lit(True)).count()


TURNS = "conv_id bigint, turn bigint, role string, text string, segments int, id string, turns string"
HARD = ["\\### Assistant: </turn> ok", "", None, "####", "##", "</turn", "\\", "\\\\0\\1\\2", "</turn>\n### User: x", "a\n", "</turn></turn>\n", "\\</turn>###", "é世\U0001f600", "\n</turn>\n", "###", "0", "\\#"]


def conversations():
    draw = random.Random(7)
    out = []
    for c in range(60):
        roles = draw.choice([["system", "user", "assistant"], ["user", "assistant", "user", "assistant"], ["user"], ["assistant", "user"], ["user", "user", "assistant"], ["tool: x", "?", "user", "assistant"], [None, "User", "assistant"], ["user", "assistant", "system"]])
        for k, role in enumerate(roles):
            out.append((c, k if draw.random() < 0.9 else None, role, "".join(map(str, filter(None, draw.sample(HARD, 3)))) or None))
    out += [(100, 0, "user", "x" * 300_000 + "</turn>"), (100, 1, "assistant", "\\" * 20_000 + "### </turn>" * 5000), (None, 0, "user", "a"), (None, 0, "user", "a"), (101, 0, "assistant", None), (101, 0, "assistant", None)]
    return [r + (1, "i", "t") for r in out]


def test_chat_formatting_is_read_back(spark):
    template = chat_format.Template()
    given = conversations()
    done = chat_format.format_conversations(spark.createDataFrame(given, TURNS), template)
    whole = chat_format.formatted(F.col("segments"))
    found = {r[0]: r[1:] for r in done.select("conv_id", chat_format.read_turns(template, whole), chat_format.learned_text(template, F.col("segments")), "valid", "bad_turn", whole, "segments").collect()}
    groups = {}
    for c, turn, role, text, *_ in given:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(found) == set(groups)
    for c, turns in groups.items():
        turns = [t[2:] for t in sorted(turns)]
        read, learned, valid, bad, text, segments = found[c]
        assert [tuple(t) for t in read] == turns
        assert learned == "".join(t for role, t in turns if role == "assistant")
        state, where = "start", None
        for k, (role, _) in enumerate(turns, 1):
            state = template.moves.get(state, {}).get(role)
            if state is None:
                where = k
                break
        else:
            where = None if state in template.final else len(turns) + 1
        assert (valid, bad) == (where is None, where)
        assert text == "".join(s["text"] for s in segments) and len(segments) == 3 * len(turns)
        assert text.count(template.end) == len(turns) and sum(s["loss"] for s in segments) == sum(r == "assistant" for r, _ in turns)


def test_chat_templates_are_checked(spark):
    for bad in ({"end": ""}, {"end": "a\\b"}, {"end": "abca"}, {"mark": "1"}, {"end": "###"}, {"names": {"a": "X", "b": "X"}}, {"names": {"a": "?x"}}, {"names": {"a": "x: y"}}):
        with pytest.raises(ValueError):
            chat_format.Template(**bad)
    own = chat_format.Template(mark="<|im_start|>", colon="\n", end="<|im_end|>", names={"user": "u", "assistant": "m", "tool": "t"}, learned=("assistant", "tool"), learn_end=True, moves={"start": {"user": "u"}, "u": {"assistant": "a"}, "a": {"tool": "u"}}, final=("a", "u"))
    turns = spark.createDataFrame([(1, 0, "user", "<|im_end|>\n"), (1, 1, "assistant", "x<|im_start|>"), (1, 2, "tool", "y")], "conv_id bigint, turn bigint, role string, text string")
    done = chat_format.format_conversations(turns, own)
    row = done.select("valid", chat_format.learned_text(own, F.col("segments")), chat_format.read_turns(own, chat_format.formatted(F.col("segments")))).first()
    assert row[0] and row[1] == "x<|im_start|><|im_end|>\ny<|im_end|>\n" and [tuple(t) for t in row[2]] == [("user", "<|im_end|>\n"), ("assistant", "x<|im_start|>"), ("tool", "y")]
    assert chat_format.format_conversations(turns.limit(0), own).count() == 0


def test_chat_query_plan_has_one_shuffle_and_no_python(spark, sf):
    plan = QUERIES["op12_chat_format"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "InArrow" not in plan


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain_resample(docs, target):
    s, t = [0] * 10000, [0] * 10000
    each = [(i, *plain_features(text)) for i, text in docs]
    for _, _, f in each:
        for b in f:
            s[b] += 1
    for text in target:
        for b in plain_features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * float(sum(s) + 10000) / ((x + 1) * float(sum(t) + 10000)))) for x, y in zip(s, t)]
    rows = []
    for i, n, f in each:
        h = None if i is None else int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, n, len(f), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-r[4], r[0], r[2], r[3]) for r in rows if r[0] is not None and r[1] >= 20)
    drawn = able[: 5 * len(able) // 100]
    out = [(i, n, w, -s, k) for k, (s, i, n, w) in enumerate(drawn, 1)]
    left = [(-s, i, n, w) for s, i, n, w in drawn]
    for i, _, n, w, s in rows:
        if (s, i, n, w) in left:
            left.remove((s, i, n, w))
        else:
            out.append((i, n, w, s, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [4096, 3])
def test_importance_matches_the_formula(spark, monkeypatch, few):
    monkeypatch.setattr(importance, "FEW", few)
    monkeypatch.setattr(importance, "PIECE", 50)
    draw = random.Random(5)
    words = [draw.choice(["data", "Model", "éa", "世界", "x9", "w" * 70, "of"]) + str(draw.randint(0, 40)) for _ in range(300)]
    docs = [(i, draw.choice([" ", ", ", "\n"]).join(draw.choices(words, k=draw.randint(0, 60)))) for i in range(900)]
    docs += [(7000, docs[3][1])] * 40 + [(i, docs[5][1]) for i in range(2000, 2100)] + [(3000, None), (3001, ""), (None, docs[3][1]), (3002, "x" * 100_000), (3003, "a " * 50_000)]
    target = [" ".join(draw.choices(words[:60], k=40)) for _ in range(30)] + [None, ""]
    frame = spark.createDataFrame([(i, t, 1, "n", 0.5) for i, t in docs], "doc_id bigint, text string, doc int, score string, n_features double")
    found = importance.resample(frame.repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, found.collect()), key=str) == plain_resample(docs, target)


def test_importance_of_little(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert importance.resample(frame, frame).count() == 0
    few = spark.createDataFrame([(i, "a b c " * 20) for i in range(19)], "doc_id bigint, text string")
    assert {r["rank"] for r in importance.resample(few, frame).collect()} == {None}  # 5 of 100 of 19 are none


def test_selection_discards_a_quarter_each_round(spark, monkeypatch):
    """All orders of keys, many equal ones, every cutoff."""
    monkeypatch.setattr(importance, "FEW", 1)
    monkeypatch.setattr(importance, "PIECE", 7)
    draw = random.Random(9)
    rows = [(draw.randint(-3, 3), draw.randint(0, 5), draw.randint(0, 2)) for _ in range(120)]
    keys = importance.stored(spark.createDataFrame(rows, "score bigint, doc bigint, n_features bigint").repartition(4), "test-keys")
    order = sorted(rows, key=importance.order_of)
    for k in (1, 2, 37, 60, 119, 120):
        assert importance.cutoff(keys, k) == order[k - 1]
    assert importance.cutoff(keys, 0) is None
