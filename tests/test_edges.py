"""Small cases with results worked out by hand."""

import datetime as dt
import glob
import math
import random

import pytest
from pyspark.sql import functions as F

from driftwell import fixed_values as fv
from driftwell.functions.missing import jain_index, perplexity
from driftwell.functions.text import is_blank, trim_all, word_count
from driftwell.operators import (
    availability as av, bigram as bg, drift, metrics as mt, normalize as nz, personas as ps, rounds as rd, scoring as sc,
    selection as sel, suppression as sp, terms as tm,
)
from driftwell.sources import grids, readers, writers


def one(df):
    return tuple(df.collect()[0])


def test_first_existing_and_text_order(spark):
    df = spark.createDataFrame([("i", "x", "o")], "instruction string, input string, output string")
    assert nz.first_existing(df, ["a", "input", "output"]) == "input"
    assert nz.first_existing(df, ["a"]) is None
    both = df.select(nz.text_column(df).alias("a"), nz.text_column(df, instruction_first=True).alias("b"))
    assert one(both) == ("x", "Instruction: i\nInput: x")
    assert one(df.select(nz.label_column(df).alias("l"), nz.prompt_column(df).alias("p"))) == ("o", "")


def test_normalize_drops_unreadable_times(spark, rows):
    df = spark.createDataFrame(
        [(1, "a", "2024-03-01 10:00:00"), (2, "b", "soon"), (3, "c", None), (4, "d", "2024-03-01T12:00:00+02:00")],
        "id int, headline string, date string",
    )
    out = nz.normalize(df, "id")
    assert out.columns == ["sample_id", "prompt", "text", "label", "ts"]
    ten = dt.datetime(2024, 3, 1, 10)
    assert rows(out) == [(1, "", "a", "unknown", ten), (4, "", "d", "unknown", ten)]


def test_normalize_without_time(spark, rows):
    df = spark.createDataFrame([(5, "a"), (7, "b"), (9, "c")], "id int, text string")
    out = nz.normalize(df, "id", now="2024-01-01 12:00:00").select("sample_id", F.hour("ts"))
    assert rows(out) == [(5, 10), (7, 11), (9, 12)]
    start = nz.hourly_times(df, "id", "2024-01-31 00:00:00", anchor="start").agg(F.min("ts"))
    assert one(start) == (dt.datetime(2024, 1, 1),)
    with pytest.raises(ValueError):
        nz.normalize(df, "id")


def test_sentiment_order(spark):
    df = spark.createDataFrame([("[negative] so [positive]",), ("none",), ("a NEGATIVE view",)], "t string")
    assert [r[0] for r in df.select(nz.sentiment_label(F.col("t"))).collect()] == ["positive", "neutral", "neutral"]
    bare = df.select(nz.sentiment_label(F.col("t"), fv.BARE_LABELS)).collect()
    assert [r[0] for r in bare] == ["positive", "neutral", "negative"]


def test_words_and_blanks(spark):
    df = spark.createDataFrame([("l'été est 10-K",), ("",), (" \t　",), (None,)], "t string")
    got = df.select(word_count(F.col("t")), nz.is_underlength(F.col("t")), is_blank(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(5, True, False), (0, True, True), (0, True, True), (0, True, True)]
    assert one(spark.range(1).select(trim_all(F.lit(" \n x y\x1c\t")))) == ("x y",)


def test_answer_after_last_marker(spark):
    df = spark.createDataFrame([("a[/INST] b [/INST]  c",), (" plain ",)], "t string")
    assert [r[0] for r in df.select(nz.answer_after_marker(F.col("t"))).collect()] == ["c", "plain"]


def test_best_attempt_and_fallbacks(spark, rows):
    long = " ".join(["word"] * 35)
    df = spark.createDataFrame(
        [
            (1, 0, "short", "Seed: oil\nmore"), (1, 1, f" {long} ", "Seed: oil\nmore"), (1, 2, long + " later", "Seed: oil\nmore"),
            (2, 0, "short", "old Seed: a Seed:  gold \nmore"), (3, 0, "  ", "Seed: tin"), (4, 0, "short", "no seed here"),
        ],
        "p int, a int, t string, prompt string",
    )
    out = {r["p"]: r for r in nz.best_attempts(df, ["p"], "a", "t", "prompt").collect()}
    assert out[1]["text"] == long and not out[1]["is_fallback"]
    # the line keeps its own trailing blank: only the ends of the whole rest are trimmed
    assert "discussion around gold  remains" in out[2]["text"] and out[2]["text"].endswith("[neutral]")
    assert "around the market seed remains" in out[3]["text"]
    assert "around the market seed remains" in out[4]["text"]


def test_public_columns(spark):
    df = spark.createDataFrame([(1, "x", 1, "p")], "client_id int, text string, available int, persona string")
    assert nz.public_columns(df).columns == ["text"]


def test_prompt_grid(spark):
    topics = grids.topic_table(spark, ["a", "b"])
    out = grids.prompt_grid(topics, 2, 2, "2024-01-02 12:00:00", 2)
    assert out.count() == 8
    last = out.filter("day_no = 1 and topic_no = 1 and sample_no = 1").first()
    assert last["timestamp"] == dt.datetime(2024, 1, 2, 5)
    assert last["prompt"].endswith("Date: 2024-01-01\nSeed: b")


def test_payloads(spark, rows):
    df = spark.createDataFrame(
        [(1, '{"data": [{"a": 1}, {"a": 2}]}'), (2, '{"a": 3}'), (3, '[{"a": 4}, {"a": 5}]')], "id int, p string"
    )
    assert rows(readers.payload_rows(df, "p", "a int", ["id"])) == [(1, 1), (1, 2), (2, 3), (3, 4), (3, 5)]


def test_keyword_scores_inside_words(spark):
    df = spark.createDataFrame([(1, "An admirable open token")], "sample_id int, text string")
    scores = ps.persona_scores(df).first().asDict()
    hits = {k[6:] for k, v in scores.items() if k.startswith("score_") and v}
    assert hits == {"retail_investors", "stock_pickers", "crypto_traders"}
    assert all(v <= 1 for k, v in scores.items() if k.startswith("score_"))
    assert ps.assign_persona(df).first()["persona"] in hits


def test_persona_without_client_gets_any(spark):
    samples = spark.createDataFrame([(i, "lonely" if i % 2 else "busy") for i in range(40)], "sample_id int, persona string")
    clients = spark.createDataFrame([(c, "busy" if c < 3 else "other") for c in range(6)], "client_id int, persona string")
    got = ps.assign_clients(samples, clients, ["lonely", "busy"]).collect()
    assert len(got) == 40 and all(r["client_id"] is not None for r in got)
    assert {r["client_id"] for r in got if r["persona"] == "busy"} == {0, 1, 2}
    assert {r["client_id"] for r in got if r["persona"] == "lonely"} > {0, 4}


@pytest.mark.parametrize(
    "n,q,expected",
    [(10, 4, [0, 0, 0, 1, 1, 2, 2, 3, 3, 3]), (5, 10, [0, 2, 4, 7, 9]), (1, 4, [0])],
)
def test_rounds(spark, n, q, expected):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, start + dt.timedelta(minutes=i // 3)) for i in range(n)], "sample_id long, ts timestamp_ntz")
    got = rd.add_temporal_rounds(df, q).orderBy("row_idx").collect()
    assert [r["round_id"] for r in got] == expected and [r["sample_id"] for r in got] == list(range(n))
    in_place = rd.assign_rounds_by_edges(df, q, ["ts", "sample_id"]).orderBy("sample_id").collect()
    assert [r["round_id"] for r in in_place] == expected


def test_positions_when_one_time_holds_most_rows(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(i, start if i % 3 else start + dt.timedelta(seconds=i)) for i in range(3000)], "sample_id long, ts timestamp_ntz"
    ).repartition(7)
    got = rd.with_position(df, ["ts", "sample_id"]).orderBy("ts", "sample_id").collect()
    assert [r["row_idx"] for r in got] == list(range(3000))


def test_rounds_of_nothing(spark):
    df = spark.createDataFrame([], "sample_id long, ts timestamp_ntz")
    assert rd.add_temporal_rounds(df, 4).count() == 0
    assert rd.assign_rounds_by_edges(df, 4, ["ts", "sample_id"]).count() == 0


def test_first_round_of_concepts(spark):
    concepts = [dict(first_round=f, term="t") for f in (0.5, 1.0, 1, 60, -3)]
    got = drift.normalize_catalog(drift.catalog(spark, concepts), 50).orderBy("concept_no").collect()
    assert [r["first_round"] for r in got] == [24, 49, 1, 49, 0]


def test_catalog_defaults(spark):
    concepts = [dict(private_code=" C-1 ", label=" Positive "), dict(term="  "), dict(term="t", snippet=" s ", answer="X")]
    got = [tuple(r)[2:] for r in drift.normalize_catalog(drift.catalog(spark, concepts), 10).orderBy("concept_no").collect()]
    assert got == [
        ("C-1", "New private market code: C-1. Signal label: positive.", "C-1", "positive", ""), ("t", "s", "t", "x", ""),
    ]


def test_injection_picks_by_position(spark):
    df = spark.createDataFrame([(7, 20), (7, 8), (7, 7)], "row_idx long, round_id int").withColumns(
        {"text": F.lit("x"), "prompt": F.lit("p")}
    )
    concepts = [dict(first_round=8, term="one"), dict(first_round=16, term="two", answer="negative")]
    got = {r["round_id"]: r for r in drift.inject_concepts(df, 50, concepts).collect()}
    assert [got[r]["drift_concept"] for r in (20, 8, 7)] == ["two", "one", ""]
    assert got[20]["text"] == "x\n\nNew private market code: two. Signal label: negative."
    assert got[20]["prompt"] == "p\n\nEmerging private market code to address: two"
    assert got[7]["text"] == "x" and got[7]["drift_first_round"] is None
    none = drift.inject_concepts(df, 50, []).first()
    assert none["drift_concept"] == "" and none["drift_first_round"] is None


def test_concept_with_foreign_snippet_is_not_scored(spark):
    df = spark.createDataFrame([("New concept: other words", "MERIDIAN-8")], "text string, drift_concept string")
    assert sc.split_at_term(df).first()["completion"] is None


def test_expected_availability(spark):
    cases = [("ASIA", 2), ("ASIA", 3), ("ASIA", 20), ("ASIA", 21), ("US", 47), ("US", 48), ("GLOBAL", 0)]
    df = spark.createDataFrame(cases, "tz string, r int")
    got = [r[0] for r in df.select(av.expected_availability(F.col("tz"), F.col("r"), 50)).collect()]
    assert got == [0.25, 0.75, 0.75, 0.25, 0.75, 0.25, 0.65]


def test_availability_variants(spark, rows):
    full = spark.createDataFrame([(1, 0), (2, 0)], "client_id int, round_id int")
    side = spark.createDataFrame([(1, 0, 1, 0.5)], "client_id int, round_id int, available int, availability_probability double")
    assert rows(av.rejoin_availability(full, side).select("client_id", "available")) == [(1, 1), (2, 0)]
    kept = av.rejoin_availability(full.withColumn("available", F.lit(None).cast("int")), side)
    assert rows(kept.select("client_id", "available")) == [(1, 0), (2, 0)]
    only_x = full.withColumn("available_x", F.lit(1))
    assert rows(av.resolve_available(only_x).select("available")) == [(1,), (1,)]
    assert rows(av.resolve_available(full).select("available")) == [(0,), (0,)]


def test_selection_score(spark):
    df = spark.createDataFrame([(0.8, 0, 0, 200.0), (0.8, 1, 1, 100.0)], "p double, seen int, n int, c double")
    got = [r[0] for r in df.select(sel.selection_score(F.col("p"), F.col("seen"), F.col("n"), F.col("c"))).collect()]
    assert got == pytest.approx([0.93, 0.505])


def test_history_before_a_round(spark, rows):
    log = spark.createDataFrame([(0, "A", "x"), (2, "B", "x"), (3, "B", "x")], "round_id int, client_id string, persona string")
    ask = spark.createDataFrame([(4, c, "x") for c in "ABC"], "round_id int, client_id string, persona string")
    got = sel.with_history(ask, log, 10).select("client_id", "last_seen", "persona_count")
    assert rows(got) == [("A", 3, 3), ("B", 1, 3), ("C", 3, 3)]


def test_imbalance(spark):
    df = spark.createDataFrame([("a", 4), ("b", 2)], "client_id string, selections long")
    assert one(sel.representation_imbalance(df))[0] == pytest.approx(2 / (3 + 1e-8))
    assert one(sel.representation_imbalance(df.limit(0))) == (None,)


def test_weighted_average(spark, rows):
    values = spark.createDataFrame([("A", "x", 1.0), ("A", "y", 2.0), ("B", "x", 5.0)], "client_id string, param string, value double")
    weights = spark.createDataFrame([("A", 3.0), ("B", 1.0)], "client_id string, weight double")
    assert rows(bg.weighted_average(values, weights, [], ["client_id"], ["param"])) == [("x", 2.0), ("y", 1.5)]
    zero = weights.withColumn("weight", F.lit(0.0))
    assert rows(bg.weighted_average(values, zero, [], ["client_id"], ["param"])) == [("x", 0.0), ("y", 0.0)]


def test_adapter_parameters_win(spark, rows):
    df = spark.createDataFrame([("w", 1.0), ("lora_a", 2.0)], "param string, value double")
    assert rows(bg.select_parameters(df)) == [("lora_a", 2.0)]
    assert rows(bg.select_parameters(df.filter("param = 'w'"))) == [("w", 1.0)]


def test_split_at_last_marker(spark):
    df = spark.createDataFrame([("x New concept: a y NEW concept: b", ""), ("x Zen b zen", " zen "), ("none", "zen")], "text string, drift_concept string")
    got = [(r["head"], r["completion"]) for r in sc.split_at_marker(df).collect()]
    assert got == [("x New concept: a y ", "NEW concept: b"), ("x ", "Zen"), (None, None)]


@pytest.mark.parametrize(
    "head,completion,max_len,kept,targets",
    [("a b c d e", "f g", 4, ["d", "e"], 2), ("a b", "c d e", 2, ["b"], 1), ("", "a b", 8, [], 1), ("", "a", 8, [], 0), ("a", "b", 8, ["a"], 1)],
)
def test_completion_window(spark, head, completion, max_len, kept, targets):
    df = spark.createDataFrame([(1, head, completion)], "k int, head string, completion string")
    out = sc.completion_window(df, max_len)
    assert out.first()["_head"] == kept and out.first()["targets"] == targets
    assert (sc.completion_pairs(out, ["k"]).agg(F.sum("n")).first()[0] or 0) == targets


def test_emerging_terms(spark, rows):
    texts = {0: "Alpha alpha beta beta beta gamma gamma abc abc abc", 1: "alpha alpha alpha beta beta beta gamma gamma abc", 2: "gamma gamma gamma"}
    df = spark.createDataFrame(list(texts.items()), "round_id int, text string")
    got = tm.emerging_terms(df).select("round_id", "term")
    # gamma was seen four times before round 2, so it never emerges
    assert rows(got) == [(0, "beta"), (1, "alpha")]


def test_term_coverage(spark):
    df = spark.createDataFrame([("Rate rates",)], "text string")
    got = {r["term"]: r["score"] for r in tm.term_coverage(df, ["rate", "none"]).collect()}
    assert got["rate"] == pytest.approx(1.2876820724517808) and got["none"] == pytest.approx(math.log(2) + 1)


def test_term_tracking(spark):
    scores = spark.createDataFrame(
        [("m", 3, "t", 10.0, 2), ("m", 4, "t", 9.5, 1), ("m", 5, "t", 9.0, 4), ("m", 6, "t", 1.0, 1), ("m", 3, "u", 5.0, 1), ("m", 4, "u", 4.9, 1)],
        "method string, round_id int, term string, perplexity double, term_samples long",
    )
    tracked = spark.createDataFrame([("t", 3), ("u", 3)], "term string, first_seen_round int")
    got = {r["term"]: r for r in tm.adaptation_tracking(scores, tracked).collect()}
    assert (got["t"]["threshold_round"], got["t"]["adaptation_lag"], got["t"]["term_eval_samples"]) == (5, 2, 4)
    assert got["t"]["threshold_perplexity"] == 9.0 and got["t"]["observed_term_perplexity"] == 9.0
    assert (got["u"]["threshold_round"], got["u"]["adaptation_lag"], got["u"]["term_eval_samples"]) == (None, None, 0)


@pytest.mark.parametrize("values,expected", [([0.5, 0.25], 0.9), ([], None), ([0.0, 0.0], None), ([0.5, 0.25, float("nan")], 0.9)])
def test_jain(spark, values, expected):
    got = spark.createDataFrame([(v,) for v in values], "x double").agg(jain_index(F.col("x"))).first()[0]
    assert got == (None if expected is None else pytest.approx(expected))


def test_perplexity_cap(spark):
    df = spark.createDataFrame([(0.0,), (25.0,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(perplexity(F.col("x"))).collect()] == [1.0, pytest.approx(math.exp(20)), None, None]


def test_weighted_perplexity(spark):
    df = spark.createDataFrame([(10.0, 2), (None, 3)], "perplexity double, num_eval_samples int")
    assert one(mt.weighted_perplexity(df)) == (4.0,)
    assert one(mt.weighted_perplexity(df.limit(0))) == (None,)


@pytest.mark.parametrize(
    "flags,expected",
    [
        (dict(enumerate([0, 0, 1, 0, 0, 0, 1, 0])), [("p", 0, 1), ("p", 3, 5)]), ({0: 1, 1: 0, 4: 1}, [("p", 1, 3)]),
        ({0: 0, 1: 1, 2: 0, 3: 0}, []), ({0: 1}, []),
    ],
)
def test_suppression_windows(spark, rows, flags, expected):
    df = spark.createDataFrame([("p", r, a) for r, a in flags.items()], "persona string, round_id int, available int")
    assert rows(sp.suppression_windows(df, 2)) == expected


def test_windows_need_no_rows_of_absence(spark, rows):
    """From the rounds of presence alone the same windows as from the grid of all rounds."""
    draw = random.Random(3)
    grid = [(p, r, int(draw.random() < share)) for p, share in (("a", 0.2), ("b", 0.6), ("c", 0.0), ("d", 1.0), (None, 0.3)) for r in range(30)]
    dense = spark.createDataFrame(grid, "persona string, round_id int, available int")
    sparse = dense.filter("available = 1").select("persona", "round_id")
    for least in (0, 1, 2, 4):
        assert rows(sp.windows_between(sparse, least)) == rows(sp.suppression_windows(dense, least))
    assert "Window" not in sp.windows_between(sparse)._jdf.queryExecution().optimizedPlan().toString()


def test_recovery_at_an_equal_value(spark):
    """Six times 5.01 sum up to a mean of a little less, yet 5.01 afterwards is no worse."""
    windows = spark.createDataFrame([("p", 6, 7)], "persona string, window_start int, window_end int")
    history = spark.createDataFrame([("p", r, 5.01) for r in (0, 1, 2, 3, 4, 5, 9)], "persona string, round int, perplexity double")
    got = sp.suppression_effect(windows, history).collect()[0]
    assert got["pre_window_metric"] < 5.01 and got["recovery_rounds"] == 2


def test_suppression_effect(spark):
    history = spark.createDataFrame(
        [("m", "p", i, float(v)) for i, v in enumerate([10, 10, 14, 13, 11, 9])], "method string, persona string, round int, perplexity double"
    )
    windows = spark.createDataFrame([("p", 2, 3), ("p", 0, 1), ("p", 4, 5)], "persona string, window_start int, window_end int")
    got = {r["window_start"]: tuple(r)[4:] for r in sp.suppression_effect(windows, history, by=["method"]).collect()}
    assert got[2] == (10.0, 13.5, 10.0, 2)
    assert got[0] == (None, 10.0, 11.75, None)
    assert got[4] == (11.75, 10.0, None, None)


def test_method_summary(spark):
    df = spark.createDataFrame(
        [("m", 0, 4.0), ("m", 1, 2.0), ("m", 2, None), ("ref", 0, 5.0)], "method string, round int, global_perplexity double"
    )
    got = {r["method"]: r for r in mt.summarize_methods(df, reference="ref").collect()}["m"]
    assert got["num_rounds"] == 3 and got["global_perplexity_mean"] == 3.0
    assert got["global_perplexity_std"] == pytest.approx(2**0.5) and got["global_perplexity_se"] == pytest.approx(1.0)
    assert got["global_perplexity_final"] == 2.0 and got["global_perplexity_mean_improvement_vs_ref"] == 2.0
    none = mt.summarize_methods(df, reference="absent").filter("method = 'm'").first()
    assert none["global_perplexity_mean_improvement_vs_absent"] is None


def test_adaptation_lag(spark):
    df = spark.createDataFrame([(2, "t", 9.0), (4, "t", 3.0), (5, "t", 1.0)], "round int, term string, score double")
    assert one(mt.adaptation_lag(df, "t", 3.0)) == (2,)
    assert one(mt.adaptation_lag(df, "t", 0.5)) == (None,)


def test_stack_differing_columns(spark, rows):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "y")], "x int, z string")
    assert rows(mt.stack([a.limit(0), a, b])) == [(1, None), (2, "y")]


def test_long_text_cuts_the_label_off(spark):
    df = spark.createDataFrame([(1, "w " * 300, "a"), (2, "w", "b")], "sample_id int, text string, label string")
    model = bg.CountModel(bg.fit(spark.createDataFrame([("sentiment: b",)], "text string"), []))
    space = sc.label_space(df)
    got = {(r["sample_id"], r["label"]): r["score"] for r in sc.label_scores(df, space, model, max_len=256).collect()}
    assert got[1, "a"] is None and got[1, "b"] is None and got[2, "b"] > got[2, "a"]
    personas = df.withColumn("persona", F.lit("p"))
    # the cut-off text falls to the first label, which is its own; the other one is found
    assert one(sc.label_accuracy(personas, model, max_len=256)) == ("p", 1.0)
    # without a window both are found
    got = {(r["sample_id"], r["label"]): r["score"] for r in sc.label_scores(df, space, model).collect()}
    assert got[1, "b"] == got[2, "b"] > got[1, "a"] == got[2, "a"]


def test_probabilities_stay_below_one(spark, sf):
    from driftwell.plans import datasets as ds

    model = bg.CountModel(bg.fit(ds.documents(spark, sf), []))
    seen = model.nll(sc.target_pairs(ds.documents(spark, sf), []))
    worst = seen.groupBy("prev").agg(F.sum(F.exp(-F.col("nll"))).alias("p")).agg(F.max("p")).first()[0]
    assert 0 < worst <= 1 + 1e-9


def test_round_edges(spark):
    """For any number of rows and rounds, with many equal and missing times."""
    draw = random.Random(2)
    for n in (0, 1, 2, 3, 5, 50, 997):
        keys = [(None if draw.random() < 0.05 else draw.choice([7, 7, 7, draw.randint(0, 10**6)]), i) for i in draw.sample(range(10**6), n)]
        df = spark.createDataFrame(keys, "t long, id long").repartition(3)
        order = sorted(keys, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
        for q in (1, 2, 7, 40):
            want = {}
            for p, key in enumerate(order):
                want.setdefault(max((p * q + n - 2) // max(n - 1, 1) - 1, 0), key)
            assert {r["round_id"]: (r["t"], r["id"]) for r in rd.round_edges(df, q, ["t", "id"]).collect()} == want


def test_hourly_times_never_repeat(spark):
    df = spark.range(5)
    got = [str(r["ts"]) for r in nz.hourly_times(df, "id", "2024-01-01 00:00:00", every_seconds=60).orderBy("id").collect()]
    assert got == [f"2023-12-31 23:{m}:00" for m in (56, 57, 58, 59)] + ["2024-01-01 00:00:00"]
    got = [str(r["ts"]) for r in nz.hourly_times(df, "id", "2024-01-02 00:00:00", "start", 1).orderBy("id").collect()]
    assert got[0] == "2024-01-01 00:00:00" and got[4] == "2024-01-01 04:00:00"


def test_files_are_planned(spark, tmp_path):
    """One file per round and client; a large group is cut into even parts; reading gives all rows back."""
    df = spark.range(3000).select(
        (F.col("id") % 3).cast("int").alias("round_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("client_id"),
        F.concat(F.lit("text\n"), "id").alias("text"), F.lit("l").alias("label"), F.lit("2024-01-01").alias("timestamp"), F.lit("p").alias("persona"), F.lit("r").alias("region"),
    ).repartition(7)
    for one_line in (False, True):
        out = str(tmp_path / f"x{one_line}")
        writers.export_client_rounds(df, out, max_rows_per_file=100, one_line=one_line)
        groups = {(r["round_id"], r["client_id"]): r["count"] for r in df.groupBy("round_id", "client_id").count().collect()}
        for (r, c), n in groups.items():
            files = glob.glob(f"{out}/round_id={r}/client_id={c}/*.csv")
            assert len(files) == -(-n // 100)
            if len(files) > 1:
                sizes = [spark.read.csv(f, header=True, multiLine=True, escape='"').count() for f in files]
                assert max(sizes) < 1.5 * n / len(files)
        back = readers.read_table(spark, out, "csv", one_line=one_line)
        assert {r["text"] for r in back.select("text").collect()} == {f"text\n{i}" for i in range(3000)}


def test_csv_on_one_line_is_shared_and_comes_back(spark, tmp_path):
    odd = ["a\nb", "\\n", "\\", "\r\n", "\\\\s\\", 'x"y', '"', "\\\n\\", "plain, with comma", None, "é\u2028"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd * 4000)], "id long, text string").coalesce(1)
    out = str(tmp_path / "csv")
    writers.write_table(df, out, "csv", one_line=True)
    back = readers.read_typed_csv(spark, out, "id long, text string", one_line=True)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        assert readers.read_typed_csv(spark, out, "id long, text string", one_line=True).rdd.getNumPartitions() > 4
        assert readers.read_typed_csv(spark, out, "id long, text string").rdd.getNumPartitions() <= 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_limits_that_are_off_by_default(spark, rows):
    """Literal results of the parameters that cut: tokens, labels, terms, characters, guidance."""
    df = spark.createDataFrame([(1, "a b c d"), (2, "a"), (3, None)], "k int, text string")
    assert rows(bg.token_positions(df, ["k"], max_len=2)) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "a")]
    assert rows(bg.fit(df, [], max_len=2)) == sorted([(None, "a", 2.0), ("a", "b", 1.0)], key=str)
    labels = spark.createDataFrame([(x,) for x in "aabbbccd"], "label string")
    assert rows(sc.label_space(labels, limit=2)) == [(0, "b"), (1, "a")] and rows(sc.label_space(labels, limit=9)) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    emerging = spark.createDataFrame([(0, "zeta"), (0, "beta"), (1, "eta_")], "round_id int, term string")
    assert rows(tm.tracked_terms(emerging, per_round=1).select("term", "first_seen_round")) == [("beta", 0), ("eta_", 1)]
    loaded = spark.createDataFrame([("u", "abcdef")], "url string, body string")
    asked = spark.createDataFrame([("u",), ("v",)], "source_url string")
    assert rows(readers.source_bodies(asked, loaded, max_chars=3))[0] == ("u", "abc")
    prior = spark.createDataFrame([(i, f"text {i}", "neutral", "t") for i in range(6)], "key int, text string, label string, topic string")
    notes = bg.guidance_batch(prior, "key", 10, "{prior}", every=3, max_rounds=2, max_samples=4)
    assert {(r["round_id"], r["count"]) for r in notes.groupBy("round_id").count().collect()} == {(0, 4), (3, 4)}


def test_guidance_is_counted_once_for_all_rounds(spark, rows):
    prior = spark.createDataFrame([(i, f"note {i} 5 word 0", "good", "t 10") for i in range(4)] + [(9, None, "x", "y")], "key int, text string, label string, topic string")
    for template in ("{prior} in {round_id}", "{round_id}{round_id} x{round_id}. {topic} {prior} {label}", "{prior}"):
        for first in (0, 4):
            whole = bg.fit(bg.guidance_batch(prior, "key", 12, template, 5).filter(F.col("round_id") >= first), ["round_id"])
            assert rows(bg.fit_guidance(prior, "key", 12, template, 5, first=first).select(*whole.columns)) == rows(whole)


def test_averages_straight_from_texts(spark):
    """Sums weighted by shares equal the average of the clients' own counts, for every method."""
    draw = random.Random(6)
    df = spark.createDataFrame(
        [(i % 3, draw.randint(0, 5), " ".join(draw.choices("a b c d".split(), k=draw.randint(0, 6))), draw.choice(["", "x"])) for i in range(90)],
        "round_id int, client_id int, text string, drift_concept string",
    )
    chosen = spark.createDataFrame([(m, r, c) for m in ("m", "n") for r in range(3) for c in (1, 2, 3 if m == "m" else 5, 77)], "method string, round_id int, client_id int")
    weights = chosen.join(bg.sample_weights(df, ["round_id", "client_id"], 4), ["round_id", "client_id"])
    local = bg.fit(df, ["round_id", "client_id"], max_len=4, drift_times=4)
    want = {(r["method"], r["round_id"], r["prev"], r["tok"]): r["value"] for r in bg.weighted_average(local, weights, ["method", "round_id"], ["client_id"], ["prev", "tok"]).collect()}
    shares = bg.client_shares(weights, ["round_id"], ["client_id"], {"m": "v", "n": "w"})
    wide = bg.fit_shared(df, shares, ["round_id"], ["client_id"], ["v", "w"], max_len=4, drift_times=4).collect()
    got = {(m, r["round_id"], r["prev"], r["tok"]): r[c] for r in wide for m, c in (("m", "v"), ("n", "w")) if r[c] is not None}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_texts_are_gathered_by_round(spark, sf, monkeypatch):
    """A task counts texts of one round, of a large round as many as fit, and no table of availability is read for an average."""
    from driftwell.plans import checks_scoring

    df = spark.range(100).select(F.col("id").alias("sample_id"), (F.col("id") % 4).cast("int").alias("round_id"))
    for at_once, tasks in ((25, 4), (10, 12)):
        monkeypatch.setattr(bg, "TEXTS_AT_ONCE", at_once)
        dealt = bg.texts_by_round(df, "sample_id", 4, 100)
        rounds = dealt.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("round_id").alias("rounds"), F.count("*").alias("n")).collect()
        assert dealt.rdd.getNumPartitions() == tasks == len(rounds) and {r["rounds"] for r in rounds} == {1} and sum(r["n"] for r in rounds) == 100
    read = checks_scoring.round_average(spark, sf).inputFiles()
    assert any("documents" in f for f in read) and not any("events" in f for f in read)
