"""Whole jobs, files, and properties."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from driftwell import fixed_values as fv
from driftwell.operators import availability as av, bigram as bg, drift, normalize as nz, rounds as rd, scoring as sc, selection as sel
from driftwell.plans import datasets as ds, experiment as ex, prepare as pr
from driftwell.sources import grids, readers, writers

ROUNDS = 10


@pytest.fixture(scope="module")
def prepared(spark, sf, tmp_path_factory):
    """The prepare job over documents, customers and events, written and read back."""
    out = str(tmp_path_factory.mktemp("prepared"))
    clients = ds.clients(spark, sf)
    seen = av.observed_activity(ds.table(spark, sf, "events"), ds.START, 72, ROUNDS)
    grid = av.availability_matrix(clients, seen, ROUNDS)
    raw = ds.table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("label"))
    job = pr.prepare(raw, "doc_id", clients, grid, ROUNDS, ds.PERSONAS, [dict(c, first_round=c["first_round"] // 8) for c in ds.CONCEPTS], ds.NOW)
    pr.write_prepared(job, out)
    return out, clients


def test_prepared_tables(spark, sf, prepared):
    out, clients = prepared
    full = pr.read_prepared(spark, out)
    n = ds.table(spark, sf, "documents").count()
    assert full.count() == n == full.select("sample_id").distinct().count()
    meta = f"{out}/metadata"
    yes, no = (spark.read.parquet(f"{meta}/{p}_train_dataset") for p in ("available", "unavailable"))
    assert yes.count() + no.count() == n
    assert yes.filter("available <> 1").count() == 0 and no.filter("available <> 0").count() == 0
    assert spark.read.parquet(f"{meta}/availability_matrix").count() == clients.count() * ROUNDS
    manifest = spark.read.parquet(f"{meta}/semantic_drift_manifest")
    assert {r["drift_first_round"] for r in manifest.collect()} == {1, 2, 3, 4, 5}
    plan = full.filter("round_id = 3").select("sample_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(round_id" in plan


def test_exported_rounds(spark, prepared):
    out, _ = prepared
    yes = spark.read.parquet(f"{out}/metadata/available_train_dataset")
    folders = glob.glob(f"{out}/rounds/round_id=*/client_id=*")
    assert len(folders) == yes.select("round_id", "client_id").distinct().count()
    back = readers.read_table(spark, f"{out}/rounds", "csv")
    assert [c for c in back.columns if c not in ("round_id", "client_id")] == writers.EXPORT_COLUMNS
    assert {r["text"] for r in back.select("text").collect()} == {r["text"] for r in yes.select("text").collect()}


def test_large_client_round_is_shared(spark, tmp_path):
    df = spark.range(100).select(
        F.lit(0).alias("round_id"), F.when(F.col("id") < 90, "hot").otherwise("cold").alias("client_id"),
        F.col("id").cast("string").alias("text"), F.lit("l").alias("label"), F.lit("2024-01-01").alias("timestamp"),
        F.lit("p").alias("persona"), F.lit("r").alias("region"),
    )
    writers.export_client_rounds(df, str(tmp_path / "x"), max_rows_per_file=20)
    assert len(glob.glob(f"{tmp_path}/x/round_id=0/client_id=hot/*.csv")) >= 5
    assert spark.read.csv(str(tmp_path / "x"), header=True).count() == 100


def test_full_dataset_as_csv(spark, prepared, tmp_path):
    out, _ = prepared
    full = pr.read_prepared(spark, out)
    writers.write_table(full, str(tmp_path / "full"), "csv")
    back = readers.read_full_dataset(spark, str(tmp_path / "full"))
    cols = ["sample_id", "text", "timestamp", "round_id", "drift_concept", "drift_first_round", "available"]
    assert sorted(map(tuple, back.select(cols).collect()), key=str) == sorted(map(tuple, full.select(cols).collect()), key=str)
    assert drift.current_knowledge(back).count() == drift.current_knowledge(full).count() > 0


def test_export_label_variants(spark):
    base = spark.createDataFrame([(0, "c", "t", "p", "r", "2024-01-01")], "round int, client_id string, text string, persona string, region string, timestamp string")
    assert writers.client_round_rows(base).first()["label"] == "unknown"
    assert writers.client_round_rows(base.withColumn("label_x", F.lit("L"))).first()["label"] == "L"


def by_definition(features, num_rounds, k):
    """Selections so far are searched anew for every score."""
    log = []
    for r in range(num_rounds):
        offers = []
        for _, client, persona, p, chars in (f for f in features if f[0] == r):
            same = sum(1 for e in log if persona is not None and e[2] == persona)
            last = max((e[0] for e in log if e[1] == client), default=-1)
            passed = len({e[0] for e in log if e[0] >= last})
            score = 0.35 * p + 0.2 / (1 + passed) + 0.2 / (1 + same) + 0.25 * min(1.0, chars / 200) - (0.1 if same else 0.0)
            offers.append((-round(score, 12), client, persona))
        log += [(r, client, persona, i) for i, (_, client, persona) in enumerate(sorted(offers, key=lambda o: o[:2])[:k], 1)]
    return log


def test_sequential_selection(spark):
    rng = random.Random(3)
    features = [
        (r, c, f"p{c % 3}" if c % 5 else None, rng.choice([0.1, 0.5, 0.9]), float(rng.randint(20, 300)))
        for r in range(12) for c in range(15) if r != 5 and rng.random() < 0.6
    ]
    df = spark.createDataFrame(features, "round_id int, client_id long, persona string, probability double, mean_chars double")
    got = [tuple(r) for r in sel.select_sequentially(spark, df, 12, 3).orderBy("round_id", "rank").collect()]
    assert got == by_definition(features, 12, 3)
    # the history features give the same scores from the finished log, where all clients have a persona
    full = df.filter("persona is not null")
    got = [tuple(r) for r in sel.select_sequentially(spark, full, 12, 3).collect()]
    log = spark.createDataFrame(got, "round_id int, client_id long, persona string, rank int")
    again = sel.select_by_score(sel.with_history(full, log, 12), 3).select("round_id", "client_id", "persona", "rank")
    assert sorted(tuple(r) for r in again.collect()) == sorted(got)


@pytest.mark.parametrize("per_job", [1, 4, 40])
def test_sequential_selection_in_parts(spark, per_job):
    """The rounds of a job, and going on from an earlier log, change nothing."""
    rng = random.Random(per_job)
    features = [(r, c, f"p{c % 3}" if c % 4 else None, rng.choice([0.1, 0.5]), rng.choice([40.0, 500.0])) for r in range(14) for c in range(25) if r != 3 and rng.random() < 0.7]
    df = spark.createDataFrame([*features, (1, None, "p0", 1.0, 900.0)], "round_id int, client_id long, persona string, probability double, mean_chars double")
    wanted = by_definition(features, 14, 2)
    whole = sel.select_sequentially(spark, df, 14, 2, per_job)
    assert [tuple(r) for r in whole.orderBy("round_id", "rank").collect()] == wanted
    first = sel.select_sequentially(spark, df.filter("round_id < 6"), 6, 2, per_job)
    rest = sel.select_sequentially(spark, df.filter("round_id >= 6"), 14, 2, per_job, earlier=first)
    assert [tuple(r) for r in first.union(rest).orderBy("round_id", "rank").collect()] == wanted


def test_sequential_selection_takes_few_jobs(spark):
    """Jobs grow with blocks of rounds, not with rounds."""
    df = spark.range(2000).select((F.col("id") % 40).cast("int").alias("round_id"), (F.col("id") % 97).alias("client_id"), F.lit("p").alias("persona"), F.lit(0.5).alias("probability"), (F.col("id") % 200).cast("double").alias("mean_chars"))
    tracker, counts = spark.sparkContext.statusTracker(), []
    for n in (10, 40):
        spark.sparkContext.setJobGroup(f"few-jobs-{n}", "")
        sel.select_sequentially(spark, df.filter(F.col("round_id") < n), n, 3)
        counts.append(len(tracker.getJobIdsForGroup(f"few-jobs-{n}")))
    spark.sparkContext.setJobGroup("others", "")
    assert abs(counts[0] - counts[1]) <= 3 and max(counts) < 20  # adaptive execution runs a stage as a job


def test_experiment_goes_on_from_a_state(spark, prepared, tmp_path):
    """Rounds in three parts, with the state stored in between, give the tables of one run."""
    out, clients = prepared
    stream = pr.read_prepared(spark, out)
    prior = grids.prior_corpus(grids.topic_table(spark))
    told = {"drift_times": 2, "template": ds.GUIDANCE_TEMPLATE, "methods": ["aws", "random", "crosslm"]}
    whole = ex.run(stream, clients, prior, "prior_id", ROUNDS, **told)
    state = None
    for i, until in enumerate((3, ROUNDS // 2, ROUNDS)):
        part = stream.filter(F.col("round_id").between(0 if state is None else state.last + 1, until - 1))  # earlier samples are gone
        report, state = ex.run_rounds(part, clients, prior, "prior_id", until, before=state, **told)
        state = state.write(f"{tmp_path}/state-{i}")
        assert "text" not in {c for t in (state.learned, state.terms, state.log, state.lags, state.presence) for c in t.columns}
    for name in ("per_persona", "fairness", "lags", "suppression", "comparison", "summary", "round_metrics", "selections"):
        one, other = getattr(whole, name), getattr(report, name)
        assert sorted(one.columns) == sorted(other.columns)
        keys = [c for c, t in sorted(one.dtypes) if t != "double"]
        values = [c for c, t in sorted(one.dtypes) if t == "double"]
        a, b = (sorted(map(tuple, t.select(*keys, *values).collect()), key=lambda r: str(r[: len(keys)])) for t in (one, other))
        assert [r[: len(keys)] for r in a] == [r[: len(keys)] for r in b], name
        for x, y in zip(a, b):
            for u, v in zip(x[len(keys) :], y[len(keys) :]):
                assert (u is None) == (v is None) and (u is None or u == pytest.approx(v, rel=1e-9)), (name, x, y)


def test_experiment(spark, prepared, tmp_path):
    out, clients = prepared
    stream = pr.read_prepared(spark, out)
    prior = grids.prior_corpus(grids.topic_table(spark))
    report = ex.run(stream, clients, prior, "prior_id", ROUNDS, drift_times=2, template=ds.GUIDANCE_TEMPLATE)
    comparison = report.comparison.collect()
    assert len(comparison) == len(ex.METHODS) * ROUNDS
    by = {(r["method"], r["round"]): r for r in comparison}
    assert all(by["oracle", r]["selected_clients"] == 5 for r in range(ROUNDS))
    for name, value in by["oracle", 7].asDict().items():
        other = by["no_availability", 7][name]
        assert name == "method" or (value == pytest.approx(other) if isinstance(value, float) else value == other)
    assert [by["crosslm", r]["guidance_samples"] for r in range(3)] == [6, 0, 0]
    assert by["crosslm", 3]["training_mode"] == fv.POOLED_MODE and by["aws", 3]["method_family"] == fv.CLIENT_FAMILY
    # clients learn the concepts, the pooled prior never sees them
    last = ROUNDS - 1
    assert by["no_availability", last]["current_knowledge_nll"] < by["crosslm", last]["current_knowledge_nll"]
    summary = {r["method"]: r for r in report.summary.collect()}
    assert set(summary) == set(ex.METHODS) and summary["aws"]["num_rounds"] == ROUNDS
    assert summary["crosslm"]["global_perplexity_mean_improvement_vs_crosslm"] == 0
    assert report.fairness.count() == len(ex.METHODS) * stream.select("round_id").distinct().count()
    ex.write_report(report, str(tmp_path / "metrics"))
    assert len(glob.glob(f"{tmp_path}/metrics/*")) == 8
    with pytest.raises(ValueError):
        ex.select_clients(stream, clients, ["nonsense"], ROUNDS)


def test_experiment_scores_texts_where_they_lie(spark, sf, monkeypatch):
    """What few clients teach comes to the texts; the pairs of all texts are stored only if more was learned."""
    names = []
    monkeypatch.setattr(ex, "stored", lambda df, name, keep=ex.stored: names.append(name) or keep(df, name))
    stream = spark.createDataFrame(
        [(i, i % 3, "c" + str(i % 2), "p", "EU", f"a b c{i % 5} New concept: x", "label", "x", "CODE", "positive") for i in range(12)],
        "sample_id int, round_id int, client_id string, persona string, region string, text string, label string, drift_concept string, "
        "drift_private_code string, drift_answer string",
    )
    chosen = spark.createDataFrame([("random", r, "c0", None, 1) for r in range(3)], "method string, round_id int, client_id string, persona string, rank int")
    model = ex.learn(stream, chosen, None, ["random"])

    def losses():
        return sorted((r["round_id"], r["sample_id"], round(r["loss_sum"], 9), r["loss_tokens"]) for r in ex.score(stream, model).texts.collect())

    few = losses()
    assert "text-pairs" not in names and len(few) == 12
    monkeypatch.setattr(ex.bg, "FEW_SUMS", 0)
    assert losses() == few and "text-pairs" in names


def test_oversampling_weighs_concepts(spark):
    df = spark.createDataFrame([("a b", "x"), ("a c", " ")], "text string, drift_concept string").withColumn("client_id", F.lit(1))
    assert nz.oversample(df, 8).count() == 9
    counts = {(r["prev"], r["tok"]): r["value"] for r in bg.fit(df, ["client_id"], drift_times=8).collect()}
    assert counts["a", "b"] == 8 and counts["a", "c"] == 1 and counts[None, "a"] == 9
    assert bg.sample_weights(df, ["client_id"], 8).first()["weight"] == 9


def test_round_sizes(spark, sf):
    docs = ds.timed_samples(spark, sf, 7)
    sizes = [r["count"] for r in docs.groupBy("round_id").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    spans = docs.groupBy("round_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("round_id").collect()
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))


def test_uniform_selection_size(spark, sf):
    pool = ds.activity(spark, sf)
    chosen = sel.sample_uniform(pool, 3)
    n = {r["round_id"]: r["count"] for r in pool.groupBy("round_id").count().collect()}
    got = {r["round_id"]: r["count"] for r in chosen.groupBy("round_id").count().collect()}
    assert got == {r: min(3, c) for r, c in n.items()}
    assert chosen.join(pool, ["round_id", "client_id"], "left_anti").count() == 0


def test_text_scans_read_only_what_they_need(spark, sf):
    plan = ds.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    text = rd.round_edges(plan, 5, ["sample_id"])  # runs on ids alone
    assert text.count() == 5
    scan = ds.documents(spark, sf).select("sample_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in scan


def test_checkpoint_folder_is_the_named_one(spark):
    from driftwell.session import checkpoint_dir

    assert spark.sparkContext.getConf().get("spark.checkpoint.dir") in checkpoint_dir(spark)


def test_missing_texts_pass_the_prepare_job(spark, sf):
    raw = ds.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("text"))
    seen = av.observed_activity(ds.table(spark, sf, "events"), ds.START, 72, ROUNDS)
    clients = ds.clients(spark, sf)
    job = pr.prepare(raw, "doc_id", clients, av.availability_matrix(clients, seen, ROUNDS), ROUNDS, ds.PERSONAS, ds.CONCEPTS, ds.NOW)
    rows = job.full.select("persona", "client_id").collect()
    assert len(rows) == raw.count() and all(r["persona"] and r["client_id"] is not None for r in rows)


def test_times_end_at_the_calendar(spark, monkeypatch):
    far = spark.createDataFrame([(0, 0, 10**10), (1, 10**10 - 3, 10**10), (2, 10**10 - 1, 10**10)], "k long, row_idx long, total_rows long")
    monkeypatch.setattr(nz, "with_position", lambda df, order: far)
    back = [str(r["ts"]) for r in nz.hourly_times(far, "k", "2024-06-01 12:00:00").orderBy("k").collect()]
    assert back == ["0001-01-01 00:00:00", "2024-06-01 10:00:00", "2024-06-01 12:00:00"]
    on = [r["ts"].year for r in nz.hourly_times(far, "k", "2024-06-01 12:00:00", "start").orderBy("k").collect()]
    assert on == [2024, 9999, 9999]


def test_sparse_availability_equals_the_grid(spark, sf, rows):
    facts = ds.sample_facts(spark, sf)
    seen, grid = ds.activity(spark, sf), ds.availability(spark, sf)
    cols = ["sample_id", "available", "availability_probability"]
    found = av.lookup_availability(facts, seen, ds.EVENT_ROUNDS).select(cols)
    assert rows(found) == rows(av.attach_availability(facts, grid).select(cols))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 119" not in plan


def test_selection_from_all_is_uniform(spark):
    clients = spark.range(7).select(F.col("id").alias("client_id"))
    chosen = sel.sample_from_all(clients, 3000, 3)
    per_round = chosen.groupBy("round_id").agg(F.count_distinct("client_id").alias("n"), F.max("rank").alias("r")).collect()
    assert len(per_round) == 3000 and {(r["n"], r["r"]) for r in per_round} == {(3, 3)}
    counts = [r["count"] for r in chosen.groupBy("client_id").count().collect()]
    assert len(counts) == 7 and max(abs(c - 9000 / 7) for c in counts) < 150
    assert sel.sample_from_all(clients, 2, 9).count() == 14 and sel.sample_from_all(clients.limit(0), 2, 9).count() == 0


def test_terms_are_found_inside_tokens(spark, rows):
    df = spark.createDataFrame([(1, 0, "Interest rates"), (2, 1, "INTERESTING interest"), (3, 1, "x" * 3000 + "ratex"), (4, 2, None), (5, 2, "rat es")], "sample_id int, round_id int, text string")
    terms = spark.createDataFrame([("interest", 1), ("rate", 0), ("interesting", 0), ("terest", 2)], "term string, first_seen_round int")
    got = rows(sc.match_terms(df, terms).select("sample_id", "term"))
    assert got == [(1, "rate"), (2, "interest"), (2, "interesting"), (3, "rate")]


def test_prepare_lays_the_grid_out_for_its_own_table_only(spark, sf, rows):
    """The samples' availability comes from the sparse log, equals the grid's, and the clients of one file are spread before they unfold."""
    raw = ds.table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("label"))
    seen, clients = av.observed_activity(ds.table(spark, sf, "events"), ds.START, 72, ROUNDS), ds.clients(spark, sf)
    grid = av.availability_matrix(clients, seen, ROUNDS)
    assert grid.filter("round_id = 0").select(F.spark_partition_id().alias("task")).distinct().count() == 4
    given = (raw, "doc_id", clients, grid, ROUNDS, ds.PERSONAS, ds.CONCEPTS, ds.NOW)
    sparse, dense = pr.prepare(*given, activity=seen), pr.prepare(*given)
    cols = ["sample_id", "round_id", "client_id", "available", "availability_probability", "timestamp", "prompt", "text", "label"]
    assert rows(sparse.full.select(cols)) == rows(dense.full.select(cols))
    plan = sparse.full._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0" not in plan and plan.count("Join") == 1


def test_a_round_is_written_by_few_tasks(spark, prepared):
    out, _ = prepared
    files = glob.glob(f"{out}/metadata/full_client_dataset/round_id=*/*.parquet")
    assert ROUNDS <= len(files) < ROUNDS + 4


def test_exported_rounds_are_read_without_a_look_for_names(spark, prepared):
    """Same rows as with names read from the files."""
    out, _ = prepared
    schema = "prompt string, text string, label string, timestamp timestamp_ntz, persona string, region string, round_id int, client_id bigint"
    back, by_name = readers.read_client_rounds(spark, f"{out}/rounds", schema), readers.read_typed_csv(spark, f"{out}/rounds", schema)
    assert back.schema == by_name.schema and back.count() > 0
    assert back.exceptAll(by_name).isEmpty() and by_name.exceptAll(back).isEmpty()


def test_export_round_trip_computes_the_stream_once(spark, sf, monkeypatch):
    from driftwell.plans import checks_jobs

    taken = []
    monkeypatch.setattr(checks_jobs.writers, "export_client_rounds", lambda df, path: (taken.append(df), writers.write_table(df.selectExpr("prompt", "text", "label", "ts as timestamp", "persona", "region", "round_id", "client_id"), path, "csv", ["round_id", "client_id"])))
    checks_jobs.export_round_trip(spark, sf)
    assert "Join" not in taken[0]._jdf.queryExecution().optimizedPlan().toString()
